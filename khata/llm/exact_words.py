"""Words of whole texts as numbers, unchanged in case, and exact grouping of equal word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd, so its powers have inverses modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, codes, hashes): the words of text i are ``codes[bounds[i]:bounds[i + 1]]``; equal codes are equal words of this call.

    ``hashes[code]`` is the 64-bit hash of a word, the same in every call. A null text has no words.
    """
    # taken anew: Arrow's text kernels misread arrays whose first offset is not zero
    whole = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    split = pc.ascii_split_whitespace(whole)
    ends = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(ends[0], ends[-1] - ends[0])
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False).astype(np.int64))])
    coded = flat.filter(real).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return before[ends - ends[0]], coded.indices.to_numpy(), hashes


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive values, over the whole array; equal windows have equal hashes."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)), dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * _powers(_INVERSE, n)


def equal_windows(hashes: np.ndarray, codes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): windows ``codes[at:at + width]`` in an order that puts equal ones together, and the group number of each.

    Sorted by hash; every window is compared word by word with the first of its hash, and those that differ are grouped again.
    """
    order = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[order][1:] != hashes[order][:-1]
    orders, groups, used = [], [], 0
    while len(order):
        group = np.cumsum(fresh) - 1
        first = at[order[np.flatnonzero(fresh)]]
        odd = np.zeros(len(order), bool)
        rest = np.flatnonzero(~fresh)
        for k in range(width):
            odd[rest] |= codes[at[order[rest]] + k] != codes[first[group[rest]] + k]
        orders.append(order[~odd])
        groups.append(group[~odd] + used)
        used += int(group[-1]) + 1
        left = group[odd]
        order = order[odd]
        fresh = np.ones(len(order), bool)
        fresh[1:] = left[1:] != left[:-1]
    return (np.concatenate(orders), np.concatenate(groups)) if orders else (np.zeros(0, np.int64), np.zeros(0, np.int64))
