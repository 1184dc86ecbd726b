"""Word and shingle hashes of whole texts, a batch at a time, inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``size`` bytes of text each (a longer single text is one piece)."""
    column = batch.column(batch.schema.names.index(text))
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(bounds, words): the words of text i, A-Z in lower case, are ``words[bounds[i]:bounds[i + 1]]``."""
    # taken anew: Arrow's text kernels misread arrays whose first offset is not zero
    whole = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(bounds[0], bounds[-1] - bounds[0])
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False).astype(np.int64))])
    return before[bounds - bounds[0]], flat.filter(real).dictionary_encode()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bounds, words = tokens(texts)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    return bounds, own[words.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): sorted distinct hashes of the ``width``-word shingles of each text; a shorter text is one shingle."""
    bounds, words = word_hashes(texts)
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(bounds[:-1], n)
    long = np.repeat(counts >= width, n)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    hashes = np.zeros(len(at), np.uint64)
    reach = np.repeat(np.minimum(counts, width), n)
    with np.errstate(over="ignore"):
        for k in range(width):
            hashes = np.where(reach > k, mix(hashes + padded[at + k] * _ODD[k % 5] + np.uint64(k + 1)), hashes)
        hashes = np.where(long, hashes, mix(hashes ^ reach.astype(np.uint64)))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, doc = hashes[first], doc[first]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]), hashes
