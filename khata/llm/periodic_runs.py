"""Periodic runs of words, by recompression.

A run is a stretch with smallest period q of at least ``max(SHORTEST, 3 q)`` words that no neighbour extends. For every period p the
positions p, 2p, 3p ... form a grid (harmonic in all, ``n log n`` for n words), and a run of that period holds two neighbouring grid
positions from which at least ``FIRST`` words agree. Grid pairs whose ``FIRST`` words have one hash are candidates; grammar queries
(``recompression``) extend each exactly to both sides. A stretch that was found with several periods has the least of them.

A task works on pieces of about ``PIECE`` bytes of text and on ``GRID`` grid positions at a time; nothing is shuffled. The grammar is built
for the documents that have a candidate.

The words of every tenth document (by crc32 of its id) first become periodic from some word on, as ``altered`` says.

Cases: a null or empty text has no words and no run; a null doc_id is never altered; words of one letter case differ from the other; repeated
rows are judged each on its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.llm.exact_words import window_hashes, word_codes
from khata.llm.recompression import compress, extend
from khata.llm.shingles import slices

SHORTEST, REPEATS = 24, 3
#: A run has this many equal words behind the first two grid positions in it: max(p, SHORTEST + 1 - 2 p) >= 9 for every p.
FIRST = 9
PIECE, GRID = 4 << 20, 1 << 21

RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])


def altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word at each place of an altered document of n words; None if it stays as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def grid_pairs(value: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of the grid positions k p and (k + 1) p of each document that agree in ``value``.

    ``value[i]`` is the hash of the words from i on; a document's words start at ``first`` and there are ``length`` of them.
    """
    periods = np.where(length >= SHORTEST, length // REPEATS, 0)
    doc = np.repeat(np.arange(len(first)), periods)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (length[doc] - FIRST) // p
    total = np.concatenate([[0], np.cumsum(points)])
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, total[at] + GRID, side="right")) - 1)
        n = points[at:to]
        step = np.repeat(p[at:to], n)
        position = (np.arange(len(step)) - np.repeat(total[at:to] - total[at], n)) * step + np.repeat(first[doc[at:to]], n)
        equal = value[position] == value[position + step]
        yield position[equal], step[equal]
        at = to


def runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run, in this order, for documents ``codes[bounds[i]:bounds[i + 1]]``."""
    first, length = bounds[:-1], np.diff(bounds)
    none = np.zeros(0, np.int64)
    pairs = list(grid_pairs(window_hashes(codes.astype(np.uint64) + np.uint64(1), FIRST), first, length))
    position, period = (np.concatenate([x[k] for x in pairs]) if pairs else none for k in (0, 1))
    if len(position) == 0:
        return none, none, none, none
    doc = np.searchsorted(bounds, position, side="right") - 1
    used = np.unique(doc)
    # separators: one before each used document and one at the end
    sizes = length[used]
    base = np.cumsum(sizes + 1) - sizes
    alone = int(codes.max()) + 1
    line = np.empty(int(sizes.sum()) + len(used) + 1, np.int64)
    inner = np.ones(len(line), bool)
    inner[np.append(base - 1, len(line) - 1)] = False
    line[~inner] = alone + np.arange(len(used) + 1)
    line[inner] = codes[np.repeat(first[used], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    levels = compress(line, alone)
    own = np.searchsorted(used, doc)
    i = position - first[doc] + base[own]
    start = i - extend(levels, i, i + period, forward=False)
    end = i + period + extend(levels, i, i + period)
    long = end - start >= np.maximum(SHORTEST, REPEATS * period)
    found = np.stack([own[long], start[long], end[long], period[long]])
    found = np.unique(found, axis=1)
    least = np.ones(found.shape[1], bool)
    least[1:] = (found[:3, 1:] != found[:3, :-1]).any(0)
    own, start, end, period = found[:, least]
    return used[own], start - base[own], end - start, period


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, size=PIECE):
            bounds, codes, _ = word_codes(piece.column("text"))
            codes = codes.astype(np.int64)
            docs = piece.column("doc_id").to_pylist()
            places = [altered(doc, n) for doc, n in zip(docs, np.diff(bounds).tolist(), strict=True)]
            for place, a, b in zip(places, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if place is not None:
                    codes[a:b] = codes[a:b][place]
            doc, start, length, period = runs(codes, bounds)
            edges = np.searchsorted(doc, np.arange(len(docs) + 1))
            out = []
            for n, (own, text) in enumerate(zip(docs, piece.column("text").cast(pa.binary()), strict=True)):
                found = list(zip(*(x[edges[n]:edges[n + 1]].tolist() for x in (start, length, period)), strict=True))
                words = (text.as_py() or b"").split()
                best, kept = (None,) * 4, words
                if places[n] is not None:
                    kept = [words[k] for k in places[n].tolist()]
                if found:
                    s, size, q = found[0]
                    for x in found[1:]:
                        if x[1] * q > size * x[2]:
                            s, size, q = x
                    best = s, size, q, 1000 * size // q
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, [x[0] + x[2] for x in found], 1)
                    np.add.at(cover, [x[0] + x[1] for x in found], -1)
                    kept = [kept[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                every = "".join(f"{s},{size},{q}\n" for s, size, q in found)
                out.append((own, len(found), *best, hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(RESULT.names, r, strict=True)) for r in out], schema=RESULT)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document.

    The run shown is that with the greatest length / period, then the smallest start and period. Every run's words behind its first
    period are left out of the collapsed text.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_judge, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
