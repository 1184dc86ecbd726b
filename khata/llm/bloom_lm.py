"""A smoothed bigram language model whose counts live in a log-frequency Bloom filter.

Counting. Tasks count words and word pairs of their training texts, a piece of text at a time, and send packed blobs of (hash,
count) to the bucket of the hash, so the shuffle carries a key once per piece. A bucket's reducer adds them up, keeps the exact word
counts as a table, and writes its own segments of the filter, one for words and one for pairs: a count c is quantised to
``q = 1 + floor(log2 c)`` and the keys (n-gram, 1) to (n-gram, q) are set. Reading back, levels are probed until the first miss; the
answer is the middle of the level's range. Words and pairs enter from count 1; a segment grows with its entries (``BITS`` each).

Broadcast. The words' segments are, and the counts of at most ``HEAD`` words, those with ``1 / HEAD`` of all tokens or more. The pairs'
segments are as long as the whole filter has at most ``FILTER_BYTES``. Past that a pair goes to its bucket's segment with the levels
of its words, and the scores are the same; only the levels of at most ``HEAD`` pairs, chosen like the words, are broadcast then. Exact
word counts of all other words are never broadcast: their occurrences go to the bucket of the word, where the counts are. Both come
back as one partial sum per document. A word or pair outside the head has less than ``1 / HEAD`` of all tokens, so no bucket is hot.

Scoring. ``p(w | v) = (c(v w) + MASS * p(w)) / (c(v) + MASS)`` with ``p(w) = (c(w) + 1) / (N + V + 1)``, all counts from the filter;
the first word follows a start mark, the last is an end mark, counted as a token. ``base_score`` uses the exact counts of words
alone.

Cases: null and empty texts are the end mark; a null doc_id is hashed as empty text for the fold; repeated rows are trained on
and returned as often as they occur; without training texts N and V are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.llm.base import fold
from khata.llm.shingles import mix, slices, word_hashes

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 17
BITS, PROBES, FILTER_BYTES = 10, 4, 256 << 20
MASS = 64.0
PIECE_BYTES, REDUCER_BYTES = 4_000_000, 16 << 20
END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A257A257A257A2)


def streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, tokens, previous tokens) with an end mark after each text's words."""
    bounds, words = word_hashes(texts)
    n = np.diff(bounds) + 1
    ends = np.cumsum(n)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[~last] = words
    before = np.concatenate([[START], out[:-1]]) if len(out) else out
    before[ends[:-1]] = START
    return np.concatenate([[0], ends]), out, before


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(word + np.uint64(0x1234567)))


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket numbers present, bounds) that group keys by bucket."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate([[len(bucket) > 0], bucket[1:] != bucket[:-1]]))
    return order, bucket[starts], np.append(starts, len(bucket))


BLOB = "bucket long, kind int, piece long, a binary, b binary, c binary, docs binary"
KINDS = {"words": 0, "pairs": 1, "tail": 2, "rows": 3, "segment": 4, "probes": 5}
_NAMES = [x.split()[0] for x in BLOB.split(", ")]


def _blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 4
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=PIECE_BYTES):
                bounds, words, before = streams(piece.column("text"))
                rows = []
                starts = np.full(len(bounds) - 1, START, np.uint64)
                for kind, keys in (("words", np.concatenate([words, starts])), ("pairs", pair(before, words))):
                    keys, counts = np.unique(keys, return_counts=True)
                    order, present, at = _split(keys, buckets)
                    keys, counts = keys[order], counts[order].astype(np.uint32)
                    rows += [(int(k), KINDS[kind], 0, keys[a:b].tobytes(), counts[a:b].tobytes(), None, None) for k, a, b in zip(present, at[:-1], at[1:], strict=True)]
                yield _blob_rows(rows)
    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(count, starts)


def level(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for none."""
    return np.where(levels > 0, 1.5 * np.exp2(levels - 1.0) - 0.5, 0.0)


def _places(keys: np.ndarray, step, probe: int, bits) -> np.ndarray:
    with np.errstate(over="ignore"):
        first = mix(keys + np.uint64(0xA5A5) * np.asarray(step, np.uint64))
        return (first + np.uint64(probe) * (mix(first) | np.uint64(1))) % np.asarray(bits, np.uint64)


def make_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of one bucket's segment, as bytes of eight; sized by the number of (key, level) entries."""
    levels = level(counts)
    whole = max(64, -(-int(levels.sum()) * BITS // 64) * 64)
    bits = np.zeros(whole, bool)
    for step in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= step]
        for probe in range(PROBES):
            bits[_places(own, step, probe, whole).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def read_levels(keys: np.ndarray, bits: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Levels read from the segments, each up to the first miss."""
    levels = np.zeros(len(keys), np.int64)
    if len(size) == 0:
        return levels
    segment = (keys % np.uint64(len(size))).astype(np.int64)
    size, offset = size[segment], offset[segment]
    alive = np.flatnonzero(size > 0)
    step = 0
    while len(alive):
        step += 1
        for probe in range(PROBES):
            at = _places(keys[alive], step, probe, size[alive]).astype(np.int64)
            alive = alive[(bits[offset[alive] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
        levels[alive] = step
    return levels


def segment_levels(keys: np.ndarray, segment: bytes) -> np.ndarray:
    """Levels of keys that all belong to one segment."""
    return read_levels(keys, np.frombuffer(segment, np.uint8), np.zeros(1, np.int64), np.array([8 * len(segment)]))


def _reducer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], tuple[list, list]] = {}
    for batch in batches:
        for bucket, kind, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
            keys, counts = held.setdefault((bucket, kind), ([], []))
            keys.append(np.frombuffer(a, np.uint64))
            counts.append(np.frombuffer(b, np.uint32))
    for bucket in sorted({b for b, _ in held}):
        words, n = _summed(*held.pop((bucket, 0), ([], [])))
        pairs, m = _summed(*held.pop((bucket, 1), ([], [])))
        real = words != START
        often = m >= max(1.0, m.sum() / HEAD)
        yield pa.RecordBatch.from_arrays([
            pa.array([bucket], pa.int64()), pa.array([int(n[real].sum())], pa.int64()), pa.array([int(real.sum())], pa.int64()), pa.array([int(n[~real].sum())], pa.int64()),
            pa.array([words[real].tobytes()], pa.binary()), pa.array([n[real].astype(np.int64).tobytes()], pa.binary()),
            pa.array([make_segment(words, n).tobytes()], pa.binary()), pa.array([make_segment(pairs, m).tobytes()], pa.binary()),
            pa.array([pairs[often].tobytes()], pa.binary()), pa.array([m[often].astype(np.int64).tobytes()], pa.binary()),
        ], [x.split()[0] for x in LEARNT.split(", ")])


LEARNT = "bucket long, n long, v long, texts long, words binary, counts binary, word_segment binary, pair_segment binary, often binary, often_counts binary"


def _head(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                word, count = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
                often = count >= floor
                yield pa.RecordBatch.from_arrays([pa.array([word[often].tobytes()], pa.binary()), pa.array([count[often].tobytes()], pa.binary())], ["words", "counts"])
    return run


def _often(floor: float):
    """Frequent pairs with the levels that their bucket's segment gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts, segment in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                pairs = np.frombuffer(pairs, np.uint64)[np.frombuffer(counts, np.int64) >= floor]
                yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary()), pa.array([segment_levels(pairs, segment).tobytes()], pa.binary())], ["pairs", "levels"])
    return run


@dataclass
class Model:
    """What scoring tasks get: totals, frequent words with exact counts, and the words' filter.

    ``pairs`` is the pairs' filter as (bits, offset, size); without it, ``often`` has the levels of frequent pairs.
    """

    tokens: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray
    bits: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    often: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return read_levels(keys, self.bits, self.offset, self.size)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts read from the filter, level by level until a probe misses."""
        return middle(self.levels(keys))

    def pair_levels(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, which of them are known here)."""
        if self.pairs is not None:
            return read_levels(keys, *self.pairs), np.ones(len(keys), bool)
        if len(self.often[0]) == 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.often[0], keys), len(self.often[0]) - 1)
        hit = self.often[0][at] == keys
        return np.where(hit, self.often[1][at], 0), hit


def _segments(learnt: DataFrame, column: str, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, offset, size) of the segments of all buckets."""
    size, parts = np.zeros(buckets, np.int64), {}
    for r in learnt.select("bucket", column).toLocalIterator():
        parts[r["bucket"]] = np.frombuffer(r[column], np.uint8)
        size[r["bucket"]] = 8 * len(r[column])
    offset = np.concatenate([[0], np.cumsum(size // 8)[:-1]])
    return np.concatenate([np.zeros(0, np.uint8), *(parts[k] for k in sorted(parts))]), offset, size


def _sorted(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of all rows, by key."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in rows)])
    numbers = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[1], np.int64) for r in rows)])
    order = np.argsort(keys)
    return keys[order], numbers[order]


def train(docs: DataFrame, buckets: int, parts: int, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, Model]:
    """Exact word counts and filter segments by bucket, as a written table, and the model."""
    blobs = docs.select("text").mapInArrow(_counter(buckets), BLOB).repartition(parts, "bucket")
    learnt = cut(blobs.mapInArrow(_reducer, LEARNT), "lm-counts")
    whole = F.octet_length("word_segment") + F.octet_length("pair_segment")
    n, v, size = (x or 0 for x in learnt.agg(F.sum("n"), F.sum("v"), F.sum(whole)).first())
    floor = max(1.0, n / HEAD)
    head = _sorted(learnt.select("words", "counts").mapInArrow(_head(floor), "words binary, counts binary").collect())
    model = Model(n, v, *head, *_segments(learnt, "word_segment", buckets))
    if size <= filter_bytes:
        model.pairs = _segments(learnt, "pair_segment", buckets)
    else:
        model.often = _sorted(learnt.select("often", "often_counts", "pair_segment").mapInArrow(_often(floor), "pairs binary, levels binary").collect())
    return learnt, model


def _log_chance(pairs: np.ndarray, words: np.ndarray, before: np.ndarray, total: float) -> np.ndarray:
    """Logarithms of the smoothed chances, from the levels of the pairs, their second and their first words."""
    chance = (middle(pairs) + MASS * ((middle(words) + 1) / total)) / (middle(before) + MASS)
    return np.log10(np.minimum(chance, 1.0))


def _scorer(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        number = TaskContext.get().partitionId() << 32
        total = model.tokens + model.distinct + 1.0
        for batch in batches:
            for piece in slices(batch, size=PIECE_BYTES):
                number += 1
                bounds, words, before = streams(piece.column("text"))
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                seen, which = np.unique(words, return_inverse=True)
                known = model.levels(seen)[which]
                seen_before, which_before = np.unique(before, return_inverse=True)
                held = model.levels(seen_before)[which_before]
                pairs = pair(before, words)
                found, here = model.pair_levels(pairs)
                score = np.bincount(doc[here], weights=_log_chance(found[here], known[here], held[here], total), minlength=len(n))

                at = np.minimum(np.searchsorted(model.head, seen), max(len(model.head) - 1, 0))
                hit = model.head[at] == seen if len(model.head) else np.zeros(len(seen), bool)
                exact = np.where(hit, model.head_counts[at] if len(model.head) else 0, 0)
                base = np.bincount(doc, weights=np.where(hit, np.log10((exact + 1) / total), 0.0)[which], minlength=len(n))
                counted = np.bincount(doc, weights=hit[which], minlength=len(n)).astype(np.int64)

                far = ~hit[which]
                code, times = np.unique(which[far].astype(np.int64) * len(n) + doc[far], return_counts=True)
                rest, whose = seen[code // max(len(n), 1)], (code % max(len(n), 1)).astype(np.uint32)
                order, present, ends = _split(rest, buckets)
                rest, whose, times = rest[order], whose[order], times[order].astype(np.uint32)
                rows = [(int(k), KINDS["tail"], number, rest[a:b].tobytes(), whose[a:b].tobytes(), times[a:b].tobytes(), None) for k, a, b in zip(present, ends[:-1], ends[1:], strict=True)]
                away = np.flatnonzero(~here)
                if len(away):
                    away = away[np.lexsort((doc[away], pairs[away]))]
                    starts = np.flatnonzero(np.concatenate([[True], (pairs[away][1:] != pairs[away][:-1]) | (doc[away][1:] != doc[away][:-1])]))
                    times = np.diff(np.append(starts, len(away))).astype(np.uint32)
                    away = away[starts]
                    order, present, ends = _split(pairs[away], buckets)
                    away, times = away[order], times[order]
                    for k, a, b in zip(present, ends[:-1], ends[1:], strict=True):
                        own = away[a:b]
                        levels = np.concatenate([known[own], held[own]]).astype(np.uint8)
                        rows.append((int(k), KINDS["probes"], number, pairs[own].tobytes(), doc[own].astype(np.uint32).tobytes(), times[a:b].tobytes(), levels.tobytes()))
                sink = pa.BufferOutputStream()
                frame = pa.table({"doc_id": piece.column("doc_id").cast(pa.int64()), "held_out": piece.column("held_out"), "n_tokens": pa.array(n), "n_known": pa.array(counted), "base_score": pa.array(base), "score": pa.array(score)})
                with pa.ipc.new_stream(sink, frame.schema) as out:
                    out.write_table(frame)
                rows.append((number % buckets, KINDS["rows"], number, None, None, None, sink.getvalue().to_pybytes()))
                yield _blob_rows(rows)
    return run


def _resolver(total: float):
    """Exact counts for the words outside the head and chances of pairs not broadcast, as sums per piece and document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, tails, rows, segments, probes = [], [], [], [], {}, []
        for batch in batches:
            for bucket, kind, piece, a, b, c, docs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == KINDS["words"]:
                    words.append(np.frombuffer(a, np.uint64))
                    counts.append(np.frombuffer(b, np.int64))
                elif kind == KINDS["tail"]:
                    tails.append((piece, a, b, c))
                elif kind == KINDS["segment"]:
                    segments[bucket] = a
                elif kind == KINDS["probes"]:
                    probes.append((bucket, piece, a, b, c, docs))
                else:
                    rows.append((bucket, kind, piece, a, b, c, docs))
        if rows:
            yield _blob_rows(rows)
        word, count = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *counts])
        order = np.argsort(word)
        word, count = word[order], count[order]
        for piece, a, b, c in tails:
            rest, whose, times = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint32)
            at = np.minimum(np.searchsorted(word, rest), max(len(word) - 1, 0))
            exact = np.where(word[at] == rest, count[at], 0) if len(word) else np.zeros(len(rest), np.int64)
            docs, own = np.unique(whose, return_inverse=True)
            base = np.bincount(own, weights=times * np.log10((exact + 1) / total))
            known = np.bincount(own, weights=times * (exact > 0)).astype(np.int64)
            yield _blob_rows([(0, KINDS["tail"], piece, docs.tobytes(), base.tobytes(), known.tobytes(), None)])
        for bucket, piece, a, b, c, levels in probes:
            keys, whose, times = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint32)
            known, held = np.frombuffer(levels, np.uint8).reshape(2, -1)
            found = segment_levels(keys, segments[bucket]) if bucket in segments else np.zeros(len(keys), np.int64)
            docs, own = np.unique(whose, return_inverse=True)
            part = np.bincount(own, weights=times * _log_chance(found, known, held, total))
            yield _blob_rows([(0, KINDS["probes"], piece, docs.tobytes(), part.tobytes(), None, None)])
    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finisher(tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, parts = {}, {}
        for batch in batches:
            for _, kind, piece, a, b, c, docs in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == KINDS["rows"]:
                    frames[piece] = pa.ipc.open_stream(docs).read_all()
                else:
                    parts.setdefault(piece, []).append((kind, a, b, c))
        for piece, frame in frames.items():
            base, known = frame["base_score"].to_numpy().copy(), frame["n_known"].to_numpy().copy()
            score = frame["score"].to_numpy().copy()
            for kind, a, b, c in parts.pop(piece, []):
                docs = np.frombuffer(a, np.uint32)
                if kind == KINDS["probes"]:
                    score[docs] += np.frombuffer(b, np.float64)
                    continue
                base[docs] += np.frombuffer(b, np.float64)
                known[docs] += np.frombuffer(c, np.int64)
            out = pa.table({
                "doc_id": frame["doc_id"], "held_out": frame["held_out"], "n_tokens": frame["n_tokens"], "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(base), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
            })
            yield from out.combine_chunks().to_batches()
    return run


def score(docs: DataFrame, filter_bytes: int | None = None) -> DataFrame:
    """Rows of ``RESULT`` for every document, the model trained on all that are not held out."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // REDUCER_BYTES)
    buckets = 2 * parts
    marked = docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    learnt, model = train(marked.filter("NOT held_out"), buckets, parts, FILTER_BYTES if filter_bytes is None else filter_bytes)
    total = model.tokens + model.distinct + 1.0
    shared = spark.sparkContext.broadcast(model)
    blobs = marked.mapInArrow(_scorer(shared, buckets), BLOB)
    none = F.lit(None).cast("binary")
    exact = learnt.select("bucket", F.lit(KINDS["words"]).alias("kind"), F.lit(0).cast("long").alias("piece"), F.col("words").alias("a"), F.col("counts").alias("b"), none.alias("c"), none.alias("docs"))
    if model.pairs is None:
        exact = exact.unionByName(learnt.select("bucket", F.lit(KINDS["segment"]).alias("kind"), F.lit(0).cast("long").alias("piece"), F.col("pair_segment").alias("a"), none.alias("b"), none.alias("c"), none.alias("docs")))
    resolved = blobs.unionByName(exact).repartition(parts, "bucket").mapInArrow(_resolver(total), BLOB)
    return resolved.repartition(parts, "piece").mapInArrow(_finisher(model.tokens), RESULT)
