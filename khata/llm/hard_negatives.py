"""Hard negatives by a secondary sort.

Every anchor is scored against all rows, a tile of anchors by a tile of rows at a time. Scores travel packed into byte keys (anchor,
descending score, kind, id), dealt by anchor and sorted inside the shuffle (``repartitionAndSortWithinPartitions``). An iterator over
the sorted stream opens the window of each of the first ``POSITIVES`` positives of an anchor and gives its negatives as they come by;
it holds those few open windows and no other row of the anchor.

Two rounds keep the shuffle small without losing a row. The first sends each task's own best ``POSITIVES`` positives of an anchor, and
the stream's first ones are the anchor's. In the second the windows are known, and a task sends the first ``NEGATIVES`` rows it has in
each of them; the first of all are among the first of some task. So a key has at most 20 rows a task, however many rows share its label.

Anchors are a fixed share of the table and grow with it, so they are handled in blocks of at most ``BLOCK_BYTES`` of vectors; a block
and its windows are what is broadcast, after their size is checked, and a block's result is written before the next one starts.

Scores are exact integers: vectors are multiplied as doubles while sums stay below 2^53, else as 64-bit integers; a score that could
pass 2^62 raises, because the result has no type for it.

Cases: rows with a null id, label or vector, or with a null or non-finite component take no part; a shorter vector counts as filled
with zeros; an empty vector scores 0. An id with several rows is, as an anchor, the smallest of them by (label, vector); as another row
it counts once per distinct score; rows of the anchor's own id are never its positives or negatives. Windows of positives below zero are empty. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut

ANCHOR_EVERY, FLIP_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
BLOCK_BYTES = 32 << 20
TILE = 512
TILE_CELLS = 1 << 22

NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
SIGN = np.uint64(1 << 63)
KEY = np.dtype([("anchor", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8")])
PAIRS = "anchor_id long, positive_id long, positive_score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, with the labels turned."""
    real = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & real)
    return own.withColumn("label", F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component, filled with zeros to at least ``width`` columns."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(ends)
    out = np.zeros((len(vectors), max(width, int(lengths.max(initial=0)))))
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)] = np.floor(256 * vectors.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]])
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices, the narrower one filled with zeros."""
    width = min(left.shape[1], right.shape[1])
    a, b = left[:, :width], right[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most >= 2**62:
        raise OverflowError("inner products of these vectors do not fit a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Block:
    """Anchors of one block, sorted by id, and once known the windows of their positives."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def layers(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of a batch sorted by id, in parts without a repeated id and of bounded size; equal rows count once."""
    batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
    step = max(16, TILE_CELLS // TILE)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        ids, labels, vectors = part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width)
        nth = np.zeros(len(ids), np.int64)
        if len(np.unique(ids)) < len(ids):
            whole = np.concatenate([np.stack([ids, labels], 1).view(np.float64), vectors], 1)
            kept = np.sort(np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1] * 8}").ravel(), return_index=True)[1])
            ids, labels, vectors = ids[kept], labels[kept], vectors[kept]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            nth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        for n in range(int(nth.max(initial=-1)) + 1):
            yield ids[nth == n], labels[nth == n], vectors[nth == n]


def best(score: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` first (score, id) of each row, higher scores and then smaller ids first; ids ascend, ``NONE`` is no score."""
    width = score.shape[1]
    if width <= n:
        at = np.broadcast_to(np.arange(width), score.shape)
    elif max(abs(int(score.max(initial=0))), abs(int(np.where(score == NONE, 0, score).min(initial=0)))) < 2**61 // width:
        at = np.argpartition(-np.where(score == NONE, NONE + 2, score * width + np.arange(width)[::-1]), n, axis=1)[:, :n]
    else:
        at = np.argsort(np.where(score == NONE, LAST, -score), axis=1, kind="stable")[:, :n]
    found = np.take_along_axis(score, at, 1)
    return found, np.where(found == NONE, LAST, ids[at])


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` first different (score, id) of both, row by row."""
    score, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    for again in (True, False):
        order = np.lexsort((ids, np.where(score == NONE, LAST, -score)))
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        if again:
            same = np.zeros(score.shape, bool)
            same[:, 1:] = (score[:, 1:] == score[:, :-1]) & (ids[:, 1:] == ids[:, :-1])
            score, ids = np.where(same, NONE, score), np.where(same, LAST, ids)
    return score[:, :n], ids[:, :n]


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    """Byte keys whose order is anchor, falling score, positives before negatives, id."""
    keys = np.zeros(len(anchor), KEY)
    keys["anchor"], keys["id"], keys["kind"] = anchor.astype(np.uint64) ^ SIGN, ids.astype(np.uint64) ^ SIGN, kind
    keys["fall"] = (-score).astype(np.uint64) ^ SIGN
    ends = np.arange(len(keys) + 1, dtype=np.int32) * KEY.itemsize
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(keys.tobytes())])], ["key"])


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    bias = 1 << 63
    return int.from_bytes(key[:8], "big") - bias, bias - int.from_bytes(key[8:16], "big"), key[16], int.from_bytes(key[17:], "big") - bias


def _positives(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        top = np.full((len(block.ids), POSITIVES), NONE), np.full((len(block.ids), POSITIVES), LAST)
        for batch in batches:
            for ids, labels, vectors in layers(batch, block.vectors.shape[1]):
                for label in np.unique(labels):
                    anchors, rows = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
                    for at in range(0, len(anchors), TILE):
                        tile = anchors[at:at + TILE]
                        score = products(block.vectors[tile], vectors[rows])
                        score[block.ids[tile][:, None] == ids[rows][None, :]] = NONE
                        top[0][tile], top[1][tile] = merge((top[0][tile], top[1][tile]), best(score, ids[rows], POSITIVES), POSITIVES)
        row, column = np.nonzero(top[0] != NONE)
        yield packed(block.ids[row], top[0][row, column], 0, top[1][row, column])
    return run


def _negatives(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        shape = len(block.ids), POSITIVES, NEGATIVES
        top = np.full(shape, NONE), np.full(shape, LAST)
        for batch in batches:
            for ids, labels, vectors in layers(batch, block.vectors.shape[1]):
                for at in range(0, len(block.ids), TILE):
                    tile = slice(at, at + TILE)
                    score = products(block.vectors[tile], vectors)
                    apart = (block.labels[tile][:, None] != labels[None, :]) & (block.ids[tile][:, None] != ids[None, :])
                    for k in range(POSITIVES):
                        inside = apart & (score >= block.low[tile, k][:, None]) & (score <= block.high[tile, k][:, None])
                        some = np.flatnonzero(inside.any(1))
                        if len(some):
                            own = at + some
                            found = best(np.where(inside[some], score[some], NONE), ids, NEGATIVES)
                            top[0][own, k], top[1][own, k] = merge((top[0][own, k], top[1][own, k]), found, NEGATIVES)
        row, k, column = np.nonzero(top[0] != NONE)
        sent = np.unique(np.stack([row, top[0][row, k, column], top[1][row, k, column]]), axis=1)
        yield packed(block.ids[sent[0]], sent[1], 1, sent[2])
    return run


def by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def secondary_sort(keys: DataFrame, parts: int):
    """The keys dealt by anchor, each part in key order."""
    return keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, by_anchor)


def first_positives(stream: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, int, int]]:
    anchor, last, taken = None, None, 0
    for key, _ in stream:
        if key == last:
            continue
        last = key
        own, score, _, row = unpacked(key)
        anchor, taken = own, taken + 1 if own == anchor else 1
        if taken <= POSITIVES:
            yield own, row, score


def windows(stream: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Opens a window at each positive and emits its first negatives; a window closes when it is full or the scores fall below it."""
    anchor, last, opened = None, None, []
    for key, _ in stream:
        if key == last:
            continue
        last = key
        own, score, kind, row = unpacked(key)
        if own != anchor:
            anchor, opened = own, []
        if kind == 0:
            opened.append([row, score, 0])
            continue
        opened = [w for w in opened if w[2] < NEGATIVES and LOW * w[1] <= 100 * score]
        for w in opened:
            if 100 * score <= HIGH * w[1]:
                w[2] += 1
                yield own, w[0], w[2], row, w[1], score


def _block(rows: list) -> Block:
    rows = sorted(rows, key=lambda r: r["vec_id"])
    vectors = pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))
    return Block(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), matrix(vectors, 0))


def mine(embeddings: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the first negatives in each positive's window."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")
    anchors = cut(anchors, "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()
    if size["n"] == 0:
        return spark.createDataFrame([], RESULT)
    width = 8 * max(size["width"], 1)
    blocks = -(-size["n"] * width // block_bytes)
    # the hash deals anchors unevenly: more blocks until the fullest one fits
    while blocks < size["n"] and anchors.groupBy(_block_number(blocks)).count().agg(F.max("count")).first()[0] * width > max(block_bytes, width):
        blocks *= 2
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for n in range(blocks):
        block = _block(anchors.filter(_block_number(blocks) == n).collect())
        if len(block.ids) == 0:
            continue
        shared = spark.sparkContext.broadcast(block)
        mine_first = secondary_sort(rows.mapInArrow(_positives(shared), "key binary"), parts).mapPartitions(first_positives)
        pairs = cut(spark.createDataFrame(mine_first, PAIRS), "positives")
        block.low, block.high = _limits(block, pairs)
        aware = spark.sparkContext.broadcast(block)
        keys = pairs.mapInArrow(_pair_keys, "key binary").unionByName(rows.mapInArrow(_negatives(aware), "key binary"))
        found = cut(spark.createDataFrame(secondary_sort(keys, parts).mapPartitions(windows), RESULT), "negatives")
        shared.destroy()
        aware.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _block_number(blocks: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(blocks))


def _limits(block: Block, pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each window; collects at most ``POSITIVES`` rows per anchor of the block."""
    low, high = np.ones((len(block.ids), POSITIVES), np.int64), np.zeros((len(block.ids), POSITIVES), np.int64)
    taken: dict[int, int] = {}
    for r in pairs.collect():
        at = int(np.searchsorted(block.ids, r["anchor_id"]))
        k = taken[at] = taken.get(at, -1) + 1
        low[at, k], high[at, k] = -(-LOW * r["positive_score"] // 100), HIGH * r["positive_score"] // 100
    return low, high


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, row, score = (c.to_numpy() for c in batch.columns)
        yield packed(anchor, score, 0, row)
