"""Best-fit packing of documents into fixed-length sequences, never two of one source or of one duplicate cluster in a bin.

A document's length is its words plus one end mark. Longer ones than ``capacity`` are cut into full pieces, each a bin of its
own, and a rest. Pieces are dealt by hash into blocks of about ``block_rows``, so that a hot source or cluster is spread over
all blocks; each block is packed on its own, longest first (ties by doc_id, then row). Bins stand in levels by what room
they have left and carry a bitmap of sources and one of duplicate clusters. The search starts at the level that fits exactly
and goes on to the next larger one until a bin without the piece's source and cluster turns up: the tightest compatible bin.
Levels whose bins all hold the source are passed over by a count. If there is none, a new bin is opened.

Duplicate clusters are exact copies by their lower-case words unless ``cluster`` names a column. Within a bin every pair of
pieces differs in source and in cluster; pieces of one document have its source, so they never meet either.

Cases: null and empty texts have length 1; null sources are one source; every repeated row is packed, in another bin as it
belongs to the same cluster; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.llm.base import lower_ascii, words

CAPACITY, BLOCK_ROWS = 2048, 8192
SCHEMA = "doc_id long, piece int, doc_start long, n_tokens int, source string, cluster long, bin_id long, bin_start int"


class Bins:
    """Open bins of one block."""

    def __init__(self, capacity: int, n_sources: int) -> None:
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.height = np.zeros(capacity + 1, np.int64)
        self.holding = np.zeros((n_sources, capacity + 1), np.int64)
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.capacity = capacity

    def _shift(self, b: int, by: int) -> None:
        room, held, s = self.room[b], self.sources[b], 0
        self.height[room] += by
        while held:
            if held & 1:
                self.holding[s, room] += by
            held >>= 1
            s += 1

    def tightest(self, length: int, source: int, cluster: int) -> int | None:
        at = length
        while at <= self.capacity:
            free = self.height[at:] > self.holding[source, at:]
            step = int(free.argmax())
            if not free[step]:
                return None
            at += step
            for b in self.levels[at]:
                if not (self.sources[b] >> source) & 1 and not (cluster >= 0 and (self.clusters[b] >> cluster) & 1):
                    return b
            at += 1
        return None

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it) of a new piece."""
        b = self.tightest(length, source, cluster)
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._shift(b, -1)
            self.levels[self.room[b]].remove(b)
        start = self.capacity - self.room[b]
        self.room[b] -= length
        self.sources[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        self.levels[self.room[b]].append(b)
        self._shift(b, 1)
        return b, start


def pack_block(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, place) of each piece of a block, in the given order."""
    source_no = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    seen = Counter(clusters)
    cluster_no = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    bins = Bins(capacity, max(1, len(source_no)))
    return [bins.put(n, source_no[s], cluster_no.get(c, -1)) for n, s, c in zip(lengths, sources, clusters, strict=True)]


def _packer(capacity: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        sources = block["source"].where(block["source"].notna(), None).tolist()
        placed = pack_block(block["n_tokens"].tolist(), sources, block["cluster"].tolist(), capacity)
        base = int(block["block"].iloc[0]) << 32
        return block.assign(bin_id=[base + b for b, _ in placed], bin_start=np.array([s for _, s in placed], np.int32))[
            ["doc_id", "piece", "doc_start", "n_tokens", "source", "cluster", "bin_id", "bin_start"]
        ]
    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, source, cluster, piece, doc_start, n_tokens."""
    own = F.xxhash64(F.concat_ws(" ", "w")) if cluster is None else F.xxhash64(F.col(cluster))
    keep = ["doc_id", "source", "text"] + ([cluster] if cluster else [])
    sized = docs.select(*keep, words(lower_ascii(F.col("text"))).alias("w")).select(
        "doc_id", "source", own.alias("cluster"), (F.size("w") + 1).cast("long").alias("total")
    )
    return sized.withColumn("piece", F.explode(F.expr(f"sequence(0, CAST((total - 1) DIV {capacity} AS INT))"))).select(
        "doc_id", "source", "cluster", "piece", (F.col("piece").cast("long") * capacity).alias("doc_start"),
        F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("n_tokens"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, cluster: str | None = None) -> DataFrame:
    """Every piece of every document with its bin and place in the bin (columns of ``SCHEMA``)."""
    slim = cut(pieces(docs, capacity, cluster), "pack-pieces")
    blocks = slim.count() // block_rows + 1
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_packer(capacity), SCHEMA)
