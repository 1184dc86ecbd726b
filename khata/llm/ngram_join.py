"""Exact Jaccard self-join of documents' word shingles by partition-and-enumerate signatures, and its components.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct shingles of ``width`` words (A-Z in
lower case). The steps:

1. Every text becomes its set's 64-bit identity; equal sets are one node from here on.
2. Size bands: band b holds set sizes up to ``100 / percent`` times its smallest. Sets of one band, and those of the band
   below it, differ in at most ``k`` elements when they link. The shingle domain is split into groups of three parts. With
   ``k // 2 + 1`` groups, one group of a linked pair holds at most one differing element, so the two parts without it are
   equal; the signatures are the three two-part subsets of every group. A subset is weak if it holds no shingle but frequent
   ones. Some more groups than needed are used (``extra``), so a linked pair agrees on more of them than that: only sets with more
   weak groups must emit their weak subsets. Any set of frequent shingles gives right results; it is found on a bounded sample
   of documents (``SAMPLE_SHINGLES``), and keeps common passages from joining unlike texts.
3. Signatures travel as packed blobs, each set once per task. Up to ``SMALL`` sharers of a signature become candidate pairs; more
   are a group, compared in one task or, beyond ``GROUP`` members, tile by tile. Both are tested by parity sketches, whose distance
   never exceeds the true one; a group yields a spanning forest of its near pairs, not all of them. The components of what is
   left are blocks, which hold every linked pair.
4. Only the first document of each set in a block is read again, found through a map of bits that is broadcast (``MAP_BITS``, the
   same at any size). Inside a block, sets are compared through sketches, then exactly; pairs already
   connected are skipped, and a spanning forest comes out, never all pairs. A block with more than ``TILE_BYTES`` of sets is cut into tiles that meet two by two in separate tasks.
5. Components of the forest are the answer.

Nothing is capped. Cases: null, empty and blank texts have no set and link with nothing; fewer than ``width`` words are one
shingle; repeated rows are returned as often as they occur; rows of one doc_id but different texts are not linked by that; a
null doc_id is returned with the smallest known id of its component, null if none; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.llm.base import small_batches
from khata.llm.components import components
from khata.llm.shingles import mix, shingle_sets, slices

WIDTH, PERCENT = 4, 85
PARTS = 3
#: Sharers of a signature that become pairs; members of a tile of a larger group.
SMALL, GROUP = 8, 4096
#: Shingles that the sample of documents holds, and how often a frequent one occurs in it.
SAMPLE_SHINGLES, FREQUENT = 4_000_000, 3
NONE = np.zeros(0, np.uint64)
#: Signatures that one reducer is meant to hold, and bytes of sets on one side of a tile.
REDUCER_ENTRIES, TILE_BYTES = 2_000_000, 24 << 20
LEAST_BITS = 1024
#: Bytes of text that a task takes at a time: what it makes of them is many times as much.
PIECE = 1 << 20
#: Buckets of signatures per reducer, which holds one at a time; signatures in a blob: that many at least on average, and at most.
BUCKETS, BLOB_LEAST, BLOB_MOST = 4, 32, 512
#: Bits and parts of the map of documents to read again; a fuller map lets more documents pass for nothing.
MAP_BITS, MAP_PARTS = 1 << 26, 64


def bands(percent: int, largest: int) -> np.ndarray:
    """Upper sizes of the bands, until ``largest`` is in the last but one."""
    upper, low = [], 1
    while True:
        high = low * 100 // percent
        upper.append(high)
        if low > largest:
            return np.array(upper, np.int64)
        low = high + 1


def allowed(a, b, percent: int):
    """Most differing elements of two linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def extra(k):
    """Groups beyond the needed ones, for bands whose linked sets differ in ``k`` elements at most."""
    return np.minimum(3, 1 + k // 24)


def groups(upper, percent: int):
    """Groups per band; none where only equal sets link."""
    k = allowed(upper, upper, percent)
    return np.where(k > 0, k // 2 + 1 + extra(k), 0)


def _identity(values: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes()))))


def sketch_bits(size: int) -> int:
    return max(LEAST_BITS, 1 << max(0, int(size - 1).bit_length()))


def sketches(bounds: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Per set, the parity of the number of its elements on each of ``bits`` places (a power of two); rows of 64-bit words."""
    n = len(bounds) - 1
    with np.errstate(over="ignore"):
        spot = (mix(values + np.uint64(0x2545F491)) & np.uint64(bits - 1)).astype(np.int64)
    spot += np.repeat(np.arange(n), np.diff(bounds)) * bits
    odd = (np.bincount(spot, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(n, bits // 64)


def _own_sketches(bounds: np.ndarray, values: np.ndarray) -> list[bytes]:
    """Each set's sketch, as wide as its size asks."""
    sizes = np.diff(bounds)
    out: list[bytes] = [b""] * len(sizes)
    for small in range(0, len(sizes), 2000):
        some = [i for i in range(small, min(small + 2000, len(sizes))) if sizes[i] <= LEAST_BITS]
        part = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int64)
        chosen = np.concatenate([values[bounds[i]:bounds[i + 1]] for i in some]) if some else values[:0]
        for i, x in zip(some, sketches(part, chosen, LEAST_BITS), strict=True):
            out[i] = x.tobytes()
    for i in np.flatnonzero(sizes > LEAST_BITS).tolist():
        out[i] = sketches(np.array([0, sizes[i]]), values[bounds[i]:bounds[i + 1]], sketch_bits(sizes[i]))[0].tobytes()
    return out


def _folded(words: np.ndarray, length: int) -> np.ndarray:
    """A sketch narrowed to ``length`` words: places that fall together add up their parities."""
    while len(words) > length:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=PIECE):
                bounds, values = shingle_sets(piece.column("text"), width)
                ids = [_identity(values[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(ids, pa.int64()),
                    pa.array(_own_sketches(bounds, values), pa.binary()),
                ], ["doc_id", "n", "id", "sketch"])
    return run


def signatures(bounds: np.ndarray, values: np.ndarray, percent: int, frequent: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of every set, own band and the next. ``frequent`` is sorted."""
    rare = np.ones(len(values), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] != values
    sizes = np.diff(bounds)
    upper = bands(percent, int(sizes.max(initial=1)))
    own = np.searchsorted(upper, sizes)
    owners, sigs = [], []
    with np.errstate(over="ignore"):
        for step in (0, 1):
            band = own + step
            g = groups(upper[band], percent) * (sizes > 0)
            base = np.concatenate([[0], np.cumsum(g * PARTS)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            live = g[owner] > 0
            owner, element = owner[live], mix(values[live] ^ mix(band[owner[live]].astype(np.uint64) + np.uint64(0x51ED)))
            part = base[owner] + (element >> np.uint64(11)) % (g[owner] * PARTS).astype(np.uint64)
            part = part.astype(np.int64)
            own_rare = rare[live]
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, part, mix(element + np.uint64(0x7F4A7C15)))
            held = np.bincount(part[own_rare], minlength=base[-1]).reshape(-1, PARTS)
            sums = sums.reshape(-1, PARTS)
            whom = np.repeat(np.arange(len(sizes)), g)
            number = np.arange(len(whom)) - np.repeat(np.cumsum(g) - g, g)
            weak = held.sum(1, keepdims=True) == held
            loose = np.bincount(whom, weights=weak.any(1), minlength=len(sizes)) > extra(allowed(upper[band], upper[band], percent))
            for out in range(PARTS):
                tag = mix(((band[whom] * 1_000_003 + number) * PARTS + out).astype(np.uint64))
                use = ~weak[:, out] | loose[whom]
                owners.append(whom[use])
                sigs.append(mix(sums[use].sum(1) - sums[use, out] + tag[use]))
    return np.concatenate(owners), np.concatenate(sigs)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A column of numbers as bytes, a row per batch."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], ["shingles"])


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(piece.column("text"), width)[1].view(np.int64))], ["shingle"])
    return run


def _by_bucket(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """(whose, signature) as blobs of one bucket each, of at most ``BLOB_MOST`` signatures."""
    whose, sig = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    whose, sig, bucket = whose[order], sig[order], bucket[order]
    first = np.searchsorted(bucket, bucket)
    starts = np.flatnonzero((np.arange(len(bucket)) - first) % BLOB_MOST == 0)
    ends = np.append(starts[1:], len(bucket))
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[starts], pa.int64()),
        pa.array([sig[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        pa.array([whose[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
    ], ["bucket", "sigs", "ids"])


def _blobs(width: int, percent: int, buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        frequent, held = shared.value, []
        for batch in batches:
            for piece in slices(batch, size=PIECE):
                bounds, values = shingle_sets(piece.column("text"), width)
                keep, ids = [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if b > a and (own := _identity(values[a:b])) not in seen:
                        seen.add(own)
                        keep.append(i)
                        ids.append(own)
                if not keep:
                    continue
                chosen = np.zeros(len(bounds) - 1, bool)
                chosen[keep] = True
                sizes = np.diff(bounds)
                owner, sig = signatures(np.concatenate([[0], np.cumsum(sizes[keep])]), values[np.repeat(chosen, sizes)], percent, frequent)
                if len(sig) == 0:
                    continue
                held.append((np.array(ids, np.int64)[owner], sig))
                if sum(len(x) for _, x in held) >= BLOB_LEAST * buckets:
                    yield _by_bucket(held, buckets)
                    held = []
        if held:
            yield _by_bucket(held, buckets)
    return run


def _sharers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (kind 1) of signatures with few sharers; (signature, sharer) rows (kind 2) of the others."""
    sigs, ids = [], []
    for batch in batches:
        sigs += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("sigs")]
        ids += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("ids")]
    if not sigs:
        return
    sig, own = np.concatenate(sigs), np.concatenate(ids)
    del sigs, ids, batch
    # sorted by portions: sharers of a signature are in one, and what a portion needs beside its rows is gone before the next
    portion = (sig >> np.uint64(61)).astype(np.uint8)
    for n in range(8):
        here = portion == n
        if here.any():
            yield from _sharing(sig[here], own[here])


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_sharers`` of one bucket after the other; the rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        starts = np.flatnonzero(np.concatenate([[len(bucket) > 0], bucket[1:] != bucket[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=False):
            if bucket[a] != now:
                yield from _sharers(iter(held))
                now, held = bucket[a], []
            held.append(batch.slice(a, b - a))
    yield from _sharers(iter(held))


def _sharing(sig: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    again = np.concatenate([[False], (sig[1:] == sig[:-1]) & (own[1:] == own[:-1])])
    sig, own = sig[~again], own[~again]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(starts, len(sig)))
    edges = []
    for n in range(2, SMALL + 1):
        first = starts[size == n]
        edges += [np.stack([own[first + i], own[first + j], np.ones(len(first), np.int64)], 1) for i in range(n) for j in range(i + 1, n)]
    pairs = np.concatenate(edges)
    pairs[:, :2].sort(axis=1)
    many = np.repeat(size > SMALL, size)
    rows = np.concatenate([np.unique(pairs, axis=0), np.stack([sig[many].view(np.int64), own[many], np.full(int(many.sum()), 2)], 1)])
    for at in range(0, len(rows), 100_000):
        part = rows[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(part[:, 2])], ["a", "b", "kind"])


def _near(percent: int):
    """Pairs whose sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(batch.num_rows, np.int64)
            for i, pair in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                one, two = (np.frombuffer(x, np.uint64) for x in pair)
                length = min(len(one), len(two))
                apart[i] = np.bitwise_count(_folded(one, length) ^ _folded(two, length)).sum()
            close = apart <= allowed(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield batch.select([0, 1]).filter(pa.array(close))
    return run


def _spots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, places) of document numbers in the map."""
    with np.errstate(over="ignore"):
        first = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0xD0C))
        places = np.stack([first, mix(first)]) >> np.uint64(8)
    return (first % np.uint64(MAP_PARTS)).astype(np.int64), (places % np.uint64(MAP_BITS // MAP_PARTS)).astype(np.int64)


def _marked(group: pa.Table) -> pa.Table:
    bits = np.zeros(MAP_BITS // MAP_PARTS, bool)
    bits[_spots(group["doc_id"].to_numpy())[1].ravel()] = True
    return pa.table({"part": group["part"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_spots(batch.column(0).to_numpy())[0]), batch.column(0)], ["part", "doc_id"])


def near_forest(ids: np.ndarray, sizes: np.ndarray, drawn: np.ndarray, side: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect whatever sketches allow to link; with ``across``, only pairs from side 0 to side 1 count."""
    order = np.argsort(sizes, kind="stable")
    ids, sizes, drawn, side = ids[order], sizes[order], drawn[order], side[order]
    label, out = np.arange(len(ids)), []
    for i in range(len(ids)):
        to = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        open_ = np.flatnonzero(label[i + 1:to] != label[i]) + i + 1
        if across:
            open_ = open_[side[open_] != side[i]]
        if len(open_) == 0:
            continue
        near = open_[np.bitwise_count(drawn[open_] ^ drawn[i]).sum(1) <= allowed(sizes[i], sizes[open_], percent)]
        others, first = np.unique(label[near], return_index=True)
        out += [(int(ids[i]), int(ids[j])) for j in near[first]]
        label[np.isin(label, others)] = label[i]
    return out


def _group_forest(percent: int):
    """Forests of groups whose rows (sig, i, j, piece, id, n, sketch) follow one another."""
    def links(key: tuple, rows: list) -> list[tuple[int, int]]:
        pieces, ids, sizes, drawn = zip(*rows, strict=True)
        words = [np.frombuffer(x, np.uint64) for x in drawn]
        length = min(map(len, words))
        side = np.array(pieces) - key[1]
        return near_forest(np.array(ids), np.array(sizes), np.stack([_folded(w, length) for w in words]), side, key[1] != key[2], percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out = []
            for sig, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sig, i, j) != key:
                    out += links(key, rows) if rows else []
                    key, rows = (sig, i, j), []
                rows.append(row)
            yield _edges(out)
        yield _edges(links(key, rows) if rows else [])
    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows with ``pieces`` and ``id``, repeated for every tile (i, j) that their piece is a side of."""
    return (
        rows.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumns({"i": F.least("piece", "other"), "j": F.greatest("piece", "other")}).drop("other", "pieces")
    )


def _sets(width: int, shared):
    """(id, elements) of the documents in the map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            part, places = _spots(batch.column("doc_id").to_numpy())
            hit = np.zeros(batch.num_rows, bool)
            for p, bits in marks.items():
                own = np.flatnonzero(part == p)
                hit[own] = ((bits[places[:, own] >> 3] >> (7 - (places[:, own] & 7)).astype(np.uint8)) & 1 == 1).all(0)
            for piece in slices(batch.filter(pa.array(hit)), size=PIECE):
                bounds, values = shingle_sets(piece.column("text"), width)
                sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([_identity(v) for v in sets], pa.int64()), pa.array([v.tobytes() for v in sets], pa.binary())], ["id", "elements"])
    return run


def forest(ids: list, sets: list[np.ndarray], side: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected; with ``across``, only pairs from side 0 to side 1 are compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, side = sizes[order], side[order]
    drawn = sketches(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([sets[i] for i in order]), min(1 << 14, sketch_bits(sizes[-1])))
    parent = np.arange(len(order))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(order)):
        to = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        apart = np.bitwise_count(drawn[i + 1:to] ^ drawn[i]).sum(1)
        near = apart <= allowed(sizes[i], sizes[i + 1:to], percent)
        if across:
            near &= side[i + 1:to] != side[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if find(i) == find(j):
                continue
            common = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                parent[find(j)] = find(i)
                out.append((int(ids[order[i]]), int(ids[order[j]])))
    return out


def _tile(percent: int):
    def run(block: pa.Table) -> pa.Table:
        one, two = block["i"][0].as_py(), block["j"][0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["elements"]]
        links = forest(block["id"].to_pylist(), sets, block["piece"].to_numpy() - one, one != two, percent)
        return pa.Table.from_batches([_edges(links)])
    return run


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, reducer_entries: int = REDUCER_ENTRIES) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    members = cut(texts.mapInArrow(_members(width), "doc_id long, n long, id long, sketch binary"), "join-members")
    nodes = members.filter("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))

    shingles = members.agg(F.sum("n")).first()[0] or 0
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(shingles // SAMPLE_SHINGLES + 1)) == 0)
    drawn = sample.mapInArrow(_shingles(width), "shingle long").groupBy("shingle").count()
    packed = drawn.filter(F.col("count") >= FREQUENT).select("shingle").mapInArrow(_packed, "shingles binary").collect()
    shared = spark.sparkContext.broadcast(np.sort(np.concatenate([NONE, *(np.frombuffer(r["shingles"], np.uint64) for r in packed)])))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles * 6 // 10 // reducer_entries + 1)
    candidates = cut(
        texts.mapInArrow(_blobs(width, percent, parts * BUCKETS, shared), "bucket long, sigs binary, ids binary")
        .repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_each_bucket, "a long, b long, kind long")
        .distinct(), "join-candidates"
    )
    shared.destroy()
    pairs = candidates.filter("kind = 1").select("a", "b")
    shared_by = candidates.filter("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("id"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(shared_by.select("id")).distinct()
    drawn = members.filter("id IS NOT NULL").select("id", "n", "sketch")
    drawn = cut(drawn.join(ends, "id", "left_semi").groupBy("id").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch")), "join-sketches")
    one, two = (drawn.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    tested = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(percent), "a long, b long")
    pieces = shared_by.groupBy("sig").agg((F.count("*") / GROUP + 1).cast("int").alias("pieces"))
    grouped = _tiled(shared_by.join(pieces, "sig").join(drawn, "id")).select("sig", "i", "j", "piece", "id", "n", "sketch")
    grouped = grouped.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    edges = tested.unionByName(grouped.mapInArrow(_group_forest(percent), "a long, b long"))
    blocks = components(edges, "join-blocks").withColumnsRenamed({"node": "id"})
    sized = cut(blocks.join(nodes, "id"), "join-sized")
    pieces = sized.groupBy("root").agg(F.expr(f"CAST(sum(8 * n) DIV {TILE_BYTES} + 1 AS INT)").alias("pieces"))
    active = cut(sized.join(pieces, "root").select("id", "root", "pieces", F.col("rep").alias("doc_id")), "join-active")
    marks = active.select("doc_id").mapInArrow(_numbered, "part long, doc_id long").groupBy("part").applyInArrow(_marked, "part long, bits binary").collect()
    wanted = spark.sparkContext.broadcast({r["part"]: np.frombuffer(r["bits"], np.uint8) for r in marks})
    again = texts.filter("doc_id IS NOT NULL").mapInArrow(_sets(width, wanted), "id long, elements binary")
    sets = again.join(active.select("id", "root", "pieces"), "id")
    links = _tiled(sets).groupBy("root", "i", "j").applyInArrow(_tile(percent), "a long, b long")
    linked = components(links, "join-links").withColumnsRenamed({"node": "id"})
    wanted.destroy()
    named = cut(linked.join(nodes.select("id", "rep"), "id"), "join-named")
    smallest = named.select("id", "root").join(named.groupBy("root").agg(F.min("rep").alias("least")), "root").select("id", "least")
    return cut(
        members.join(nodes.select("id", "rep"), "id", "left").join(smallest, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "rep", "doc_id").alias("component_id")), "join-result"
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that have the smallest doc_id of their component, with all columns.

    Rows of one doc_id are one document, which goes when any of them belongs to an earlier one; equal rows of it become one.
    Texts without words and rows without doc_id stay.
    """
    joined = join(docs, width, percent)
    later = cut(joined.filter("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "join-later")
    often = cut(joined.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1 AND _id IS NOT NULL").select("_id"), "join-often")
    first = docs.join(later, F.col("doc_id") == F.col("_id"), "left_anti")
    return first.join(often, F.col("doc_id") == F.col("_id"), "left_anti").unionByName(first.join(often, F.col("doc_id") == F.col("_id"), "left_semi").distinct())
