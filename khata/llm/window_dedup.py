"""Repeated word windows across documents, by super-k-mer partitioning.

1. Every ``WIDTH``-word window has a minimiser: the least hash of its ``SEED``-word grams. Consecutive windows of a document with one
   minimiser, a super-k-mer, travel as one string of their words to the bucket of the minimiser, so equal windows meet and a word
   travels about three times instead of thirteen.
2. Before that, windows are grouped in each piece of about ``PIECE`` bytes of text: only those of the smallest document travel,
   the other holders are known to lose them. A passage of very many documents is sent once per piece.
3. Minimisers with more than a small share of all windows (boilerplate around differing words) are found on a sample; their windows go to
   the bucket of their own hash. The sample only decides the way a window takes: the result is the same for any list.
4. A bucket sorts its windows by hash, compares them word by word, and reports for every document the runs of windows that also
   start in a smaller one. Messages are one compressed blob per piece and bucket, and the number of buckets follows the bytes of text,
   so a bucket has about ``BUCKET`` bytes of words whatever the input.
5. Runs come back to their document by doc_id and 32 bits of its text's hash, which tell rows of one id apart; the words they cover are dropped and the rest is digested.

Cases: a null or empty text has no words; a text of fewer than ``WIDTH`` words has no window; rows with a null id keep all words and take
none from others; rows of one id never take words from each other; repeated rows count once and are each returned; a window met
twice in one document is no repeat. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.exact_words import equal_windows, window_hashes, word_codes
from khata.llm.shingles import mix, slices

WIDTH, SEED = 13, 3
PIECE, BUCKET = 4 << 20, 8 << 20
#: About how many bytes of text the sample holds, and how many messages of a piece go to one task.
SAMPLE, SPREAD = 32 << 20, 2
#: How many times the words of a text travel.
TRAVEL = 3

RUNS = "doc_id long, mark long, start long, n long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def least_in_reach(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` consecutive values."""
    have, out = 1, values
    while have < reach:
        step = min(have, reach - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Windows:
    """The windows of one piece: their words, hashes, minimisers and documents."""

    def __init__(self, texts: pa.Array, docs: np.ndarray, width: int):
        bounds, self.codes, word = word_codes(texts)
        self.values = word[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.width = width
        counts = np.maximum(np.diff(bounds) - width + 1, 0)
        ends = np.cumsum(counts)
        self.row = np.repeat(np.arange(len(docs)), counts)
        self.start = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        self.at = self.start + bounds[:-1][self.row]
        self.hash = mix(window_hashes(self.values, width))[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.doc = docs[self.row]

    def minimisers(self, seed: int) -> np.ndarray:
        grams = mix(window_hashes(self.values, seed))
        return least_in_reach(grams, self.width - seed + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def repeated(self) -> np.ndarray:
        """Whether a window is also in a smaller document of the piece."""
        order, group = equal_windows(self.hash, self.codes, self.at, self.width)
        out = np.zeros(len(order), bool)
        if len(order):
            smallest = np.minimum.reduceat(self.doc[order], np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
            out[order] = self.doc[order] > smallest[group]
        return out


def runs(row: np.ndarray, start: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the longest stretches with one row and one label whose starts follow each other."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (label[1:] != label[:-1])
    first = np.flatnonzero(fresh)
    return first, np.diff(np.append(first, len(row)))


def _real(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Rows with an id, equal ones once, with their ids and text marks."""
    batch = batch.filter(pc.is_valid(batch.column("doc_id")))
    key = np.stack([batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()], 1)
    kept = np.sort(np.unique(key, axis=0, return_index=True)[1])
    return batch.take(pa.array(kept)), key[kept, 0], key[kept, 1]


def pack(docs: np.ndarray, *arrays: np.ndarray, words: list[bytes] = ()) -> bytes:
    """Ids as differences, 32-bit numbers and texts without line ends, one of each per entry, as one compressed blob."""
    parts = [np.array([len(docs)], np.int64), np.diff(docs, prepend=np.int64(0)), *(np.ascontiguousarray(a, np.uint32) for a in arrays)]
    return zstandard.compress(b"".join(x.tobytes() for x in parts) + b"\n".join(words), 3)


def unpack(blob: bytes, numbers: int) -> tuple[list[np.ndarray], bytes]:
    """([ids, then that many arrays of numbers], the texts as one)."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out = [np.cumsum(np.frombuffer(raw, np.int64, n, 8))]
    out += [np.frombuffer(raw, np.uint32, n, 8 + 8 * n + 4 * n * k).astype(np.int64) for k in range(numbers)]
    return out, raw[8 + 8 * n + 4 * n * numbers:]


MESSAGE = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _super_kmers(parts: int, hot: np.ndarray, width: int, seed: int):
    """Messages of a task: super-k-mers (kind 0) for their bucket, and runs that are settled in the piece (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=PIECE):
                piece, docs, marks = _real(piece)
                own = Windows(piece.column("text"), docs, width)
                lost, least = own.repeated(), own.minimisers(seed)
                label = np.where(np.isin(least, hot), own.hash, least)
                out: list[tuple[int, int, bytes]] = []
                first, length = runs(own.row[lost], own.start[lost], np.zeros(int(lost.sum()), np.int64))
                if len(first):
                    row = own.row[lost][first]
                    out.append((int(mix(docs[:1].astype(np.uint64))[0] % np.uint64(parts)), 1, pack(docs[row], marks[row], own.start[lost][first], length)))
                sent = np.flatnonzero(~lost)
                first, length = runs(own.row[sent], own.start[sent], label[sent])
                begin = sent[first]
                # the piece's words with one blank between them; from[i] is where word i begins
                text = b" ".join(filter(None, (b" ".join((t or b"").split()) for t in piece.column("text").cast(pa.binary()).to_pylist())))
                blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                froms = np.concatenate([[0], blanks + 1, [len(text) + 1]])
                a, b = froms[own.at[begin]], froms[own.at[begin] + length + width - 1] - 1
                part = (mix(label[begin]) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(order) else []
                for at in np.split(order, edges[1:]) if len(order) else []:
                    row = own.row[begin[at]]
                    texts = [text[x:y] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]
                    out.append((int(part[at[0]]), 0, pack(docs[row], marks[row], own.start[begin[at]], words=texts)))
                yield pa.RecordBatch.from_pylist([dict(zip(MESSAGE.names, r, strict=True)) for r in out], schema=MESSAGE)
    return run


def _counts(width: int, seed: int):
    """How many super-k-mers each minimiser has, for those met more than once in a piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=PIECE):
                piece, docs, _ = _real(piece)
                own = Windows(piece.column("text"), docs, width)
                sent = np.flatnonzero(~own.repeated())
                least = own.minimisers(seed)[sent]
                first, _ = runs(own.row[sent], own.start[sent], least)
                least, n = np.unique(least[first], return_counts=True)
                many = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.append(least[many].view(np.int64), 0)), pa.array(np.append(n[many], 0)), pa.array(np.append(np.zeros(int(many.sum()), np.int64), n.sum()))], ["least", "n", "total"])
    return run


def _judge(width: int):
    """Runs of windows that also start in a smaller document, from all messages of a task's buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, marks, starts, texts = [], [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(blob, 3)[0]], ["doc_id", "mark", "start", "n"])
                    continue
                (doc, mark, start), words = unpack(blob, 2)
                docs.append(doc), marks.append(mark), starts.append(start)
                texts.append(words)
        if not docs:
            return
        doc, mark, start = np.concatenate(docs), np.concatenate(marks), np.concatenate(starts)
        column = pa.array([b"\n".join(texts)], pa.large_binary()).cast(pa.large_string())
        del texts
        own = Windows(pc.split_pattern(column, "\n").values, doc, width)
        lost = np.flatnonzero(own.repeated())
        first, length = runs(own.row[lost], own.start[lost], np.zeros(len(lost), np.int64))
        row, begin = own.row[lost[first]], own.start[lost[first]]
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(mark[row]), pa.array(start[row] + begin), pa.array(length)], ["doc_id", "mark", "start", "n"])
    return run


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs"), strict=True):
                words, found = zstandard.decompress(text.as_py()).split(), found.as_py()
                kept, removed = words, 0
                if found:
                    cover = np.zeros(len(words) + 1, np.int64)
                    at = np.array([(r["start"], r["start"] + r["n"] + width - 1) for r in found], np.int64)
                    np.add.at(cover, at[:, 0], 1)
                    np.add.at(cover, at[:, 1], -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed = int(gone.sum())
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                out.append((doc, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def text_mark() -> Column:
    """Tells the rows of one doc_id apart: 32 bits of the hash of their text."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way through the shuffle."""
    shrink = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        texts = pa.array([shrink(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), texts], ["doc_id", "mark", "text"])


def frequent(docs: DataFrame, size: int, buckets: int, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Minimisers with more than a quarter of a bucket's share of the super-k-mers in about ``SAMPLE`` bytes of whole documents; at most 4 per bucket."""
    share = min(1.0, SAMPLE / max(size, 1))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    counts = sample.mapInArrow(_counts(width, seed), "least long, n long, total long")
    total = counts.agg(F.sum("total")).first()[0] or 0
    least = max(16, total // (4 * buckets))
    many = counts.groupBy("least").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()
    return np.array([r["least"] for r in many], np.int64).view(np.uint64)


def repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, start, n): stretches of n window starts whose windows also start in a document with a smaller id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", text_mark())
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-TRAVEL * size // BUCKET))
    hot = frequent(own, size, buckets, width, seed)
    sent = own.mapInArrow(_super_kmers(SPREAD * buckets, hot, width, seed), "part long, kind int, blob binary")
    return sent.repartition(buckets, "part").mapInArrow(_judge(width), RUNS)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document without the words of windows that a smaller document holds."""
    found = repeats(docs, width).groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", text_mark()).mapInArrow(_compressed, "doc_id long, mark long, text binary")
    whole = own.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    return whole.select("doc_id", "text", "runs").mapInArrow(_kept(width), RESULT)
