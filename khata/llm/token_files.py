"""Token ids of whole texts as Parquet list columns, laid out for selective reads.

Documents are dealt by ranges of doc_id and sorted, so files follow one another in ascending doc_id order (ties by text). A file
holds ``doc_id``, its ``part`` number, ``local_start`` (ids of the file before the document), ``n_tokens`` and the list ``ids``;
metadata reads touch none of the ids. Ids are dictionary coded, or delta coded with ``encoding="delta"``; row groups are cut at
``group_bytes`` and pages at ``page_rows`` rows, and each column has page indexes, so a filter on doc_id reads single pages.

Text is encoded word by word: the vocabulary's splitting never crosses a blank, so the ids of a text are those of its words
in a row. A worker keeps the ids of words that it has met, up to ``CACHED_WORDS``, then starts anew.

Cases: null and empty texts are the end id alone; a null doc_id comes first; repeated rows are written as often as they occur;
an empty table gives no rows and no files; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.lineage import checkpoint_folder
from khata.llm.shingles import slices

END = 2
CACHED_WORDS = 1_000_000
#: ASCII and Latin-1 letters, then any ASCII marks but the apostrophe, which the splitting treats apart.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
GROUP_BYTES, PAGE_ROWS = 8 << 20, 256
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def word_table(path: str) -> dict[str, bytes]:
    """Words that this worker has encoded; it lasts from task to task."""
    return {}


class WordCoder:
    """Ids of texts as little-endian 32-bit bytes, through a bounded table of words."""

    def __init__(self, path: str, end: int = END) -> None:
        self.coder, self.known, self.end = tokenizer(path), word_table(path), np.int32(end).tobytes()
        special = self.coder.get_added_tokens_decoder()
        self.mark, self.marks = next(((i, t.content) for i, t in sorted(special.items()) if not t.normalized and not (t.lstrip or t.rstrip or t.single_word)), (None, ""))

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of each word, encoded some thousand at a time with an added token between them where the vocabulary has one."""
        if self.mark is None or any(self.marks[:2] in w for w in words):
            return [np.array(e.ids, np.int32).tobytes() for e in self.coder.encode_batch(words, add_special_tokens=False)]
        out = []
        for at in range(0, len(words), 4000):
            ids = np.array(self.coder.encode(self.marks.join(words[at:at + 4000]), add_special_tokens=False).ids, np.int32)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            out += [ids[a + 1:b].tobytes() for a, b in zip([-1, *ends[:-1]], ends, strict=True)]
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        # taken anew: Arrow's text kernels misread arrays whose first offset is not zero
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts)))))
        bounds = split.offsets.to_numpy()
        words = split.values.dictionary_encode()
        own = self.all_of(words.dictionary)
        at = words.indices.to_numpy()
        return [b"".join(own[at[a:b]].tolist()) + self.end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def all_of(self, words: pa.Array) -> np.ndarray:
        """Ids of distinct words. A plain word is its letters in lower case, then its marks: the splitting parts them anyway."""
        found = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(found).to_numpy(zero_copy_only=False)
        out = np.empty(len(words), object)
        if plain.any():
            found = found.filter(pa.array(plain))
            letters, marks = pc.utf8_lower(found.field("letters")).dictionary_encode(), found.field("marks").dictionary_encode()
            out[plain] = self.looked_up(letters.dictionary)[letters.indices.to_numpy()] + self.looked_up(marks.dictionary)[marks.indices.to_numpy()]
        if not plain.all():
            out[~plain] = self.looked_up(words.filter(pa.array(~plain)))
        return out

    def looked_up(self, parts: pa.Array) -> np.ndarray:
        names = parts.to_pylist()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        fresh = [w for w in names if w not in self.known]
        odd = [w for w in fresh if not w or self.marks[:2] in w]
        simple = fresh if not odd else [w for w in fresh if w and self.marks[:2] not in w]
        for some in (simple, odd):
            if some:
                self.known.update(zip(some, self.fresh(some), strict=True))
        out = np.empty(len(names), object)
        out[:] = [self.known[w] for w in names]
        return out


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, start, part = WordCoder(path, end), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch):
                coded = coder(piece.column("text"))
                lengths = np.array([len(x) // 4 for x in coded], np.int64)
                ends = np.cumsum(lengths)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(np.full(len(coded), part, np.int32)), pa.array(start + ends - lengths), pa.array(lengths), ids],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1]) if len(ends) else 0
    return run


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = END, encoding: str = "dictionary", group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> str:
    """Encode ``docs`` (doc_id, text) into Parquet files and return their folder."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/token-files-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(vocabulary, end), SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows).option("compression", "zstd")
        .parquet(folder)
    )
    return folder


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.names.index("ids"))
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.names.index("doc_id")), batch.column(batch.schema.names.index("part")),
            batch.column(batch.schema.names.index("local_start")), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64()),
        ], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """part and the number of ids in all files before it, from metadata columns alone; one row per file."""
    from pyspark.sql import Window

    sums = spark.read.schema(SCHEMA).parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    return rows.join(starts(spark, folder), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, all from the files."""
    rows = spark.read.schema(SCHEMA).parquet(folder).select("doc_id", "part", "local_start", "ids")
    found = rows.mapInArrow(_digests, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return found.join(starts(spark, folder), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
