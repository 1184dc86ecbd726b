"""Token files and WARC bundles: exact round trips."""

import hashlib
import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from khata.lineage import checkpoint_folder
from khata.llm import token_files, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
HARD = ["<|endoftext|> a<|startoftext|>b <| x", "don't we'll I'M", "é ́a ΑΣ ΣΑ. İstanbul", "a b c　d\x85e\x1cf", "$$$###  \n\n x", "ﬁ １２３ ²", "\U0001f600 ok"]


def whole(text):
    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [2]


def test_word_coder_equals_whole_texts(odd):
    texts = [r.text for r in odd.collect()] + HARD
    coder = token_files.WordCoder(VOCABULARY)
    for _ in range(2):
        got = coder(pa.array(["cut off", *texts]).slice(1))
        assert [np.frombuffer(x, np.int32).tolist() for x in got] == [whole(t) for t in texts]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_round_trip(spark, odd, encoding):
    docs = odd.unionByName(spark.createDataFrame([(100 - i, t) for i, t in enumerate(HARD)], "doc_id long, text string"), allowMissingColumns=True)
    folder = token_files.write(docs, VOCABULARY, encoding=encoding, page_rows=2)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc, text in rows:
        ids = whole(text)
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in token_files.digests(spark, folder).collect()), key=str) == sorted(want, key=str)
    lists = {r.start: r.ids for r in token_files.read(spark, folder).collect()}
    assert [t for k in sorted(lists) for t in lists[k]] == [t for _, text in rows for t in whole(text)]
    files = [f"{folder}/{f}" for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]
    metas = [pq.ParquetFile(f).metadata.row_group(0) for f in files if pq.ParquetFile(f).metadata.num_rows]
    found = set()
    for meta in metas:
        columns = {meta.column(i).path_in_schema.split(".")[0]: meta.column(i) for i in range(meta.num_columns)}
        assert columns["ids"].has_offset_index and columns["doc_id"].has_column_index
        found |= set(columns["ids"].encodings)
    # short chunks are written without a dictionary even where it is allowed
    assert ("RLE_DICTIONARY" in found) == (encoding == "dictionary") and "DELTA_BINARY_PACKED" in found


def test_metadata_reads_leave_ids_alone(spark, odd):
    folder = token_files.write(odd, VOCABULARY)
    plan = token_files.starts(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema", 1)[1].split("\n")[0]


def test_empty_tables(spark, none):
    assert token_files.digests(spark, token_files.write(none, VOCABULARY)).collect() == []
    pages = none.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    folder, index = warc.write(pages)
    assert warc.read(spark, folder, index).collect() == []


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same page " * 40
    rows = [(5, "http://a/1", big), (3, "http://b/2\r\nX: y", big), (3, "http://b/2", big), (9, None, big), (None, "http://n", big),
            (1, "http://e", None), (2, "http://e2", ""), (4, "http://s", "short"), (6, "http://s2", "short"), (7, "http://é", "é" * 60), (8, "http://l", "x\r\n\r\n" * 200_000)]
    rows += [(100 + i, f"http://m/{i}", f"<html>{i % 17}" + "y" * 150) for i in range(300)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, payload string")


def expected(rows):
    first = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 100 and r.page_id is not None:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        ref = first.get(body)
        ref = None if ref == r.page_id else ref
        out.append((r.page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_archives_hold_every_page(spark, pages):
    folder, index = warc.write(pages, frame_bytes=2000, bundle_bytes=3000)
    assert sorted((tuple(r) for r in warc.read(spark, folder, index).collect()), key=str) == expected(pages.collect())


def test_bundles_are_plain_and_seekable_zstandard(spark, pages):
    folder, index = warc.write(pages, frame_bytes=2000, bundle_bytes=3000)
    rows = index.collect()
    for name in {r.bundle for r in rows}:
        data = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
        table = warc.read_seek_table(data)
        assert struct.unpack("<I", data[sum(f[0] for f in table):][:4])[0] == 0x184D2A5E
        frames, at = [], 0
        for packed, size, checksum in table:
            raw = zstandard.ZstdDecompressor().decompress(data[at:at + packed])
            assert len(raw) == size and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF == checksum
            frames.append((at, raw))
            at += packed
        streamed = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert streamed == b"".join(raw for _, raw in frames)
        for r in rows:
            if r.bundle == name:
                place, raw = frames[r.frame_no]
                assert place == r.frame_at and warc.parse(raw[r.record_at:r.record_at + r.record_size])["page_id"] == r.page_id


def test_no_files_outside_the_shared_folder(spark, pages):
    folder, _ = warc.write(pages)
    assert folder.startswith(checkpoint_folder(spark))
