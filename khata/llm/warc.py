"""WARC archives as seekable Zstandard bundles, with an index from records to frames.

Each task writes its records into bundles of its own. Records are grouped into independent frames of about ``frame_bytes``; a
bundle of about ``bundle_bytes`` ends with the seek table of the seekable Zstandard format (sizes and checksum of each frame in a
skippable frame). The index has, per record, the bundle, the frame's place and size, and the record's place within the frame,
so a record costs one ranged read of one frame. Bundle names are unique per attempt and the index, written by Spark, names only
those of attempts that ended well, so a lost executor leaves at most files that nothing refers to.

Equal payloads of ``REVISIT_BYTES`` or more are stored once: the smallest page_id is the response, the others are revisits that
refer to it and keep the payload's digest and length.

Cases: null html is an empty payload; null urls are written as empty; a null page_id is never referred to, and is a response
unless another page holds its payload; repeated rows of the smallest page_id are all responses; an empty table writes no bundle;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.lineage import checkpoint_folder, cut

REVISIT_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 256 << 20, 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed value: profile of a revisit whose payload is the same.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame_no int, frame_at long, frame_size int, record_at int, record_size int"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose HTTP head still states the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, record_type, payload_digest, payload_bytes, refers_to and payload (None in a revisit) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    page = lambda urn: None if urn in (None, _urn(None)) else int(urn[len("<urn:x-page:"):-1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": stated,
        "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """Skippable frame with (compressed size, size, checksum) of every frame."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), WITH_CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
        raise ValueError("no seek table")
    return [struct.unpack_from("<III", data, len(data) - 9 - 12 * (count - i)) for i in range(count)]


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class Bundle:
    """A bundle being written."""

    def __init__(self, folder: str, level: int) -> None:
        self.store, path = open_store(folder)
        self.store.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.coder, self.size, self.frames = zstandard.ZstdCompressor(level=level), 0, []

    def add(self, records: list[bytes]) -> tuple[int, int, int]:
        """(number, place, size) of the new frame."""
        raw = b"".join(records)
        packed = self.coder.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)
        return len(self.frames) - 1, self.size - len(packed), len(packed)

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, ids, waiting, held = None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal bundle, ids, waiting, held
            bundle = bundle or Bundle(folder, level)
            number, at, size = bundle.add(waiting)
            places, rows = 0, []
            for page, raw in zip(ids, waiting, strict=True):
                rows.append((page, bundle.name, number, at, size, places, len(raw)))
                places += len(raw)
            ids, waiting, held = [], [], 0
            if bundle.size >= bundle_bytes:
                bundle.close()
                bundle = None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), INDEX_TYPES, strict=True)], INDEX_NAMES)

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                ids.append(page)
                waiting.append(record(page, url, payload, digest, refers))
                held += len(waiting[-1])
                if held >= frame_bytes:
                    yield flush()
        if waiting:
            yield flush()
        if bundle:
            bundle.close()
    return run


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the response's page_id, null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = (
        pages.select("page_id", payload.alias("payload")).filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    )
    return rows.join(cut(shared, "warc-shared"), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> tuple[str, DataFrame]:
    """Write bundles and return their folder and the index (columns of ``INDEX``)."""
    folder = folder or f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = captures(pages).mapInArrow(_writer(folder, frame_bytes, bundle_bytes, level), INDEX)
    return folder, cut(index, "warc-index")


PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        opened, name, at, frame = None, None, None, b""
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["bundle"] != name:
                    opened = store.open_input_file(f"{root}/{x['bundle']}")
                    name, at = x["bundle"], None
                if x["frame_at"] != at:
                    at = x["frame_at"]
                    frame = zstandard.ZstdDecompressor().decompress(opened.read_at(x["frame_size"], at))
                got = parse(frame[x["record_at"]:x["record_at"] + x["record_size"]])
                if got["page_id"] != x["page_id"]:
                    raise ValueError(f"index points at another record than {x['page_id']}")
                rows.append(got)
            yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k != "payload"} for r in rows], schema=PARSED_SCHEMA)
    return run


PARSED_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """What the archives hold for every index row, each frame read once by one task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(parts, "bundle", "frame_no").sortWithinPartitions("bundle", "frame_no", "record_at").mapInArrow(_reader(folder), PARSED)
