"""What a task holds at once does not grow with the batches it is given."""

import pyarrow as pa
import pytest

from khata.llm import base, decontaminate, ngram_join, shingles


def texts(n=6_000, words=120):
    own = [" ".join(f"w{(i // 2 * 31 + k * k) % 99_991}" for k in range(words - i % 2)) for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(own)], ["doc_id", "text"])


@pytest.mark.parametrize("step", ["members", "blobs", "numbers"])
def test_texts_are_taken_in_pieces(monkeypatch, step):
    most = []
    told = lambda f: lambda x, *rest: (most.append(x.nbytes), f(x, *rest))[1]
    monkeypatch.setattr(ngram_join, "shingle_sets", told(shingles.shingle_sets))
    monkeypatch.setattr(decontaminate, "normal_words", told(decontaminate.normal_words))

    class Nothing:
        value = ngram_join.NONE

    bench = decontaminate.Benchmark([], [], [], {"w1": 0})
    run = {"members": ngram_join._members(5), "blobs": ngram_join._blobs(5, 80, 4, Nothing), "numbers": decontaminate._numbers(bench)}[step]
    rows = sum(b.num_rows for b in run(iter([texts()])))
    assert rows == 6_000 or step == "blobs"
    assert max(most) <= 2.2 * (1 << 20) and sum(most) >= 4_000_000


def test_operators_ask_for_small_batches(spark, odd):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for n, want in (("10000", base.BATCH_ROWS), ("0", base.BATCH_ROWS), ("500", 500)):
            spark.conf.set(name, n)
            ngram_join.join(odd)
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)


def test_sharers_hold_one_bucket(monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", 1 << 16)
    held, real = [], ngram_join._sharers

    class Nothing:
        value = ngram_join.NONE

    def told(batches):
        held.append(pa.Table.from_batches(own) if (own := list(batches)) else None)
        return real(iter(own))

    blobs = pa.Table.from_batches(list(ngram_join._blobs(5, 80, 64, Nothing)(iter([texts(3_000)]))))
    assert max(len(x.as_py()) for x in blobs["sigs"]) <= 8 * 512
    blobs = blobs.sort_by("bucket")
    rows = lambda out: {r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = rows(real(iter(blobs.to_batches())))
    monkeypatch.setattr(ngram_join, "_sharers", told)
    assert rows(ngram_join._each_bucket(iter(blobs.to_batches(100)))) == want
    held = [t for t in held if t is not None]
    assert len(held) == len(set(blobs["bucket"].to_pylist())) == 64 and all(len(set(t["bucket"].to_pylist())) == 1 for t in held)
    assert sum(t.num_rows for t in held) == blobs.num_rows
