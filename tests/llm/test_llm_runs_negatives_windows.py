"""Periodic runs, hard negatives and repeated windows against plain models, on hostile rows and with tiny pieces, blocks and buckets."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from khata.llm import exact_words, hard_negatives, periodic_runs, recompression, window_dedup


def split(text):
    return (text or "").encode().split()


def digest(words):
    return hashlib.sha256(b" ".join(words)).hexdigest()


# --- periodic runs -------------------------------------------------------------------------------------------------------


def runs_of(words):
    """{(start, length): least period} by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def altered(doc_id, words):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_report(doc_id, text):
    words = altered(doc_id, split(text))
    found = runs_of(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(), digest([w for i, w in enumerate(words) if i not in gone]))


def repetitive(rng, n):
    words = [f"w{rng.randrange(rng.choice([1, 2, 40]))}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            s, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            for i in range(s, min(n, s + p * rng.randint(2, 6))):
                words[i] = words[s + (i - s) % p]
    return " ".join(words)


def test_runs_equal_a_search_of_every_period(spark):
    rng = random.Random(11)
    rows = [(i, repetitive(rng, rng.choice([0, 3, 23, 24, 25, 60, 150, 400]))) for i in range(300)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    got = periodic_runs.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(run_report(*r) for r in rows)


def test_runs_of_hostile_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in periodic_runs.report(odd.withColumn("start", F.lit("x"))).collect()), key=str)
    quick = [r for r in rows if len(split(r[1])) < 3000]
    assert set(map(run_report, *zip(*quick, strict=True))) <= set(got) and len(got) == len(rows)
    (long,) = [r for r in got if r[0] == 8]  # one word 30,000 times
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000) and long[7] == digest([b"word"])
    assert periodic_runs.report(none).count() == 0


def test_grids_in_small_parts_find_the_same(monkeypatch):
    rng = random.Random(5)
    docs = [np.array([hash(w) % 1000 for w in repetitive(rng, 300).split()], np.int64) for _ in range(12)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    whole = periodic_runs.runs(np.concatenate(docs), bounds)
    monkeypatch.setattr(periodic_runs, "GRID", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.runs(np.concatenate(docs), bounds), strict=True))


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_extensions_equal_a_scan(letters):
    rng = np.random.default_rng(letters)
    for _ in range(30):
        docs = [rng.integers(0, letters, rng.integers(1, 80)) for _ in range(3)]
        line = [letters]
        for k, d in enumerate(docs):
            line += [*d.tolist(), letters + 1 + k]
        levels = recompression.compress(np.array(line, np.int64), letters)
        places = [(x, y) for x in range(1, len(line) - 1) for y in range(x + 1, min(len(line) - 1, x + 40)) if not any(v >= letters for v in line[x:y + 1])]
        if not places:
            continue
        i, j = (np.array(v) for v in zip(*places, strict=True))
        ahead, behind = recompression.extend(levels, i, j), recompression.extend(levels, i, j, forward=False)
        for x, y, right, left in zip(i.tolist(), j.tolist(), ahead.tolist(), behind.tolist(), strict=True):
            n = 0
            while line[x + n] == line[y + n]:
                n += 1
            m = 0
            while line[x - 1 - m] == line[y - 1 - m]:
                m += 1
            assert (right, left) == (n, m)


def test_levels_shrink_fast():
    line = np.concatenate([[1000], np.random.default_rng(1).integers(0, 1000, 20_000), [1001]])
    levels = recompression.compress(line, 1000)
    assert len(levels[-1].symbol) == 3 and sum(len(x.symbol) for x in levels) < 8 * len(line)


# --- hard negatives ------------------------------------------------------------------------------------------------------


def negatives_of(rows):
    real = [(i, (n + 1) % 10 if i % 7 == 0 and n + 1 >= 0 else n, [math.floor(256 * x) for x in v]) for i, n, v in rows
            if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, n, v in real:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (n, v)), (n, v))
    out = []
    for a, (label, vector) in anchors.items():
        score = sorted({(-sum(x * y for x, y in zip(vector, v, strict=False)), i, n == label) for i, n, v in real if i != a})
        positives = list(dict.fromkeys((s, i) for s, i, same in score if same))[:5]
        for s, p in positives:
            inside = [(t, i) for t, i, same in score if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k, i, int(-s), int(-t)) for k, (t, i) in enumerate(inside, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string"


def vectors(n, seed, size=6):
    rng = random.Random(seed)
    pool = [[round(rng.uniform(-0.4, 1.0), 1) for _ in range(size)] for _ in range(40)]
    return [(i, rng.choice([0, 0, 0, 1, 2, 9]), rng.choice(pool)) for i in range(-60, n)]


@pytest.mark.parametrize("block_bytes", [32 << 20, 400])
def test_negatives_equal_a_full_sort(spark, block_bytes):
    rows = vectors(400, 3) + [
        (None, 1, [1.0] * 6), (500, None, [1.0] * 6), (501, 1, None), (550, 1, [1.0, None]), (600, 1, [float("nan")] * 6), (601, 1, [float("inf")] * 6),
        (650, 0, []), (700, 0, [0.5] * 9), (701, 0, [0.25] * 3), (750, 0, [0.0] * 6), (751, 1, [0.0] * 6),
        (100, 0, [0.5] * 6), (100, 0, [0.5] * 6), (100, 1, [0.75] * 6), (33, 0, [0.5] * 6), (33, 0, [0.5] * 6), (33, 2, [0.5] * 6),
    ]
    frame = spark.createDataFrame([(i, v, n, "x") for i, n, v in rows], SCHEMA)
    got = [tuple(r) for r in hard_negatives.mine(frame.repartition(7), block_bytes).collect()]
    same = [(i, n, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, n, v in rows]
    assert sorted(got) == negatives_of(same) and len(got) > 50


def test_negatives_of_many_equal_rows(spark):
    """One vector holds a third of all rows: ties go by id, and no partner is lost."""
    rows = [(i, [1.0, 0.5] if i % 3 else [0.9, 0.25], i % 4, "x") for i in range(3000)]
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(got) == negatives_of([(i, n, [float(np.float32(x)) for x in v]) for i, v, n, _ in rows])


def test_negatives_without_rows_or_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1, "x"), (2, [0.8], 2, "x")], SCHEMA)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(50, [1.0], 1, "x")], SCHEMA)).collect() == []


def test_large_scores_are_exact_and_too_large_ones_refused():
    a, b = np.array([[3e8 + 1, 7]]), np.array([[3e8 - 1, 5], [1.0, -2.0]])
    assert hard_negatives.products(a, b).tolist() == [[(300000001 * 299999999) + 35, 300000001 - 14]]
    with pytest.raises(OverflowError):
        hard_negatives.products(np.array([[3e9]]), np.array([[3e9]]))
    score = np.array([[2**61, 5, 2**61, -(2**61)], [1, 1, hard_negatives.NONE, 1]])
    found = [x.tolist() for x in hard_negatives.best(score, np.array([1, 2, 3, 4]), 2)]
    assert found[0][0] == [2**61] * 2 and found[1][0] == [1, 3] and found[1][1] == [1, 2]


def test_keys_sort_as_said():
    rows = [(a, s, k, i) for a in (-5, 0, 7) for s in (-(2**62), -3, 0, 9, 2**62) for k in (0, 1) for i in (-1, 0, 4)]
    keys = {}
    for a, s, k, i in rows:
        keys[bytes(hard_negatives.packed(np.array([a]), np.array([s]), k, np.array([i])).column(0)[0].as_py())] = (a, s, k, i)
    assert [keys[x] for x in sorted(keys)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    assert all(hard_negatives.unpacked(x) == r for x, r in keys.items())


# --- repeated windows ----------------------------------------------------------------------------------------------------


def windows_of(rows):
    first = {}
    for doc, text in rows:
        words = split(text)
        for i in range(len(words) - 12):
            key = tuple(words[i:i + 13])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        words = split(text)
        gone = {i + k for i in range(len(words) - 12) if doc is not None and first[tuple(words[i:i + 13])] < doc for k in range(13)}
        out.append((doc, len(words), len(gone), digest([w for i, w in enumerate(words) if i not in gone])))
    return sorted(out, key=str)


def texts(seed, n):
    """Documents of shared passages, of boilerplate around own words, and of few different words."""
    rng = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(rng.randint(8, 60))] for k in range(6)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                words += rng.choice(passages)
            elif kind < 0.7:
                words += ["all", "rights", "reserved", "by", f"owner{i}"]
            elif kind < 0.85:
                words += [rng.choice("ab") for _ in range(30)]
            else:
                words += [f"own{i}w{j}" for j in range(rng.randint(1, 20))]
        out.append((rng.randrange(n), rng.choice([" ", "\n", " \t "]).join(words)))
    return out


@pytest.mark.parametrize("piece", [16 << 20, 300])
def test_windows_equal_a_dictionary(spark, monkeypatch, piece):
    monkeypatch.setattr(window_dedup, "PIECE", piece)
    rows = texts(2, 400) + [(None, "a " * 40), (None, " ".join(f"p0x{i}" for i in range(40)))]
    frame = spark.createDataFrame([(*r, -1) for r in rows], "doc_id long, text string, n_words int").repartition(6)
    got = sorted((tuple(r) for r in window_dedup.dedup(frame).collect()), key=str)
    assert got == windows_of(rows) and sum(r[2] > 0 for r in got) > 100


def test_windows_are_the_same_for_any_list_of_frequent_minimisers(spark, monkeypatch):
    rows = texts(4, 150)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = exact_words.word_codes(pa.array([t for _, t in rows]))
    values = own[2][own[1]]
    every = np.unique(window_dedup.mix(exact_words.window_hashes(values, window_dedup.SEED)))
    want = windows_of(rows)
    for hot in (every, every[::3], every[:0]):
        monkeypatch.setattr(window_dedup, "frequent", lambda *a, hot=hot: hot)
        assert sorted((tuple(r) for r in window_dedup.dedup(frame).collect()), key=str) == want


def test_frequent_minimisers_are_found(spark):
    rows = [(i, f"first{i} second{i} third{i} fourth{i} all rights are reserved by the owner of number{i} and nobody{i} else{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", window_dedup.text_mark())
    assert 0 < len(window_dedup.frequent(docs, 400_000, 8)) <= 32


def test_windows_of_hostile_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in window_dedup.dedup(odd).collect()), key=str) == windows_of(rows)
    assert window_dedup.dedup(none).count() == 0


def test_equal_hashes_of_unlike_windows_are_told_apart():
    codes = np.array([1, 2, 1, 2, 3, 1, 2, 3, 1], np.int64)
    at = np.arange(len(codes) - 1)
    order, group = exact_words.equal_windows(np.zeros(len(at), np.uint64), codes, at, 2)
    by = {}
    for o, g in zip(order.tolist(), group.tolist(), strict=True):
        by.setdefault(g, set()).add((int(codes[o]), int(codes[o + 1])))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({tuple(codes[i:i + 2].tolist()) for i in at})
