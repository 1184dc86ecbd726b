"""Quality rules and the n-gram join against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from khata.llm import ngram_join, quality_rules, shingles
from khata.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics_of_odd_texts(odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_rules.statistics(odd).collect()
    texts = [r.text for r in odd.collect()]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(base(t) for t in texts)


def test_outliers_of_odd_and_empty_tables(odd, none):
    rows = quality_rules.outliers(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.outliers(none).collect() == []
    assert quality_rules.keep(none).columns == none.columns


def test_planted_outlier_goes_and_the_rest_stays(spark):
    rng = random.Random(3)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(40, 200))) for _ in range(120)]
    bad = [" ".join(f"W{i}{i}$$$%%%***" for i in range(80)), " ".join("SHOUT" + str(i) for i in range(60))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(clean + bad)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.outliers(docs).filter("kept").collect()}
    assert kept == set(range(120))
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == kept


def sets_of(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def by_brute_force(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def edited(rng, words, share):
    return [rng.choice(["p", "q", "r"]) + w if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("width", "percent", "tile"), [(4, 85, 24 << 20), (5, 80, 3000), (4, 60, 24 << 20)])
def test_join_equals_all_pairs(spark, monkeypatch, width, percent, tile):
    monkeypatch.setattr(ngram_join, "TILE_BYTES", tile)
    rng = random.Random(width * percent)
    texts = []
    for _ in range(12):
        own = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 30, 90, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = edited(rng, own, rng.choice([0, 0.005, 0.01, 0.03]))
            texts.append(" ".join(own + [f"w{rng.randint(0, 9)}"] * rng.choice([0, 0, 1, 5])))
    texts += ["common start of all " + t for t in texts[:15]] + [texts[0].upper(), texts[0]]
    crowd = [f"c{rng.randint(0, 4000)}" for _ in range(250)]
    texts += [" ".join(edited(rng, crowd, rng.choice([0.002, 0.01, 0.03]))) for _ in range(40)]
    rows = list(enumerate(texts))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), width, percent, reducer_entries=500)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_brute_force(rows, width, percent)


def test_join_of_odd_and_empty_tables(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_join.join(odd)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_brute_force(rows, 4, 85)
    assert ngram_join.join(none).collect() == []
    kept = sorted((r.doc_id for r in ngram_join.one_of_each(odd).collect()), key=str)
    assert kept == sorted([None, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11], key=str)


def test_join_of_long_texts_alone(spark):
    rng = random.Random(8)
    own = [f"w{rng.randint(0, 4000)}" for _ in range(1500)]
    other = [f"v{rng.randint(0, 4000)}" for _ in range(2600)]
    texts = [own, edited(rng, own, 0.004), own[:1200], other, edited(rng, other, 0.3), other + ["end"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert min(len(sets_of(t, 4)) for _, t in rows) > ngram_join.LEAST_BITS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.join(docs).collect()) == by_brute_force(rows, 4, 85)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == sorted({c for _, _, c in by_brute_force(rows, 5, 80)})


@pytest.mark.parametrize("sizes", [[], [0], [0, 0], [5], [1024], [1025], [3000, 1025], [3, 2000, 0, 1024], [1100] * 2001 + [9], [9] * 2000 + [1100]])
def test_sketches_of_any_mix_of_sizes(sizes):
    values = np.arange(sum(sizes), dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    got = ngram_join._own_sketches(bounds, values)
    assert [len(x) * 8 for x in got] == [ngram_join.sketch_bits(n) for n in sizes]
    for x, a, b in zip(got, bounds[:-1], bounds[1:], strict=True):
        assert x == ngram_join.sketches(np.array([0, b - a]), values[a:b], ngram_join.sketch_bits(b - a))[0].tobytes()


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    for size in (7, 8, 13, 14, 20, 40, 100, 333, 1000):
        for _ in range(30):
            one = rng.integers(0, 2**63, size).astype(np.uint64)
            two = one.copy()
            k = int(ngram_join.allowed(size, size, 85)) // 2
            two[:k] = rng.integers(0, 2**63, k).astype(np.uint64)
            one, two = np.unique(one), np.unique(two[: size - rng.integers(0, 2)])
            common = len(np.intersect1d(one, two))
            if 100 * common < 85 * (len(one) + len(two) - common):
                continue
            owner, sigs = ngram_join.signatures(np.array([0, len(one), len(one) + len(two)]), np.concatenate([one, two]), 85)
            assert len(one) == len(two) == common or set(sigs[owner == 0]) & set(sigs[owner == 1])


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(6)
    for _ in range(50):
        one = np.unique(rng.integers(0, 2**63, rng.integers(1, 500)).astype(np.uint64))
        two = np.unique(np.concatenate([one[: len(one) // 2], rng.integers(0, 2**63, 40).astype(np.uint64)]))
        drawn = ngram_join.sketches(np.array([0, len(one), len(one) + len(two)]), np.concatenate([one, two]), 1024)
        apart = np.bitwise_count(drawn[0] ^ drawn[1]).sum()
        assert apart <= len(np.setxor1d(one, two))
        wide = ngram_join.sketches(np.array([0, len(one)]), one, 8192)[0]
        assert (ngram_join._folded(wide, 16) == drawn[0]).all()


def test_words_of_slices_of_a_batch():
    texts = ["Été À b", None, "", "  x  ", "Ünder\x0bscore\x1fkept a b"] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = []
    for piece in shingles.slices(batch, size=37):
        bounds, words = shingles.tokens(piece.column("text"))
        names = [words.dictionary[i].as_py() for i in words.indices.to_pylist()]
        got += [names[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [WORD.findall((t or "").translate(LOWER)) for t in texts]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(500, 499), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in range(200, 240)} | {499: 499, 500: 499}


def test_sharers_are_found_within_a_share_of_a_bucket_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 64, 4000, np.uint64)[rng.integers(0, 4000, 20_000)]
    own = rng.integers(0, 900, 20_000)
    sizes, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sizes.append(len(keys[0])), real(keys))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([sig[:7000].tobytes(), sig[7000:].tobytes()], pa.binary()), pa.array([own[:7000].tobytes(), own[7000:].tobytes()], pa.binary())], ["sigs", "ids"])
    got = {tuple(r.values()) for out in ngram_join._sharers(iter([batch])) for r in out.to_pylist()}
    assert max(sizes) < 20_000 / 5 and sum(sizes) == 20_000
    want, holders = set(), {}
    for s, o in zip(sig.tolist(), own.tolist()):
        holders.setdefault(s, set()).add(o)
    for s, h in holders.items():
        if len(h) > ngram_join.SMALL:
            want |= {(s - (1 << 64) if s >> 63 else s, o, 2) for o in h}
        else:
            want |= {(a, b, 1) for a in h for b in h if a < b}
    assert got == want
