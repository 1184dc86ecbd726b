"""Nothing is left out for size or shape: cases that earlier versions cut."""

import datetime
import random
import zlib

import pytest

from khata.llm import bloom_lm, decontaminate, pii, url_lists


def held(doc):
    return zlib.crc32(str(doc).encode()) % bloom_lm.FOLDS == bloom_lm.HELD_OUT


# --- language model

def test_scores_do_not_depend_on_the_broadcast_bound(spark, odd, none, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 3000}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for i in range(400)] + [(r.doc_id, r.text) for r in odd.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    read = lambda **x: sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in bloom_lm.score(frame, **x).collect()))
    want = read()
    for head in (bloom_lm.HEAD, 40):
        monkeypatch.setattr(bloom_lm, "HEAD", head)
        got = read(filter_bytes=0)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=1e-6)
    assert bloom_lm.score(none, filter_bytes=0).collect() == []


def test_pairs_seen_once_count(spark):
    ids = [i for i in range(4000) if not held(i)][:600]
    asked = [i for i in range(4000, 12000) if held(i)][:600]
    rows = [(d, f"x{k} y{k}") for k, d in enumerate(ids)]
    rows += [(d, f"x{k} y{k if k % 2 else (k + 1) % 600}") for k, d in enumerate(asked)]
    score = {r.doc_id: r.score for r in bloom_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, unseen = ([score[d] for k, d in enumerate(asked) if k % 2 == odd_] for odd_ in (1, 0))
    assert sum(seen) / 300 > sum(unseen) / 300 + 0.1


# --- decontamination

def test_copies_of_items_of_ordinary_words_are_found(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(1500)]
    items = [rng.choices(vocabulary, k=rng.choice([150, 300])) for _ in range(40)]
    docs, truth = [], set()
    for d in range(1200):
        own = rng.choices(vocabulary, k=rng.randint(20, 200))
        if d % 4 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = items[d // 4 % 40]
            truth.add((d, d // 4 % 40))
        docs.append((d, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert sum(-(-len(w) // decontaminate.STRIDE) for w in items) > decontaminate.LATENT
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark).collect()} == truth


def test_every_text_of_an_item_id_is_searched(spark):
    rng = random.Random(7)
    texts = [" ".join(f"{c}{rng.randrange(500)}" for _ in range(30)) for c in "abc"]
    benchmark = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (5, texts[1]), (6, texts[2])], "item_id long, text string")
    frame = spark.createDataFrame([(k, f"x y z {t} u v w") for k, t in enumerate(texts)] + [(3, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.lcs, r.item_words) for r in decontaminate.leaks(frame, benchmark).collect())
    assert got == [(0, 5, 30, 30), (1, 5, 30, 30), (2, 6, 30, 30)]


# --- pseudonyms

PHONES = [
    "+1 (826) 555-4081", "+1 (017) 555-7713", "+1 (826) 555 4081", "+7 (495) 123 45 67", "+1-555-123-4567", "+1.555.123.4567", "+1 555 123 4567",
    "+1 555 123-4567", "+15551234567", "+49 30 1234567", "+44 20 7946 0958", "+7 495 123 45 67", "+49 89 123 456",
]
VALUES = ["190.137.223.204", "5105105105105100", "4111 1111 1111 1111", "1999-12-31", "(212) 555-1234", "123-45-6789", "+1 (826) 555-4081"]


@pytest.mark.parametrize("gap", [" ", ", "])
def test_a_phone_and_the_value_after_it_are_both_replaced(spark, gap):
    both = [(p, v) for p in PHONES for v in VALUES]
    alone = sorted({*PHONES, *VALUES})
    rows = [(i, v) for i, v in enumerate(alone)] + [(1000 + i, p + gap + v) for i, (p, v) in enumerate(both)]
    got = {r.doc_id: r.text for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), pii.KEY).collect()}
    to = {v: got[i] for i, v in enumerate(alone)}
    assert all(to[v] != v and len(to[v]) > 6 for v in alone)
    assert [got[1000 + i] for i in range(len(both))] == [to[p] + gap + to[v] for p, v in both]


# --- URL lists

@pytest.mark.parametrize("labels", [6, 7, 8, 40, 127])
def test_entries_of_deep_hosts_match(spark, labels):
    name = ".".join(f"{k % 10}" for k in range(labels))
    day = datetime.date(2024, 1, 1)
    captures = spark.createDataFrame([(1, f"https://{name}/en/x", day), (2, f"https://w.{name}/", day), (3, f"https://w{name}/", day)], "page_id long, url string, fetched date")
    for entry, want in ((name, {1, 2}), (f"{name}/en", {1})):
        events = spark.createDataFrame([(entry, "block", day)], "entry string, action string, day date")
        got = url_lists.judge(captures, events).collect()
        assert {r.page_id for r in got if (r.verdict, r.matched, r.n_active) == ("block", entry, 1)} == want
        assert all(r.verdict == "none" for r in got if r.page_id not in want)
