"""Links as they stood earlier against the sequential model on what was known then, and components against union by hand."""

import datetime
import random
from types import SimpleNamespace

import models

from khata.operators.as_known import History
from khata.operators.components import components
from khata.operators.linkage import link_credits
from khata.plans import causes

D = datetime.date(2026, 1, 5)
DAY = datetime.timedelta(days=1)
PAID = "merchant_id string, settlement_id string, utr string, amount_paise bigint, occurred_at date, recorded_at date, fee_paise bigint"
CAME = "merchant_id string, bank_txn_id string, amount_paise bigint, occurred_at date, recorded_at date, narration string"
SPAN = 84


def world(rng):
    """Twelve weeks in which payouts share references with their neighbours, so that claims chain from end to end; some facts come weeks late."""
    refs = [f"2026{k:02d}" + "".join(rng.choice("01") for _ in range(4)) for k in range(6)]
    late = lambda: rng.choice([0, 0, 0, 0, 1, 2, 9, 40, 65])
    paid = []
    for i in range(rng.randrange(6, 26)):
        day = rng.randrange(SPAN - 10)
        paid.append((f"p{i}", rng.choice(refs), rng.choice((100, 200, 300)), D + day * DAY, D + (day + late()) * DAY))
    came = []
    for i in range(rng.randrange(6, 26)):
        day, ref = rng.randrange(SPAN), rng.choice(refs)
        said = rng.choice(["NEFT {r}", "NEFT {h}-{t}", "BY {s}", "IMPS IN", "{r} {o}"]).format(r=ref, h=ref[:7], t=ref[7:], s=ref[:9], o=rng.choice(refs))
        came.append((f"c{i}", rng.choice((100, 200, 300)), D + day * DAY, D + (day + late()) * DAY, said))
    return came, paid


def missing_then(came, paid, by):
    """Payouts known by ``by`` that the model links to nothing and that no open credit could be."""
    came, paid = [c for c in came if max(c[2], c[3]) <= by], [p for p in paid if max(p[3], p[4]) <= by]
    links = models.link([(c[0], c[1], c[2], c[4]) for c in came], [p[:4] for p in paid])
    taken = {row[0] for row in links.values() if row[0]}
    open_credits = [c for c in came if not links[c[0]][0]]
    return {p[0] for p in paid if p[0] not in taken and not any(c[1] == p[2] and abs((c[2] - p[3]).days) <= 6 for c in open_credits)}


def test_missing_payouts_as_they_were_known(spark):
    rng = random.Random(4)
    worlds = {f"m{i:03d}": world(rng) for i in range(60)}
    credits = spark.createDataFrame([(m, *c) for m, (cs, _) in worlds.items() for c in cs], CAME)
    paid = spark.createDataFrame([(m, *p, 0) for m, (_, ps) in worlds.items() for p in ps], PAID)
    rows = [(m, w, D + 7 * w * DAY, D + (7 * w + 6) * DAY, D + (7 * w + 6) * DAY) for m in worlds for w in range(SPAN // 7 + 10)]
    windows = spark.createDataFrame(rows, "merchant_id string, window_id int, window_start date, window_end date, known_by date")
    links = link_credits(credits, paid)
    books = SimpleNamespace(credits=credits, payouts=paid, links=links, windows=windows, history=History(credits, paid, links))
    got = {(r["merchant_id"], r["window_id"], r["settlement_id"]) for r in causes._missing_as_known(books).collect()}
    want, changed = set(), 0
    for m, w, first, last, by in rows:
        came, ps = worlds[m]
        inside = {p[0] for p in ps if first <= p[3] <= last and p[4] <= by}
        then, now = missing_then(came, ps, by) & inside, missing_then(came, ps, datetime.date.max) & inside
        want |= {(m, w, p) for p in then}
        changed += then != now
    assert got == want and changed > 20
    # a payout settles long after it was made, where a late fact touches it; most settle within days
    late = {r["settled"] for r in books.history.settled.collect()}
    assert max(late) > D + (SPAN + 20) * DAY


def test_components_against_union_by_hand(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(130)]
    edges += [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(150)] + [("hub", f"leaf{i}") for i in range(300)] + [("same", "same")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string").repartition(5)).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
