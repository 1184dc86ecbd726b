"""Sums taken before postings are made are the sums of the postings."""

import datetime
import random

from khata.lineage import cut
from khata.operators import movements
from khata.operators.postings import daily_sums, posting_rules, project
from khata.plans.sample_ledger import sample_ledger
from khata.schemas import EVENTS


def test_daily_sums_are_those_of_the_postings(spark):
    rng, day, kinds = random.Random(4), datetime.date(2026, 3, 1), [*posting_rules(), "order_placed"]
    rows = []
    for i in range(3000):
        row = dict.fromkeys(EVENTS.names)
        row |= {
            "merchant_id": f"m{i % 3}", "event_id": str(i), "type": rng.choice(kinds), "entity_id": f"e{i}",
            "occurred_at": day + datetime.timedelta(rng.randrange(4)), "recorded_at": day + datetime.timedelta(rng.randrange(4, 6)),
            "amount_paise": rng.choice([None, 0, -7, rng.randrange(10**6)]), "won": rng.choice([None, True, False]),
        }
        for name in ("fee_paise", "tax_paise", "tds_paise"):
            row[name] = rng.choice([None, -3, rng.randrange(900)])
        rows.append(tuple(row[n] for n in EVENTS.names))
    events = cut(spark.createDataFrame(rows, EVENTS), "events")
    want = movements.daily_movements(project(events))
    got = daily_sums(events)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    differing = set(map(str, got.collect())) ^ set(map(str, want.collect()))
    assert not differing, sorted(differing)[:6]
    assert daily_sums(events.filter("merchant_id IS NULL")).collect() == []


def test_daily_sums_make_no_posting_per_event(ledger):
    plan = daily_sums(ledger.from_orders)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan[plan.rindex("Generate "):]


def test_credits_payouts_and_facts_are_written_once(ledger):
    for table in (ledger.facts, ledger.books.credits, ledger.books.payouts):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("Relation") and "Join" not in plan and "Union" not in plan
    assert sample_ledger(ledger.spark, ledger.folder).books.over(ledger.books.windows).credits is ledger.books.credits
