import datetime
import pathlib
import random

import models
import pytest
from pyspark.sql import functions as F

from khata.operators import apportion, audits, log, movements, ranking
from khata.operators.calendar import add_bank_days, bank_calendar
from khata.operators.postings import project
from khata.plans import conformal, grounding
from khata.schemas import EVENTS
from khata.sources import log_store, statement


def test_calendar_against_a_walk(spark):
    span = spark.sql("SELECT DATE '2025-12-01' AS lo, DATE '2027-02-01' AS hi")
    shut = {datetime.date(2026, 1, 1), datetime.date(2026, 1, 26), datetime.date(2026, 3, 4)}
    holidays = spark.createDataFrame([(d,) for d in shut], "d date")
    rows = {r["d"]: r for r in bank_calendar(span, holidays).collect()}

    def is_open(d):
        fourth = d.weekday() == 5 and (8 <= d.day <= 14 or 22 <= d.day <= 28)
        return d.weekday() != 6 and not fourth and d not in shut

    for d, r in rows.items():
        assert r["is_bank_day"] == is_open(d)
        assert r["t2_actual"] == models.add_bank_days(d, 2, is_open)
        assert r["next_open"] == (d if is_open(d) else models.add_bank_days(d, 1, is_open))
    days = spark.createDataFrame([(d,) for d in rows if d.year == 2026], "day date")
    calendar = bank_calendar(span, holidays)
    for n in (0, 1, 3):
        for r in add_bank_days(days, "day", n, calendar, "lands").collect():
            assert r["lands"] == models.add_bank_days(r["day"], n, is_open)


def test_postings_of_a_negative_net_do_not_balance_and_are_reported(spark):
    row = dict.fromkeys(EVENTS.names)
    good = {**row, "merchant_id": "m", "event_id": "a", "type": "payment_captured", "entity_id": "p", "counterparty": "o",
            "amount_paise": 100, "fee_paise": 2, "tax_paise": 1, "tds_paise": 0, "method": "card"}
    events = spark.createDataFrame([good, {**good, "event_id": "b", "fee_paise": 200}, {**good, "event_id": "c", "type": "order_placed"}], EVENTS)
    posted = project(events)
    assert posted.filter("event_id = 'a'").count() == 5 and posted.filter("event_id = 'c'").count() == 0
    assert [r["event_id"] for r in audits.unbalanced_entries(posted).collect()] == ["b"]


def test_apportionment_matches_the_model(spark):
    rng = random.Random(5)
    groups = [(g, rng.choice((-1, 1)) * rng.randrange(10**6), [rng.randrange(0, 50) for _ in range(rng.randrange(1, 7))]) for g in range(300)]
    groups = [(g, a if sum(w) else 0, w) for g, a, w in groups]
    rows = [(g, i, a, w) for g, a, ws in groups for i, w in enumerate(ws)]
    frame = spark.createDataFrame(rows, "g int, i int, amount bigint, weight bigint")
    for big in (False, True):
        got = {(r["g"], r["i"]): r["share_paise"] for r in apportion.allocate(frame, ["g"], "amount", "weight", "i", big).collect()}
        for g, a, ws in groups:
            assert [got[g, i] for i in range(len(ws))] == models.allocate(a, ws)


def test_apportioning_by_nothing_is_refused(spark):
    frame = spark.createDataFrame([(1, 0, 10, 0)], "g int, i int, amount bigint, weight bigint")
    with pytest.raises(Exception, match="cannot apportion"):
        apportion.allocate(frame, ["g"], "amount", "weight", "i").collect()


def test_ranks_and_carried_values_across_partitions(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaab"), i, rng.choice((None, i))) for i in range(5000)]
    frame = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = {(r["g"], r["i"]): r["rank"] for r in ranking.rank_in_group(frame, ["g"], [F.col("i").desc()], "rank", parts=5).collect()}
    carried = {(r["g"], r["i"]): r["last"] for r in ranking.carry_last(frame, ["g"], [F.col("i")], "v", "last", parts=5).collect()}
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        for at, (_, i, _) in enumerate(sorted(mine, key=lambda r: -r[1]), start=1):
            assert got[g, i] == at
        seen = None
        for _, i, v in sorted(mine, key=lambda r: r[1]):
            seen = v if v is not None else seen
            assert carried[g, i] == seen


def test_balance_check_matches_the_model_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(statement, "PIECE", 4)
    rng = random.Random(11)
    files, rows = {}, []
    for f in range(300):
        lines, running = [], 500
        if rng.random() < 0.5:
            lines.append((1, None, None, running))
        for line in range(2, rng.randrange(3, 20)):
            debit, credit = rng.choice(((rng.randrange(50), 0), (0, rng.randrange(50))))
            running += credit - debit
            shown = None if rng.random() < 0.4 else running + (7 if rng.random() < 0.1 else 0)
            lines.append((line, debit, credit, shown))
        files[f"f{f}"] = lines
        rows += [(f"f{f}", *line, line[1] is None) for line in lines]
    frame = spark.createDataFrame(rows, "file string, line bigint, debit_paise bigint, credit_paise bigint, balance_paise bigint, opening boolean")
    got = {}
    for r in statement.check_balances(frame).collect():
        broken, checked = got.setdefault(r["file"], ([], []))
        broken += [r["line"]] if r["broken"] else []
        checked += [1] if r["checked"] else []
    for name, lines in files.items():
        broken, checked = models.balance_check(lines)
        mine = got.get(name, ([], []))
        assert (sorted(mine[0]), len(mine[1])) == (broken, checked), lines


def outcome_rows(n=40):
    rng = random.Random(3)
    first = datetime.date(2026, 1, 1)
    return [(m, first + datetime.timedelta(days=7 * i), 10**6 + rng.randrange(10**6), 8 * 10**5 + rng.randrange(10**6))
            for m in ("a", "b") for i in range(n)]


def test_floors_match_the_models(spark):
    rows = outcome_rows()
    frame = spark.createDataFrame(rows, "merchant_id string, as_of date, forecast_paise bigint, actual_paise bigint")
    split = {(r["merchant_id"], r["as_of"]): r["floor_paise"] for r in conformal.split_floors(frame).collect()}
    moving = {(r["merchant_id"], r["as_of"]): r for r in conformal.adaptive_floors(frame).collect()}
    for m in ("a", "b"):
        scores, level = [], 0.10
        for _, day, forecast, actual in [r for r in rows if r[0] == m]:
            assert split[m, day] == models.conformal_floor(scores, forecast, 0.10)
            floor = models.conformal_floor(scores, forecast, min(max(level, 1e-4), 0.999))
            assert moving[m, day]["floor_paise"] == floor
            level = min(max(level + 0.02 * (0.10 - (actual < floor)), 1e-4), 0.999)
            assert moving[m, day]["level"] == pytest.approx(level)
            scores.append((forecast - actual) / forecast)


def test_values_carried_both_ways(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice((None, None, None, i * 10))) for g, n in (("a", 300), ("b", 5), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int, v int").repartition(3)
    got = {(r["g"], r["i"]): (r["lo"], r["hi"]) for r in ranking.carry_both_ways(frame, ["g"], [F.col("i")], "v", "lo", "hi", parts=7).collect()}
    for g, i, _ in rows:
        before, after = ([v for x, j, v in rows if x == g and v is not None and cond(j)] for cond in (lambda j: j <= i, lambda j: j > i))
        assert got[g, i] == (before[-1] if before else None, after[0] if after else None)


def test_order_statistics_of_earlier_rows(spark):
    rng = random.Random(12)
    rows = [(g, i, rng.choice((-1.5, 0.0, 0.25, rng.random())), rng.choice((0, 1, 2, max(1, i // 2), i, i + 1))) for g, n in (("a", 700), ("b", 17), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int, x double, k int").repartition(4)
    got = {(r["g"], r["i"]): r["kth"] for r in ranking.earlier_order_statistic(frame, ["g"], [F.col("i")], "x", "k", "kth").collect()}
    past = {}
    for g, i, x, k in rows:
        seen = sorted(past.setdefault(g, []))
        assert got[g, i] == (seen[k - 1] if 1 <= k <= len(seen) else None)
        past[g].append(x)
    empty = ranking.earlier_order_statistic(frame.filter("i < 0"), ["g"], [F.col("i")], "x", "k", "kth")
    assert empty.collect() == [] and empty.columns == [*frame.columns, "kth"]


def test_chain_catches_tampering(spark, ledger, tmp_path):
    facts = ledger.log.filter("merchant_id = 'm1'")
    links = log.chain(facts)
    assert log.broken_links(links).isEmpty() and log.altered_batches(facts, links).isEmpty()
    # an altered amount changes the root of its day
    touched = log.with_digest(facts.drop("digest").withColumn(
        "amount_paise", F.col("amount_paise") + F.when(F.col("seq") == 5, 1).otherwise(0)))
    assert log.altered_batches(touched, links).count() == 1
    # a removed batch breaks the link after it
    assert log.broken_links(links.filter("batch <> 3")).count() == 1
    assert not log.broken_links(links.withColumn("root", F.when(F.col("batch") == 4, F.lit("x")).otherwise(F.col("root")))).isEmpty()
    # nothing before ``since`` is looked at again
    assert log.broken_links(links.filter("batch <> 3"), since=4).isEmpty()
    # the same facts in another order inside a day are another log
    day = facts.groupBy("recorded_at").count().filter("count > 1").first()["recorded_at"]
    pair = [r["seq"] for r in facts.filter(F.col("recorded_at") == day).orderBy("seq").limit(2).collect()]
    swapped = facts.withColumn("seq", F.when(F.col("seq") == pair[0], pair[1]).when(F.col("seq") == pair[1], pair[0]).otherwise(F.col("seq")))
    assert [r["recorded_at"] for r in log.altered_batches(swapped, links).collect()] == [day]


@pytest.fixture()
def deliveries(ledger):
    """Three deliveries of two merchants: two on the same days, the third a later half-year; all bring something again."""
    whole = ledger.events.filter("merchant_id IN ('m1', 'm2') AND recorded_at BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
    early, bank = F.col("recorded_at") <= F.lit("1997-03-31").cast("date"), F.col("type").startswith("bank")
    captured = F.col("type") == "payment_captured"
    return whole, [whole.filter(early & ~bank), whole.filter(early & (bank | captured)), whole.filter(~early | bank)]


def test_log_goes_on_from_its_head(spark, deliveries, tmp_path):
    whole, parts = deliveries
    path = str(tmp_path / "log")
    told = [{r["merchant_id"]: (r["delivered"], r["recorded"], r["skipped"]) for r in log_store.append(part, path).collect()} for part in parts]
    assert all(d == r + k for t in told for d, r, k in t.values())
    assert all(k == 0 for _, _, k in told[0].values()) and all(k > 0 for t in told[1:] for _, _, k in t.values())
    facts = log_store.read_log(spark, path)
    assert audits.differing_facts(facts, log.with_digest(whole)).isEmpty() and audits.broken_sequence(facts).isEmpty()
    assert facts.select("delivery").distinct().count() == 3
    # a day that two deliveries have in common is one batch of each
    assert facts.groupBy("merchant_id", "recorded_at").agg(F.countDistinct("delivery").alias("n")).filter("n > 1").count() > 0
    # the chain that went on from its head is the chain over everything
    links = log_store.links(spark, path)
    assert links.exceptAll(log.chain(facts).select(*links.columns)).isEmpty() and log.broken_links(links).isEmpty()
    # what comes again adds nothing, not even a delivery
    again = log_store.append(parts[1], path)
    assert again.agg(F.sum("recorded")).first()[0] == 0 and log_store.links(spark, path).count() == links.count()
    assert log_store.faults(spark, path).isEmpty()


def _rewrite(spark, path, change):
    facts = change(spark.read.text(path)).collect()
    for file in pathlib.Path(path).rglob("*"):
        if file.is_file():
            file.unlink()
    pathlib.Path(path, "part-0.json").write_text("\n".join(r["value"] for r in facts) + "\n")


def test_log_notices_what_was_done_to_it(spark, deliveries, tmp_path):
    _, parts = deliveries
    path = tmp_path / "log"
    for part in parts:
        log_store.append(part, str(path))
    month = str(path / "facts" / "delivery=2" / "month=1997-02")
    # two facts of one day change places
    day = log_store.facts(spark, str(path)).filter("delivery = 2 AND month = '1997-02' AND merchant_id = 'm1'").groupBy("recorded_at").agg(
        F.sort_array(F.collect_list("seq")).alias("s")).filter("size(s) > 1").first()["s"]
    a, b = f'"seq":{day[0]}}}', f'"seq":{day[1]}}}'
    _rewrite(spark, month, lambda t: t.select(F.when(F.col("value").endswith(a), F.replace("value", F.lit(a), F.lit(b))).when(
        F.col("value").endswith(b), F.replace("value", F.lit(b), F.lit(a))).otherwise(F.col("value")).alias("value")))
    assert [tuple(r) for r in log_store.faults(spark, str(path)).collect()] == [("m1", "facts were added, moved or altered")]
    with pytest.raises(log_store.BrokenLog):
        log_store.read_log(spark, str(path))
    # deliveries after the second are whole
    assert log_store.faults(spark, str(path), since=2).isEmpty() and log_store.read_log(spark, str(path), since=2).count() > 0


def test_unfinished_delivery_is_replaced(spark, deliveries, tmp_path):
    whole, parts = deliveries
    path = tmp_path / "log"
    log_store.append(parts[0], str(path))
    before = log_store.read_log(spark, str(path)).count()
    # a run that wrote facts and ended before their links
    log_store.facts(spark, str(path)).drop("delivery").withColumn("event_id", F.lit("half")).write.partitionBy("month").json(str(path / "facts" / "delivery=2"))
    assert log_store.read_log(spark, str(path)).count() == before
    for part in parts[1:]:
        log_store.append(part, str(path))
    facts = log_store.read_log(spark, str(path))
    assert facts.filter("event_id = 'half'").isEmpty() and audits.differing_facts(facts, log.with_digest(whole)).isEmpty()


def test_null_and_blank_have_different_digests(spark):
    row = dict.fromkeys(EVENTS.names)
    frame = spark.createDataFrame([{**row, "event_id": "a", "utr": ""}, {**row, "event_id": "a"}], EVENTS)
    assert log.with_digest(frame).select("digest").distinct().count() == 2


def test_no_hindsight(spark, ledger):
    """Facts recorded later leave the ledger as it stood untouched."""
    day = F.lit("1997-06-30").cast("date")
    known = movements.known(ledger.events, day, day)
    more = known.unionByName(ledger.events.filter(F.col("recorded_at") > day))
    assert movements.known(more, day, day).exceptAll(known).isEmpty()


def test_identity_holds_on_any_window(spark, ledger):
    rng = random.Random(4)
    first = datetime.date(1996, 1, 1)
    windows = []
    for i in range(60):
        start = first + datetime.timedelta(days=rng.randrange(1500))
        windows.append((f"m{i % 5}", i, start, start + datetime.timedelta(days=rng.randrange(60))))
    frame = spark.createDataFrame(windows, "merchant_id string, window_id int, window_start date, window_end date")
    assert audits.not_identical(ledger.books.daily, frame).isEmpty()


def test_figures_against_the_re_module(spark, folder):
    import re
    from decimal import Decimal

    pattern = re.compile(r"(-?)\s*(?:INR|Rs\.?|₹)\s*(-?[\d,]+(?:\.\d{1,2})?)|(?<![\w.])(-?\d[\d,]{2,}(?:\.\d{2})?)(?![\w.])", re.IGNORECASE)
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted((r["doc_id"], r["place"], r["paise"]) for r in grounding.citations(documents, ["doc_id"]).collect())
    want = []
    for row in documents.collect():
        place = 0
        for m in pattern.finditer(row["text"]):
            lead, tagged, bare = m.groups()
            raw = (tagged if tagged is not None else bare).replace(",", "")
            try:
                value = Decimal(raw)
            except ArithmeticError:
                continue
            want.append((row["doc_id"], place, int(-abs(value) * 100 if lead == "-" else value * 100)))
            place += 1
    assert got == sorted(want)


def test_grounding_finds_the_nearest(spark):
    texts = spark.createDataFrame([(1, "INR 10.00 and 250 and INR 9.00"), (2, "1,000.00")], "doc int, text string")
    allowed = spark.createDataFrame([(1, -1000), (1, 30000), (1, 20000)], "doc int, amount_paise bigint")
    got = {(r["doc"], r["place"]): (r["grounded"], r["nearest_paise"]) for r in grounding.check(texts, allowed, ["doc"]).collect()}
    assert got == {(1, 0): (True, None), (1, 1): (False, 20000), (1, 2): (False, 1000), (2, 0): (False, None)}
    rates = {r["doc"]: (r["figures"], r["rate"]) for r in grounding.grounding_rate(
        grounding.check(texts, allowed, ["doc"]), ["doc"], texts.unionByName(spark.createDataFrame([(99, "no figure")], texts.schema))).collect()}
    assert rates[99] == (0, 1.0) and len(rates) == texts.select("doc").distinct().count() + 1
    near = {r["place"]: r["grounded"] for r in grounding.check(texts.filter("doc = 1"), allowed, ["doc"], 100).collect()}
    assert near == {0: True, 1: False, 2: True}


def test_identifiers_survive_a_rewrite(spark):
    texts = spark.createDataFrame([(1, "trace UTR1234567 and pay_abcdef1", "trace UTR1234567")], "doc int, source string, text string")
    ids = spark.createDataFrame([(1, "UTR1234567"), (1, "pay_abcdef1"), (1, "short"), (1, "not_in_source")], "doc int, identifier string")
    assert [r["identifier"] for r in grounding.lost_identifiers(texts, ids, ["doc"]).collect()] == ["pay_abcdef1"]
    assert grounding.without_identifiers(texts, ids, ["doc"]).first()["text"] == "trace "
