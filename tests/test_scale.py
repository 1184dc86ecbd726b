"""Steps whose memory and shuffled bytes must follow the rows, seen in their plans and partitions."""

from __future__ import annotations

import datetime
import pathlib

from pyspark.sql import functions as F

from khata.operators import audits, log, ranking
from khata.schemas import EVENTS, event_row


def _events(spark, n, copies=2):
    k = F.col("id")
    row = event_row(
        merchant_id=F.concat(F.lit("m"), (k % 2).cast("string")), event_id=F.concat(F.lit("e"), k.cast("string")), type=F.lit("x"),
        occurred_at=F.date_add(F.lit(datetime.date(2000, 1, 1)), (k % 3).cast("int")), recorded_at=F.date_add(F.lit(datetime.date(2000, 1, 1)), (k % 5).cast("int")),
        amount_paise=k)
    once = spark.range(n).select(row.alias("e")).select("e.*")
    out = once
    for _ in range(copies - 1):
        out = out.unionByName(once)
    return out


def _plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().toString()


def test_log_is_numbered_by_one_shuffle_into_as_many_parts_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PART_ROWS", 100)
    events = _events(spark, 1000)
    sizes = []
    real = ranking.cut

    def watched(frame, label="cut"):
        written = real(frame, label)
        if label == "placed":
            sizes.extend(r["n"] for r in written.groupBy(F.shiftright("_at", ranking.PLACE_BITS)).agg(F.count("*").alias("n")).collect())
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange ") == 1, plan
        return written

    monkeypatch.setattr(ranking, "cut", watched)
    got = log.record(events)
    assert len(sizes) >= 15 and max(sizes) <= 200
    monkeypatch.setattr(ranking, "cut", real)
    want = log.assign_sequence(log.distinct_facts(log.with_digest(events)))
    assert sorted(map(str, got.select(*sorted(want.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    assert set(got.columns) == {*EVENTS.names, "digest", "seq"}


def test_ranks_take_one_shuffle_and_treat_null_groups_as_a_group(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("i"))
    got = ranking.rank_in_group(rows, ["g"], [F.col("i").desc()], "rank", parts=7)
    assert "Exchange" not in got.select("g", "i", "rank")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    seen = {}
    for r in sorted(got.collect(), key=lambda r: -r["i"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["rank"] == seen[r["g"]]


def test_roots_do_not_depend_on_how_digests_are_dealt(spark):
    facts = log.record(_events(spark, 300))
    keys = ["merchant_id", "recorded_at"]
    assert sorted(map(str, log.roots(facts, keys).collect())) == sorted(map(str, log.roots(facts, keys, parts=9).collect()))


def test_sequence_and_facts_are_compared_without_counting_distinct_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", -5), ("c", 0), ("c", 70), ("d", None)], "merchant_id string, seq bigint")
    broken = audits.broken_sequence(rows)
    got = {r["merchant_id"]: tuple(r)[1:] for r in broken.collect()}
    assert got == {"b": (1, 1, 2, 1), "c": (-5, 70, 3, 3)}
    left = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "merchant_id string, digest string")
    right = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "x")], "merchant_id string, digest string")
    differing = audits.differing_facts(left, right)
    assert sorted(map(tuple, differing.collect())) == [("a", "x", "left"), ("a", "y", "left"), ("a", "z", "right")]
    assert _plan(differing).split("== Physical Plan ==")[0].count("Union") == 3


def test_a_delivery_is_counted_from_its_links(spark, tmp_path):
    from khata.sources import log_store

    events = _events(spark, 40, copies=3)
    first = {r["merchant_id"]: tuple(r)[1:] for r in log_store.append(events, str(tmp_path / "log")).collect()}
    again = {r["merchant_id"]: tuple(r)[1:] for r in log_store.append(events.unionByName(_events(spark, 44, copies=1)), str(tmp_path / "log")).collect()}
    assert first == {"m0": (60, 20, 40), "m1": (60, 20, 40)} and again == {"m0": (82, 2, 80), "m1": (82, 2, 80)}
    assert log_store.read_log(spark, str(tmp_path / "log")).count() == 44


def test_apportionment_of_small_groups_joins_nothing(spark):
    from khata.operators.apportion import allocate

    rows = spark.createDataFrame([("a", 1, 2, 100), ("a", 2, 1, 100), ("b", 1, 0, 0), (None, 1, 1, 5)], "g string, i int, w bigint, t bigint")
    got = allocate(rows, ["g"], "t", "w", "i")
    assert sorted((r["g"], r["i"], r["share_paise"]) for r in got.collect()) == [("a", 1, 67), ("a", 2, 33), ("b", 1, 0)]
    assert "Join" not in _plan(got)


def test_apportionment_takes_more_parts_for_more_lines(spark, folder, monkeypatch):
    from khata.catalog import QUERIES

    monkeypatch.setattr(ranking, "PART_ROWS", 500)
    assert "hashpartitioning(l_orderkey" in (plan := _plan(QUERIES["f4_apportion"](spark, folder))) and ", 4), " not in plan


def test_a_delivery_is_shuffled_once_and_leaves_only_its_compressed_lines(spark, tmp_path, monkeypatch):
    from khata import lineage
    from khata.sources import log_store

    made, plans = [], []
    real = lineage._write

    def watched(frame, label, passages):
        written = real(frame, label, passages)
        made.append((label, written.inputFiles()))
        if label == "placed":
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written

    monkeypatch.setattr(lineage, "_write", watched)
    path = tmp_path / "log"
    log_store.append(_events(spark, 400, copies=2), str(path))
    told = log_store.append(_events(spark, 600, copies=1), str(path))
    assert {tuple(r)[1:] for r in told.collect()} == {(300, 100, 200)}
    # a delivery meets the log in the shuffle that numbers it, where each row of the log is a digest and its place
    assert len(plans) == 2 and all(p.count("Exchange rangepartitioning") == 1 for p in plans)
    assert not any("Exchange" in line and "hashpartitioning" in line and "amount_paise" in line for p in plans for line in p.splitlines())
    there = {label: [f for f in files if pathlib.Path(f.removeprefix("file://")).exists()] for label, files in made}
    assert there.pop("told") and not any(there.values())
    assert all(f.name.endswith(".json.gz") for f in (path / "facts").rglob("part-*")) and spark.conf.get(lineage.SPENT) == "false"
    roots = log.log_roots(log_store.facts(spark, str(path)).filter("delivery = 1"), 3)
    assert roots.count() and _plan(roots).split("== Physical Plan ==")[-1].count("REPARTITION_BY_NUM") > 0


def test_facts_of_no_merchant_or_day_are_recorded_whenever_they_come(spark, tmp_path):
    from khata.sources import log_store

    events = _events(spark, 6, copies=1).withColumns({
        "merchant_id": F.when(F.col("event_id") != "e1", F.col("merchant_id")), "recorded_at": F.when(F.col("event_id") != "e2", F.col("recorded_at"))})
    for number, recorded in ((1, 6), (2, 2)):
        log_store.append(events, str(tmp_path / "log"))
        links = log_store.links(spark, str(tmp_path / "log")).filter(F.col("delivery") == number)
        assert links.agg(F.sum("facts")).first()[0] == recorded
    facts = log_store.facts(spark, str(tmp_path / "log"))
    assert facts.groupBy("event_id").count().filter("count > 1").count() == 2


def test_a_group_goes_on_through_its_runs(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 20).alias("run"), F.col("id").alias("i"))
    placed = rows.repartitionByRange(5, "run", "g", "i").sortWithinPartitions("run", "g", "i")
    since = spark.createDataFrame([(1, 100)], "g bigint, _last bigint")
    got = {r["i"]: r["n"] for r in ranking.rank_placed(placed, ["g"], "n", ["run"], since).collect()}
    assert got == {i: i // 2 + 1 + (100 if i % 2 else 0) for i in range(60)}


def test_only_pieces_that_payouts_have_are_dealt_with_their_narrations(spark):
    from khata import lineage
    from khata.operators import linkage

    n, day = 300, datetime.date(2026, 5, 4)
    paid = spark.createDataFrame(
        [("m", f"p{i}", f"20260504{i:06d}", 1000 + i, day) for i in range(n)], "merchant_id string, settlement_id string, utr string, amount_paise bigint, occurred_at date")
    came = spark.createDataFrame(
        [("m", f"c{i}", 1000 + i, day, f"PAID BY A PAYER OF A LONG NAME, REF 20260504-{i:06d} THANK YOU") for i in range(n)],
        "merchant_id string, bank_txn_id string, amount_paise bigint, occurred_at date, narration string")
    nodes = linkage.reference_nodes(paid, ["merchant_id"]).withColumn("head", linkage._head())
    pieces, heads = linkage._meeting(came, nodes, ["merchant_id"])
    # a credit has about fifty pieces, of which one is a reference and one the head of a payout of its amount
    assert pieces.count() == n and heads.count() == n
    folder = pathlib.Path(lineage.checkpoint_folder(spark))
    before = {p.name for p in folder.iterdir()}
    links = linkage.link_credits(came, paid)
    assert links.filter("rule = 'normalised_utr' AND substr(settlement_id, 2) = substr(bank_txn_id, 2)").count() == n
    left = [p for p in folder.iterdir() if p.name not in before]
    assert [p.name.split("-")[0] for p in left if any(f.is_file() for f in p.rglob("*"))] == ["linked"]
