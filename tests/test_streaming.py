"""A stream over any order of deliveries ends where the batch job ends."""

import datetime
import os
import random

from pyspark.sql import functions as F

from khata.operators import audits, log, movements
from khata.operators.postings import project
from khata.plans import conformal
from khata.schemas import EVENTS
from khata.sources import log_store
from khata.streaming import jobs


def sample(ledger):
    return ledger.events.filter("occurred_at BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")


def deliver(events, folder, seed, copies=1):
    """Split, reorder and repeat the events over several files."""
    folder.mkdir(exist_ok=True)
    rows = [r for r in events.toJSON().collect()] * copies
    random.Random(seed).shuffle(rows)
    for i in range(4):
        (folder / f"part-{seed}-{i}.json").write_text("\n".join(rows[i::4]) + "\n")


def drain(frame, name, mode="update"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return frame.sparkSession.table(name)


def test_ingest_is_the_same_for_any_delivery(spark, ledger, tmp_path):
    events = sample(ledger)
    logs = []
    for seed, copies in ((1, 1), (2, 3)):
        source, target = tmp_path / f"in{seed}", str(tmp_path / f"log{seed}")
        deliver(events, source, seed, copies)
        stream = jobs.read_events(spark, str(source), files_per_batch=1)
        jobs.ingest(stream, target, str(tmp_path / f"cp{seed}")).awaitTermination(240)
        # delivered again, later: nothing is added
        deliver(events, source, seed + 10)
        jobs.ingest(jobs.read_events(spark, str(source), files_per_batch=2), target, str(tmp_path / f"cp{seed}")).awaitTermination(240)
        logs.append(log_store.read_log(spark, target))  # verified: every batch of the stream went on from the head
    clean = log.distinct_facts(log.with_digest(events))
    for got in logs:
        assert got.count() == clean.count()
        assert audits.differing_facts(got, clean).isEmpty()
        assert audits.repeated_facts(got).isEmpty()
        assert audits.broken_sequence(got).isEmpty()
        # a fact that goes missing leaves a gap
        assert audits.broken_sequence(got.filter("seq <> 7")).count() == got.select("merchant_id").distinct().count()


def test_a_stream_in_order_is_the_batch_log(spark, ledger, tmp_path):
    """Whatever the cut into batches, facts that come by the day they were recorded get the numbers of the batch log."""
    events = sample(ledger).filter("merchant_id IN ('m1', 'm2')")
    want = log.assign_sequence(log.distinct_facts(log.with_digest(events))).select("merchant_id", "digest", "seq")
    for files, name in ((1, "fine"), (3, "coarse")):
        source = tmp_path / name
        source.mkdir()
        for i, (first, last) in enumerate([("1996-01-01", "1997-01-17"), ("1997-01-18", "1997-02-03"), ("1997-02-04", "1997-02-04"), ("1997-02-05", "1999-01-01")]):
            rows = events.filter(F.col("recorded_at").between(first, last)).toJSON().collect()
            (source / f"{i}.json").write_text("\n".join(rows) + "\n")
            os.utime(source / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)
        target = str(tmp_path / f"{name}-log")
        jobs.ingest(jobs.read_events(spark, str(source), files_per_batch=files), target, str(tmp_path / f"{name}-cp")).awaitTermination(240)
        got = log_store.read_log(spark, target).select("merchant_id", "digest", "seq")
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_distinct_within_watermark(spark, ledger, tmp_path):
    events = sample(ledger)
    deliver(events, tmp_path / "in", 3, copies=2)
    got = drain(jobs.distinct_within(jobs.read_events(spark, str(tmp_path / "in"))), "once", "append")
    assert got.count() == events.count()


def test_running_balances_equal_a_fold(spark, ledger, tmp_path):
    events = sample(ledger)
    deliver(events, tmp_path / "in", 4)
    drain(jobs.running_balances(jobs.read_events(spark, str(tmp_path / "in"), files_per_batch=1)), "carried")
    # the last update of a key is its balance; sums only change by updates, so take the fold's value among them
    fold = movements.balances(movements.daily_movements(project(events)))
    seen = spark.table("carried")
    assert fold.join(seen, ["merchant_id", "account", "balance_paise"], "left_anti").isEmpty()


def test_late_disputes_restate_their_week(spark, ledger, tmp_path):
    events = sample(ledger)
    on_time = events.filter("recorded_at = occurred_at")
    late = events.filter("recorded_at > occurred_at")
    assert late.count() > 0
    deliver(on_time.filter("occurred_at <= DATE '1997-01-31'"), tmp_path / "in", 5)
    deliver(late.filter("occurred_at <= DATE '1997-01-31'"), tmp_path / "in", 6)
    drain(jobs.weekly_movements(jobs.read_events(spark, str(tmp_path / "in"))), "weeks")
    batch = project(events.filter("occurred_at <= DATE '1997-01-31'")).filter("account NOT IN ('revenue', 'bank')")
    week = F.to_date(F.window(F.col("occurred_at").cast("timestamp"), "7 days")["start"]).alias("week_start")
    want = batch.groupBy("merchant_id", week, "account").agg(F.sum("amount_paise").alias("amount_paise"))
    assert want.join(spark.table("weeks"), ["merchant_id", "week_start", "account", "amount_paise"], "left_anti").isEmpty()


def test_no_fact_is_too_late_for_its_week(spark, ledger, tmp_path):
    one = sample(ledger).filter("type = 'payment_captured'").limit(1)
    for i, day in enumerate(["2026-06-01", "2026-06-15", "2026-06-29", "2026-01-01", "2026-07-06"]):
        fact = one.withColumns({"occurred_at": F.to_date(F.lit(day)), "recorded_at": F.to_date(F.lit(day)), "event_id": F.lit(f"e{i}"), "amount_paise": F.lit(100 + i).cast("bigint"),
                                "fee_paise": F.lit(0).cast("bigint"), "tax_paise": F.lit(0).cast("bigint"), "tds_paise": F.lit(0).cast("bigint")})
        deliver(fact, tmp_path / "in", 20 + i)
    drain(jobs.weekly_movements(jobs.read_events(spark, str(tmp_path / "in"), files_per_batch=1)), "all_weeks")
    got = {r["amount_paise"] for r in spark.table("all_weeks").filter("account = 'gateway_receivable'").collect()}
    assert {100, 101, 102, 103, 104} <= got


def test_too_late_facts_go_aside(spark, ledger, tmp_path):
    deliver(sample(ledger), tmp_path / "in", 7)
    stream = jobs.read_events(spark, str(tmp_path / "in"))
    query = (stream.writeStream.foreachBatch(jobs.split_late(str(tmp_path / "late"), days=15))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    aside = spark.read.schema(EVENTS).parquet(str(tmp_path / "late" / "batch=0"))
    assert aside.count() == sample(ledger).filter("datediff(recorded_at, occurred_at) > 15").count() > 0


def test_payouts_in_flight(spark, tmp_path):
    day = datetime.date(2026, 5, 4)
    paid = [("m1", "s1", "20260504123456", 5, day), ("m1", "s2", "20260504999999", 6, day),
            ("m1", "s3", "20260701000001", 7, datetime.date(2026, 7, 1))]
    came = [("m1", "b1", "IMPS/20260504-123456/X", day + datetime.timedelta(days=1)),
            ("m1", "b2", "LATE 20260504999999", day + datetime.timedelta(days=9)),
            ("m1", "b3", "NEFT-20260701000001", datetime.date(2026, 7, 2)),
            ("m1", "b4", "OTHER", datetime.date(2026, 9, 1))]
    spark.createDataFrame(paid, "merchant_id string, settlement_id string, utr string, amount_paise bigint, occurred_at date").unionByName(
        spark.createDataFrame([("m1", "s9", "X2026090100001", 1, datetime.date(2026, 9, 1))],
                              "merchant_id string, settlement_id string, utr string, amount_paise bigint, occurred_at date")
    ).write.parquet(str(tmp_path / "paid"))
    spark.createDataFrame(came, "merchant_id string, bank_txn_id string, narration string, occurred_at date").write.parquet(str(tmp_path / "came"))
    left = spark.readStream.schema(spark.read.parquet(str(tmp_path / "paid")).schema).parquet(str(tmp_path / "paid"))
    right = spark.readStream.schema(spark.read.parquet(str(tmp_path / "came")).schema).parquet(str(tmp_path / "came"))
    got = {r["settlement_id"]: r for r in drain(jobs.payouts_in_flight(left, right, (14,)), "flight", "append").collect()}
    assert got["s1"]["bank_txn_id"] == "b1" and got["s3"]["bank_txn_id"] == "b3"
    assert got["s2"]["never_arrived"] and got["s2"]["bank_txn_id"] is None


def test_streamed_floors_equal_the_batch(spark, tmp_path):
    rng = random.Random(8)
    first = datetime.date(2026, 1, 1)
    rows = [(m, first + datetime.timedelta(days=14 * i), 1_000_000 + rng.randrange(10**6), 900_000 + rng.randrange(10**6))
            for m in ("m1", "m2") for i in range(30)]
    schema = "merchant_id string, as_of date, forecast_paise bigint, actual_paise bigint"
    outcomes = spark.createDataFrame(rows, schema)
    for part in range(3):
        cutoffs = first + datetime.timedelta(days=140 * part), first + datetime.timedelta(days=140 * (part + 1))
        outcomes.filter((F.col("as_of") >= F.lit(cutoffs[0])) & (F.col("as_of") < F.lit(cutoffs[1]))).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / f"o{part}"))
    import shutil

    (tmp_path / "in").mkdir()
    for part in range(3):
        for file in (tmp_path / f"o{part}").glob("*.parquet"):
            target = tmp_path / "in" / f"{part}-{file.name}"
            shutil.copy(file, target)
            import os
            os.utime(target, (1_700_000_000 + part * 60,) * 2)
    stream = spark.readStream.schema(outcomes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(jobs.adaptive_floors(stream), "floors").select("merchant_id", "as_of", "floor_paise", "held")
    want = conformal.adaptive_floors(outcomes).select("merchant_id", "as_of", "floor_paise", "held")
    assert got.count() == 60 and got.exceptAll(want).isEmpty()


def test_exports_arrive_as_files(spark, tmp_path):
    import json

    (tmp_path / "in" / "m7").mkdir(parents=True)
    (tmp_path / "in" / "m7" / "a.json").write_text(json.dumps({"items": [{"entity_id": "p", "type": "payment", "amount": 5}]}))
    got = drain(jobs.arriving_exports(spark, str(tmp_path / "in" / "*")), "arrived", "append").first()
    assert (got["merchant_id"], got["entity_id"], got["amount"]) == ("m7", "p", 5)
