"""The ledger as streams: ingest, balances, late facts, payouts in flight, floors, file arrival."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.text import reference_key
from khata.operators import log
from khata.operators.linkage import _pieces
from khata.operators.movements import SUBJECT
from khata.operators.postings import project
from khata.plans import conformal
from khata.schemas import EVENTS
from khata.sources import log_store
from khata.sources.gateway import EXPORT

# Disputes are recorded up to three weeks after they occur, so state is kept this long.
LATE_DAYS = 35


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Events arriving as JSON lines with the fixed event schema."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _at(day: str) -> Column:
    return F.col(day).cast("timestamp")


# --- ingest -----------------------------------------------------------------------------------


def distinct_within(events: DataFrame, days: int = LATE_DAYS) -> DataFrame:
    """Each fact once as long as its copies come within ``days``; state is bounded by that."""
    return (
        log.with_digest(events)
        .withColumn("recorded_ts", _at("recorded_at"))
        .withWatermark("recorded_ts", f"{days} days")
        .dropDuplicatesWithinWatermark(["merchant_id", "digest"])
        .drop("recorded_ts")
    )


def append_new_facts(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that records each batch as a delivery of the log: what is new, numbered and chained on from the stored heads.

    Exact over any stretch of time: what was seen is the log itself. A batch that is run again after a failure finds its facts there
    and adds nothing, or replaces what a run that did not end has left.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log_store.append(batch, path)

    return write


def ingest(events: DataFrame, path: str, checkpoint: str):
    """Run what has arrived through to the log and stop."""
    return (
        events.observe("delivered", F.count("*").alias("rows"))
        .writeStream.foreachBatch(append_new_facts(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- balances -----------------------------------------------------------------------------------


def running_balances(events: DataFrame) -> DataFrame:
    """Balance of every account, carried from batch to batch (update mode)."""
    return project(events).groupBy("merchant_id", "account").agg(F.sum("amount_paise").alias("balance_paise"))


# --- late facts -----------------------------------------------------------------------------------


def weekly_movements(events: DataFrame) -> DataFrame:
    """Movements per calendar week, restated whenever a late fact changes one (update mode).

    There is no watermark, so no fact is ever too late; the state is one sum per merchant, week and account.
    """
    posted = project(events).filter(~F.col("account").isin(*SUBJECT))
    return (
        posted.groupBy("merchant_id", F.window(_at("occurred_at"), "7 days").alias("week"), "account")
        .agg(F.sum("amount_paise").alias("amount_paise"))
        .select("merchant_id", F.to_date("week.start").alias("week_start"), "account", "amount_paise")
    )


def split_late(path: str, days: int = LATE_DAYS) -> Callable[[DataFrame, int], None]:
    """A batch writer that lists facts recorded more than ``days`` after they occurred; the weekly sums hold them too."""

    def write(batch: DataFrame, batch_id: int) -> None:
        late = F.datediff("recorded_at", "occurred_at") > days
        batch.filter(late).write.mode("append").parquet(f"{path}/batch={batch_id}")

    return write


# --- payouts in flight -------------------------------------------------------------------------------


def payouts_in_flight(
    payouts: DataFrame, credits: DataFrame, reference_sizes: tuple[int, ...], lookback: int = 6, forward: int = 1,
    delay_days: int = 3,
) -> DataFrame:
    """Each payout with the credit that names it; without one once its time is over (append mode).

    The streams meet on the reference itself, cut out of the narration in each length
    references have, so payouts and credits of one busy day are never paired up.
    Only full references are used here; what needs to look at rivals stays in batch.
    """
    left = payouts.select(
        "merchant_id", "settlement_id", "utr", F.col("amount_paise").alias("paid_paise"), _at("occurred_at").alias("paid_ts")
    ).withWatermark("paid_ts", f"{delay_days} days")
    parts = F.array()
    for size in reference_sizes:
        parts = F.array_union(parts.cast("array<string>"), _pieces(F.col("narration"), F.lit(size)))
        parts = F.array_union(parts, _pieces(reference_key(F.col("narration")), F.lit(size)))
    right = credits.select(
        F.col("merchant_id").alias("credit_merchant"), "bank_txn_id", _at("occurred_at").alias("credit_ts"),
        F.explode(F.filter(parts, lambda p: F.trim(p) != "")).alias("named"),
    ).withWatermark("credit_ts", f"{delay_days} days")
    in_time = (F.col("credit_ts") >= F.col("paid_ts") - F.expr(f"INTERVAL {forward} DAYS")) & (
        F.col("credit_ts") <= F.col("paid_ts") + F.expr(f"INTERVAL {lookback} DAYS"))
    joined = left.join(
        right, (F.col("merchant_id") == F.col("credit_merchant")) & (F.col("utr") == F.col("named")) & in_time, "leftOuter")
    return joined.select(
        "merchant_id", "settlement_id", "utr", "paid_paise", F.to_date("paid_ts").alias("paid_on"), "bank_txn_id",
        F.col("bank_txn_id").isNull().alias("never_arrived"),
    )


# --- floors -------------------------------------------------------------------------------------------

FLOOR = "merchant_id string, as_of date, floor_paise bigint, held boolean, level double, in_distress boolean"


def adaptive_floors(outcomes: DataFrame) -> DataFrame:
    """The adaptive floor as each window of a merchant is observed; the state is its scores and level.

    Windows that arrive in one batch are taken in order of their day.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            scores, level, recent = state.get
            held = {"scores": json.loads(scores), "level": level, "recent": json.loads(recent)}
        else:
            held = conformal.start_state()
        rows = pd.concat(list(frames)).sort_values("as_of")
        out = []
        for row in rows.itertuples():
            held = conformal.observe(held, int(row.forecast_paise), int(row.actual_paise))
            told = held["row"]
            out.append((key[0], row.as_of, told["floor"], told["held"], told["level"], told["distress"]))
        state.update((json.dumps(held["scores"]), float(held["level"]), json.dumps(held["recent"])))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLOOR.split(", ")])

    return outcomes.filter("forecast_paise <> 0").groupBy("merchant_id").applyInPandasWithState(
        step, FLOOR, "scores string, level double, recent string", "update", "NoTimeout"
    )


# --- files -----------------------------------------------------------------------------------------------


def arriving_exports(spark: SparkSession, path: str) -> DataFrame:
    """Items of gateway exports as their files arrive; the merchant is the file's folder."""
    raw = spark.readStream.schema(EXPORT).option("multiLine", True).json(path)
    return raw.select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("merchant_id"),
        F.col("_metadata.file_path").alias("file"), F.posexplode("items").alias("position", "item"),
    ).select("merchant_id", "file", "position", "item.*")


def arriving_statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of bank statements as they arrive, for the statement reader in foreachBatch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).load(path)
    return raw.select(F.col("path").alias("file"), "content")
