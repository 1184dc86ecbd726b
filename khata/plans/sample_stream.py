"""The sample events table as a stream of ledger facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.money import apply_rate
from khata.schemas import EVENTS, conform

_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def fact_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a fact of one of seven merchants: purchases are captures, clicks refunds, errors failures, the rest placed orders."""
    raw = spark.readStream.schema(_SCHEMA).parquet(f"{folder}/events*.parquet")
    day = F.to_date("ts")
    gross = (F.col("value").cast("decimal(18,2)") * 100).cast("bigint")
    kind = (
        F.when(F.col("event_type") == "purchase", "payment_captured")
        .when(F.col("event_type") == "click", "refund_issued")
        .when(F.col("event_type") == "error", "payment_failed")
        .otherwise("order_placed")
    )
    taken = F.col("event_type") == "purchase"
    fee = F.when(taken, apply_rate(gross, F.lit("2.00")))
    rows = raw.select(
        F.concat(F.lit("u"), F.col("user_id") % 7).alias("merchant_id"),
        F.col("event_id").cast("string").alias("event_id"), kind.alias("type"), day.alias("occurred_at"),
        day.alias("recorded_at"), F.col("event_id").cast("string").alias("entity_id"),
        F.col("user_id").cast("string").alias("counterparty"), F.lit("card").alias("method"),
        gross.alias("amount_paise"), fee.alias("fee_paise"),
        F.when(taken, apply_rate(fee, F.lit("18.00"))).alias("tax_paise"), F.lit("INR").alias("currency"),
    )
    return conform(rows, EVENTS)
