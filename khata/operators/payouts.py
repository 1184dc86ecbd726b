"""Payouts rebuilt from the rows of a settlement report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One payout per settlement: credits less debits, first reference and first settled time.

    ``rows`` needs settlement_id, credit, debit, settlement_utr, settled_at and a
    ``position``. What a payout covers stays one row per item, see ``covered``.
    """
    keys = keys or ["merchant_id"]
    named = F.when(F.col("settlement_utr") != "", F.col("position"))
    timed = F.when(F.coalesce("settled_at", F.lit(0)) != 0, F.col("position"))
    return (
        rows.filter(F.coalesce("settlement_id", F.lit("")) != "")
        .groupBy(*keys, "settlement_id")
        .agg(
            (F.sum(F.coalesce("credit", F.lit(0))) - F.sum(F.coalesce("debit", F.lit(0)))).alias("net_paise"),
            F.coalesce(F.min_by("settlement_utr", named), F.lit("")).alias("utr"),
            F.min_by("settled_at", timed).alias("settled_at"),
            F.count("*").alias("covers"),
        )
        .filter("net_paise > 0")
    )


def covered(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Which items each rebuilt payout covers, one row per item."""
    keys = keys or ["merchant_id"]
    kept = rebuild(rows, keys).select(*keys, "settlement_id", "utr", F.col("settled_at").alias("_settled"))
    return rows.join(kept, [*keys, "settlement_id"]).select(
        *keys, "settlement_id", "utr", F.col("entity_id").alias("payment_id"), F.col("_settled").alias("settled_at")
    )


def unsettled(captures: DataFrame, covers: DataFrame) -> DataFrame:
    """Captures no known payout covers."""
    return captures.join(covers.select("merchant_id", "payment_id"), ["merchant_id", "payment_id"], "left_anti")
