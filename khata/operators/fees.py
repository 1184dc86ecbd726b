"""Captures against the fee schedule the merchant signed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions.money import apply_rate
from khata.schemas import METHODS


def captures(events: DataFrame) -> DataFrame:
    return events.filter("type = 'payment_captured'").select(
        "merchant_id", F.col("entity_id").alias("payment_id"), "occurred_at", "recorded_at", "method",
        "amount_paise", F.coalesce("fee_paise", F.lit(0)).alias("fee_paise"),
        F.coalesce("tax_paise", F.lit(0)).alias("tax_paise"), F.coalesce("tds_paise", F.lit(0)).alias("tds_paise"),
    )


def price_captures(taken: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds ``contract_paise``. A method the contract does not name is priced at nothing.

    The contracts side grows with the merchants, so Spark picks the join from its size.
    """
    priced = taken.join(contracts.select("merchant_id", "method", "rate"), ["merchant_id", "method"], "left")
    at_contract = F.coalesce(apply_rate(F.col("amount_paise"), F.col("rate")), F.lit(0))
    return priced.withColumn("contract_paise", at_contract)


def daily_fees(priced: DataFrame) -> DataFrame:
    return priced.groupBy("merchant_id", "occurred_at", "recorded_at", "method").agg(
        F.count("*").alias("captures"),
        F.sum("amount_paise").alias("gross_paise"),
        F.sum("fee_paise").alias("fee_paise"),
        F.sum("tax_paise").alias("tax_paise"),
        F.sum("tds_paise").alias("tds_paise"),
        F.sum("contract_paise").alias("contract_paise"),
    )


def fee_audit(priced: DataFrame) -> DataFrame:
    """Captures billed at something else than the contract, with the rate that was billed."""
    gross = F.col("amount_paise")
    billed_ppm = F.when(gross != 0, F.call_function("div", F.col("fee_paise") * 1_000_000, gross))
    return priced.filter("fee_paise <> contract_paise").select(
        "merchant_id", "payment_id", "occurred_at", "method", "amount_paise", "fee_paise", "contract_paise",
        (F.col("fee_paise") - F.col("contract_paise")).alias("excess_paise"), billed_ppm.alias("billed_ppm"),
    )


def invalid_contracts(raw: DataFrame) -> DataFrame:
    """Contract lines that name an unknown method, or no rate between 0 and 10 percent."""
    rate = F.col("rate").cast("string").try_cast("decimal(12,6)")
    return raw.withColumn(
        "reason",
        F.when(~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)), "unknown method")
        .when(rate.isNull(), "rate is not a number")
        .when((rate < 0) | (rate > 10), "rate outside 0 to 10 percent"),
    ).filter("reason IS NOT NULL")


def methods_not_priced(taken: DataFrame, contracts: DataFrame) -> DataFrame:
    """Methods in use that the merchant's contract does not name."""
    return (
        taken.groupBy("merchant_id", "method")
        .agg(F.count("*").alias("captures"), F.sum("fee_paise").alias("fee_paise"))
        .join(contracts, ["merchant_id", "method"], "left_anti")
    )


def merchant_profile(events: DataFrame) -> DataFrame:
    """Effective fee, tax on fee, chargebacks per card capture, share of each method, refund rate."""
    kind, method = F.col("type"), F.col("method")
    took = kind == "payment_captured"

    def total(when, column: str):
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0))

    counts = [F.count_if(took & (method == m)).alias(f"{m}_captures") for m in METHODS]
    sums = events.groupBy("merchant_id").agg(
        F.count_if(took).alias("captures"),
        total(took, "amount_paise").alias("gross_paise"),
        total(took, "fee_paise").alias("fee_paise"),
        total(took, "tax_paise").alias("tax_paise"),
        F.count_if(kind == "dispute_opened").alias("disputes"),
        total(kind == "refund_issued", "amount_paise").alias("refunded_paise"),
        *counts,
    )

    def ratio(top, bottom):
        return F.round(F.when(bottom != 0, top / bottom), 6)

    cards = F.col("card_captures") + F.col("emi_captures")
    return sums.select(
        "*",
        ratio(F.col("fee_paise"), F.col("gross_paise")).alias("fee_rate"),
        ratio(F.col("tax_paise"), F.col("fee_paise")).alias("tax_on_fee"),
        ratio(F.col("disputes"), cards).alias("chargebacks_per_card"),
        ratio(F.col("upi_captures"), F.col("captures")).alias("upi_share"),
        ratio(F.col("refunded_paise"), F.col("gross_paise")).alias("refund_rate"),
    )
