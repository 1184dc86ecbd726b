"""From findings to what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.dates import tax_claim_deadline
from khata.functions.money import per_year
from khata.operators.movements import WINDOW, variance
from khata.plans import causes
from khata.plans.books import Books
from khata.plans.close import close_summary, findings

# The buckets, and weight and urgency of each kind of action.
BUCKETS = ("chase", "tax", "timing", "cost", "lost")
WEIGHT = {"high": 3, "medium": 2, "low": 1}
URGENCY = {
    "settlement_never_arrived": "high",
    "fee_rate_increase": "high",
    "risk_hold": "medium",
    "dispute_reserve_held": "medium",
    "gst_on_fee": "low",
    "tds_194o": "low",
    "chargeback_lost": "low",
}


def bucketed(found: DataFrame) -> DataFrame:
    """Money released rather than held is timing, not something to chase."""
    bucket = causes.lookup(F.col("cause"), "bucket")
    return found.withColumn(
        "bucket", F.when((bucket == "chase") & (F.col("amount_paise") <= 0), "timing").otherwise(bucket)
    )


def bucket_totals(found: DataFrame) -> DataFrame:
    amount, bucket = F.col("amount_paise"), F.col("bucket")
    to_act_on = bucket.isin("chase", "tax") & (amount > 0)
    return bucketed(found).groupBy(*WINDOW).agg(
        *[F.coalesce(F.sum(F.when(bucket == b, amount)), F.lit(0)).alias(f"{b}_paise") for b in BUCKETS],
        F.coalesce(F.sum(F.when(to_act_on, amount)), F.lit(0)).alias("recoverable_paise"),
    )


def _pick(cause: Column, table: dict) -> Column:
    out: Column | None = None
    for name, value in table.items():
        out = F.when(cause == name, value) if out is None else out.when(cause == name, value)
    return out


def actions(found: DataFrame, windows: DataFrame) -> DataFrame:
    """One action per finding that calls for one, with its score; higher is more pressing."""
    rows = found.filter(F.col("cause").isin(*URGENCY) & (F.col("amount_paise") > 0)).join(
        windows.select(*WINDOW, "window_start", "window_end"), WINDOW
    )
    cause, amount = F.col("cause"), F.col("amount_paise")
    urgency = _pick(cause, URGENCY)
    yearly = per_year(amount, F.datediff("window_end", "window_start") + 1)
    score = (
        F.when(cause == "fee_rate_increase", (yearly + amount) * WEIGHT["high"])
        .when(cause == "chargeback_lost", F.call_function("div", amount, F.lit(10)))
        .otherwise(amount * _pick(urgency, WEIGHT))
    )
    return rows.select(
        *WINDOW, "cause", "amount_paise", urgency.alias("urgency"),
        F.when(cause == "gst_on_fee", tax_claim_deadline(F.col("window_start"))).alias("deadline"),
        F.when(cause == "fee_rate_increase", yearly).alias("per_year_paise"),
        score.cast("bigint").alias("score"),
    )


def weeks(books: Books) -> DataFrame:
    """The weekly series: volume, gap, buckets, billed and contracted fee rate, overcharge, alarms."""
    found = findings(books)
    amount, cause = F.col("amount_paise"), F.col("cause")
    fees = found.groupBy(*WINDOW).agg(
        F.coalesce(F.sum(F.when(cause.isin("normal_fee", "fee_rate_increase"), amount)), F.lit(0)).alias("fee_paise"),
        F.coalesce(F.sum(F.when(cause == "fee_rate_increase", amount)), F.lit(0)).alias("overcharge_paise"),
        F.count_if("alarming").alias("flagged"),
    )
    out = (
        variance(books.moves, books.windows)
        .select(*WINDOW, "window_start", "window_end", "gross_paise", "gap_paise")
        .join(bucket_totals(found), WINDOW, "left")
        .join(fees, WINDOW, "left")
    )
    for name in [f"{b}_paise" for b in BUCKETS] + ["recoverable_paise", "fee_paise", "overcharge_paise", "flagged"]:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))

    def share(top: Column) -> Column:
        return F.round(F.when(F.col("gross_paise") != 0, top / F.col("gross_paise")).otherwise(F.lit(0.0)), 6)

    return (
        out.withColumn("fee_rate", share(F.col("fee_paise")))
        .withColumn("contract_rate", share(F.col("fee_paise") - F.col("overcharge_paise")))
        .drop("fee_paise")
    )


def overcharge_start(series: DataFrame) -> DataFrame:
    """Per merchant: first week billed above contract, what it cost since and would cost a year."""
    over = F.col("overcharge_paise")
    first = series.groupBy("merchant_id").agg(
        F.min(F.when(over > 0, F.col("window_start"))).alias("hike_started"), F.max("window_end").alias("last_day")
    )
    since = (
        series.join(first, "merchant_id")
        .filter(F.col("window_start") >= F.col("hike_started"))
        .groupBy("merchant_id", "hike_started", "last_day")
        .agg(F.sum(over).alias("since_paise"))
    )
    days = F.datediff("last_day", "hike_started") + 1
    return since.select(
        "merchant_id", "hike_started", "since_paise", per_year(F.col("since_paise"), days).alias("per_year_paise")
    )


def sizing(whole: Books) -> DataFrame:
    """Averages across merchants over their whole period."""
    totals = bucket_totals(findings(whole))
    gross = variance(whole.moves, whole.windows).select(*WINDOW, "gross_paise")
    per = gross.join(totals, WINDOW, "left")
    n = F.count("*")

    def average(column: Column) -> Column:
        return F.call_function("div", F.sum(column), n)

    def some(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return per.agg(
        n.alias("merchants"),
        average(F.col("gross_paise")).alias("avg_captured_paise"),
        average(some("recoverable_paise")).alias("avg_recoverable_paise"),
        average(F.greatest(some("chase_paise"), F.lit(0))).alias("avg_chase_paise"),
        average(F.greatest(some("tax_paise"), F.lit(0))).alias("avg_tax_paise"),
        F.round(F.sum(some("recoverable_paise")) / F.sum("gross_paise"), 4).alias("recoverable_share"),
    )


def quarter(books: Books, whole: Books) -> DataFrame:
    """Whole-period close per merchant with its number of weeks and overcharge history."""
    series = weeks(books)
    count = series.groupBy("merchant_id").agg(F.count("*").alias("weeks"))
    return (
        close_summary(whole)
        .select("merchant_id", "window_start", "window_end", "gross_paise", "landed_paise", "gap_paise", "remainder_paise")
        .join(bucket_totals(findings(whole)).drop("window_id"), "merchant_id", "left")
        .join(count, "merchant_id")
        .join(overcharge_start(series), "merchant_id", "left")
    )
