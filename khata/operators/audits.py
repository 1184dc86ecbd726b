"""Checks a ledger has to pass. Each returns the rows that break its rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.operators.linkage import candidate_pairs
from khata.operators.movements import variance, window_movements
from khata.operators.ranking import parts_for
from khata.schemas import ACCOUNTS


def unbalanced_entries(postings: DataFrame) -> DataFrame:
    """Events whose postings do not sum to zero."""
    return (
        postings.groupBy("merchant_id", "event_id")
        .agg(F.sum("amount_paise").alias("off_paise"), F.count("*").alias("rows"))
        .filter("off_paise <> 0")
    )


def unbalanced_books(postings: DataFrame, events: DataFrame) -> DataFrame:
    """Currencies in which a merchant's books do not balance."""
    return currency_totals(postings, events).filter("off_paise <> 0")


def currency_totals(postings: DataFrame, events: DataFrame) -> DataFrame:
    """What each currency sums to. Entries are summed before they meet their currency."""
    entry = postings.groupBy("merchant_id", "event_id").agg(F.sum("amount_paise").alias("off_paise"))
    currency = events.select("merchant_id", "event_id", F.coalesce("currency", F.lit("INR")).alias("currency"))
    return (
        entry.join(currency, ["merchant_id", "event_id"])
        .groupBy("merchant_id", "currency")
        .agg(F.sum("off_paise").alias("off_paise"))
    )


def wrong_side(balance: DataFrame) -> DataFrame:
    """Accounts that may never be on the other side of their normal balance, but are."""
    bad = F.lit(False)
    for name, side, guarded in ACCOUNTS:
        if guarded:
            contra = F.col("balance_paise") < 0 if side == "debit" else F.col("balance_paise") > 0
            bad = bad | ((F.col("account") == name) & contra)
    return balance.filter(bad)


def not_identical(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows whose gap is not the sum of their account movements."""
    return variance(window_movements(daily, windows), windows).filter("remainder_paise <> 0")


def unclaimed(coverage: DataFrame) -> DataFrame:
    return coverage.filter("drift_paise <> 0")


def repeated_facts(log: DataFrame) -> DataFrame:
    """Digests recorded more than once. Copies are counted before the shuffle."""
    return log.groupBy("merchant_id", "digest").agg(F.count("*").alias("copies")).filter("copies > 1")


def broken_sequence(log: DataFrame) -> DataFrame:
    """Merchants whose sequence numbers are not exactly 1..n. Different numbers are counted as bits, 64 numbers to a row."""
    word = log.groupBy("merchant_id", F.shiftright("seq", 6).alias("_word")).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("seq").alias("rows"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("seq", F.lit(64)).cast("int"))).alias("_bits"))
    return (
        word.groupBy("merchant_id")
        .agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"),
            F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).cast("bigint").alias("different"),
        )
        .filter("first <> 1 OR last <> rows OR different <> rows")
    )


def differing_facts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Facts in one log and not in the other, both ways, as often as one of them holds them more. Both meet in one shuffle."""
    both = left.select("merchant_id", "digest", F.lit(1).alias("_n")).unionByName(right.select("merchant_id", "digest", F.lit(-1).alias("_n")))
    parts = parts_for(left.count() + right.count(), left.sparkSession)
    off = both.repartition(parts, "digest").groupBy("merchant_id", "digest").agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return off.select("merchant_id", "digest", F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("only_in"))


def differing_balances(left: DataFrame, right: DataFrame) -> DataFrame:
    """Balances that are not the same in both, both ways."""
    columns = ["merchant_id", "account", "balance_paise"]
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def linkage_work(credits: DataFrame, paid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Payouts in reach per credit, per merchant: it must follow daily volume, not history."""
    keys = keys or ["merchant_id"]
    return (
        candidate_pairs(credits, paid, keys)
        .groupBy(*keys)
        .agg(
            F.sum("credits").alias("credits"),
            F.sum(F.col("credits") * F.col("in_reach")).alias("candidates"),
        )
        .withColumn("per_credit", F.round(F.col("candidates") / F.col("credits"), 6))
    )
