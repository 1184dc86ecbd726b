"""Closes against labelled truth, and what happens when a safeguard is taken away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.operators import log
from khata.operators.linkage import link_credits, payouts_without_reference
from khata.operators.movements import WINDOW, in_windows
from khata.plans.books import Books
from khata.plans.causes import never_arrived_payouts
from khata.plans.close import close_summary, findings

# Causes that are arithmetic of the books, not something that was planted.
STRUCTURAL = ("captured_not_yet_settled", "settlement_in_flight")


def truth_by_window(truth: DataFrame, timing: DataFrame, windows: DataFrame) -> DataFrame:
    """Labelled amount per window and cause; the holiday delay comes from the timing facts."""
    labelled = (
        in_windows(truth, windows).groupBy(*WINDOW, "cause").agg(F.sum("amount_paise").alias("actual_paise"))
    )
    delayed = (
        in_windows(timing, windows, "captured_on")
        .filter("t2_naive <= window_end AND t2_actual > window_end")
        .groupBy(*WINDOW)
        .agg(F.sum("net_paise").alias("actual_paise"))
        .withColumn("cause", F.lit("bank_holiday_delay"))
    )
    return labelled.unionByName(delayed).filter("actual_paise <> 0")


def score_windows(found: DataFrame, actual: DataFrame) -> DataFrame:
    """Each reported or labelled cause of a window: matched, hallucinated, missed or structural."""
    reported = found.select(*WINDOW, "cause", F.col("amount_paise").alias("reported_paise"))
    both = reported.join(actual, [*WINDOW, "cause"], "full_outer")
    verdict = (
        F.when(F.col("reported_paise").isNull(), "missed")
        .when(F.col("cause").isin(*STRUCTURAL), "structural")
        .when(F.col("actual_paise").isNull(), "hallucinated")
        .otherwise("matched")
    )
    both = both.withColumn("verdict", verdict)
    for name in ("reported_paise", "actual_paise"):
        both = both.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return both.withColumn("error_paise", F.col("reported_paise") - F.col("actual_paise"))


def report(scored: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: close rate, precision, recall, hallucination, exactness and total error."""
    verdict, error = F.col("verdict"), F.col("error_paise")
    counts = scored.agg(
        F.count_if(verdict == "matched").alias("matched"),
        F.count_if(verdict == "hallucinated").alias("hallucinated"),
        F.count_if(verdict == "missed").alias("missed"),
        F.count_if((verdict == "matched") & (error == 0)).alias("exact"),
        F.coalesce(F.sum(F.when(verdict == "matched", F.abs(error))), F.lit(0)).alias("error_paise"),
    )
    closed = gaps.agg(F.count("*").alias("windows"), F.count_if("closes").alias("closed"))

    def ratio(top, bottom):
        return F.round(F.when(bottom == 0, F.lit(1.0)).otherwise(top / bottom), 6)

    said = F.col("matched") + F.col("hallucinated")
    # two one-row sums over different tables, brought together by one more sum
    both = counts.unionByName(closed, allowMissingColumns=True)
    names = ("windows", "closed", "matched", "hallucinated", "missed", "exact", "error_paise")
    return both.agg(*[F.max(n).alias(n) for n in names]).select(
        "windows", "closed", "matched", "hallucinated", "missed", "error_paise",
        ratio(F.col("closed"), F.col("windows")).alias("close_rate"),
        ratio(F.col("hallucinated"), said).alias("hallucinated_rate"),
        ratio(F.col("matched"), said).alias("precision"),
        ratio(F.col("matched"), F.col("matched") + F.col("missed")).alias("recall"),
        ratio(F.col("exact"), F.col("matched")).alias("exact_rate"),
    )


def blind_spots(scored: DataFrame) -> DataFrame:
    return scored.filter("verdict = 'missed'").groupBy("cause").agg(F.count("*").alias("windows"))


def score_run(books: Books, truth: DataFrame, timing: DataFrame) -> DataFrame:
    scored = score_windows(findings(books), truth_by_window(truth, timing, books.windows))
    return report(scored, close_summary(books))


def closed_weeks(books: Books) -> DataFrame:
    """How many windows of each merchant close, and are fully covered."""
    return close_summary(books).groupBy("merchant_id").agg(
        F.count("*").alias("windows"), F.count_if("closes").alias("closed"), F.count_if("fully_covered").alias("covered")
    )


def weekly_check(books: Books, facts: DataFrame, links: DataFrame) -> DataFrame:
    """The weekly report of each merchant: its closed windows, and whether its log still is what was chained."""
    faults = log.broken_links(links).select("merchant_id").unionByName(log.altered_batches(facts, links).select("merchant_id"))
    broken = faults.groupBy("merchant_id").agg(F.count("*").alias("log_faults"))
    out = closed_weeks(books).join(broken, "merchant_id", "left").withColumn("log_faults", F.coalesce("log_faults", F.lit(0)))
    return out.withColumn("log_holds", F.col("log_faults") == 0)


def linkage_against_naive(books: Books) -> DataFrame:
    """Payouts called missing: by the close, and by looking for the reference text alone."""
    flagged = never_arrived_payouts(books).select("merchant_id", "settlement_id").distinct()
    naive = payouts_without_reference(books.credits, books.payouts).select("merchant_id", "settlement_id")
    ours = flagged.groupBy("merchant_id").agg(F.count("*").alias("ours"))
    theirs = naive.groupBy("merchant_id").agg(F.count("*").alias("naive"))
    out = ours.join(theirs, "merchant_id", "full_outer")
    return out.select("merchant_id", F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("naive", F.lit(0)).alias("naive"))


def greedy_against_careful(books: Books, truth_links: DataFrame) -> DataFrame:
    """Wrong links and open credits, when ambiguity is refused and when the first fit is taken."""
    rows = None
    for name, links in (
        ("careful", books.links),
        ("greedy", link_credits(books.credits, books.payouts, greedy=True)),
    ):
        judged = links.join(
            truth_links.withColumnRenamed("settlement_id", "truly"), ["merchant_id", "bank_txn_id"], "left"
        )
        wrong = F.col("settlement_id").isNotNull() & ~F.coalesce(F.col("settlement_id") == F.col("truly"), F.lit(False))
        one = judged.groupBy("merchant_id").agg(
            F.count_if(wrong).alias("wrong"), F.count_if(F.col("settlement_id").isNull()).alias("open")
        ).withColumn("policy", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


