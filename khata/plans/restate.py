"""What a signed close looks like now that late facts are in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.operators.movements import WINDOW, variance
from khata.plans.books import Books
from khata.plans.close import findings


def signed(books: Books, signed_on: str = "window_end") -> Books:
    """The books as known when each window was signed (by default on its last day)."""
    return books.over(books.windows.withColumn("known_by", F.col(signed_on)))


def movements(books: Books, signed_on: str = "window_end", old: Books | None = None) -> DataFrame:
    """Causes whose amount changed between the signed close and now."""
    then = findings(old or signed(books, signed_on)).select(*WINDOW, "cause", F.col("amount_paise").alias("then_paise"))
    now = findings(books).select(*WINDOW, "cause", F.col("amount_paise").alias("now_paise"))
    both = now.join(then, [*WINDOW, "cause"], "full_outer")
    for name in ("then_paise", "now_paise"):
        both = both.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return (
        both.withColumn("delta_paise", F.col("now_paise") - F.col("then_paise"))
        .filter("delta_paise <> 0")
        .withColumn("appeared", (F.col("then_paise") == 0) & (F.col("now_paise") != 0))
    )


def restatement(books: Books, signed_on: str = "window_end") -> DataFrame:
    """Per window that moved: change of the gap, money that changed cause, late arrivals, drift."""
    old = signed(books, signed_on)
    before = variance(old.moves, books.windows).select(*WINDOW, F.col("gap_paise").alias("gap_then"))
    after = variance(books.moves, books.windows).select(*WINDOW, F.col("gap_paise").alias("gap_now"))
    delta = F.col("delta_paise")
    moved = movements(books, signed_on, old).groupBy(*WINDOW).agg(
        F.count("*").alias("causes_moved"),
        F.count_if("appeared").alias("late_arrivals"),
        F.call_function("div", F.sum(F.abs(delta)) + 1, F.lit(2)).alias("reclassified_paise"),
        F.sum(delta).alias("_net"),
    )
    out = before.join(after, WINDOW).join(moved, WINDOW, "left")
    for name in ("causes_moved", "late_arrivals", "reclassified_paise", "_net"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return (
        out.withColumn("gap_delta_paise", F.col("gap_now") - F.col("gap_then"))
        .withColumn("drift_paise", F.col("gap_delta_paise") - F.col("_net"))
        .filter("gap_delta_paise <> 0 OR causes_moved > 0")
        .drop("_net", "gap_then", "gap_now")
    )
