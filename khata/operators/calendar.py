"""The bank calendar: which days are open and when T+2 really falls.

The table has one row per day of the span it covers, so it is the one place where a
window without a partition is fine and the one table that is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# No bank is shut this many days in a row; the spine is built this much longer than
# asked so that the last days still find their T+2.
_SLACK_DAYS = 30


def bank_calendar(
    span: DataFrame,
    holidays: DataFrame | None = None,
    yearly: tuple[str, ...] = (),
) -> DataFrame:
    """One row per day between ``lo`` and ``hi`` of the one-row frame ``span``.

    Sundays and the second and fourth Saturdays are shut, and so are the days in
    ``holidays(d)`` and those whose ``MM-dd`` is in ``yearly``.
    """
    days = span.select(
        F.explode(F.sequence("lo", F.date_add("hi", _SLACK_DAYS))).alias("d"), "hi"
    )
    weekday = F.weekday("d")
    of_month = F.dayofmonth("d")
    shut = (weekday == 6) | ((weekday == 5) & (of_month.between(8, 14) | of_month.between(22, 28)))
    if yearly:
        shut = shut | F.date_format("d", "MM-dd").isin(*yearly)
    if holidays is not None:
        closed = holidays.select(F.col("d"), F.lit(True).alias("closed")).distinct()
        days = days.join(F.broadcast(closed), "d", "left")
        shut = shut | F.coalesce("closed", F.lit(False))
    days = days.withColumn("is_bank_day", ~shut)
    days = days.withColumn(
        "open_ordinal", F.sum(F.col("is_bank_day").cast("int")).over(Window.orderBy("d"))
    )
    opens = days.filter("is_bank_day").select(
        F.col("open_ordinal").alias("_ord"), F.col("d").alias("t2_actual")
    )
    nexts = days.filter("is_bank_day").select(
        F.col("open_ordinal").alias("_nord"), F.col("d").alias("next_open")
    )
    return (
        days.join(F.broadcast(opens), F.col("open_ordinal") + 2 == F.col("_ord"))
        .join(
            F.broadcast(nexts),
            F.col("open_ordinal") + F.when(F.col("is_bank_day"), 0).otherwise(1) == F.col("_nord"),
        )
        .filter(F.col("d") <= F.col("hi"))
        .select(
            "d",
            "is_bank_day",
            "open_ordinal",
            "next_open",
            F.date_add("d", 2).alias("t2_naive"),
            "t2_actual",
            F.datediff("t2_actual", F.date_add("d", 2)).alias("slipped_days"),
        )
    )


def event_span(events: DataFrame, before: int = 14, after: int = 14) -> DataFrame:
    """One row with the days a ledger's calendar has to cover."""
    return events.agg(
        F.date_sub(F.min("occurred_at"), before).alias("lo"),
        F.date_add(F.max("occurred_at"), after).alias("hi"),
    )


def add_bank_days(df: DataFrame, day: str, n: int, calendar: DataFrame, into: str) -> DataFrame:
    """The n-th open day strictly after ``day``; n = 0 gives the day itself."""
    if n == 0:
        return df.withColumn(into, F.col(day))
    start = calendar.select(F.col("d").alias("_d"), F.col("open_ordinal").alias("_from"))
    land = calendar.filter("is_bank_day").select(
        F.col("open_ordinal").alias("_to"), F.col("d").alias(into)
    )
    hops = start.join(land, F.col("_from") + n == F.col("_to")).select("_d", into)
    return df.join(F.broadcast(hops), F.col(day) == F.col("_d"), "left").drop("_d")
