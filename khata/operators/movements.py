"""Balances and movements. Everything reads one table of sums per merchant and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.schemas import ACCOUNTS

# Accounts whose movement is the thing being explained, not an explanation.
SUBJECT = ("revenue", "bank")


def daily_movements(postings: DataFrame) -> DataFrame:
    """Sums per merchant, both clocks, account and event type.

    Partial aggregation shrinks even a very large merchant to a few rows per day before
    anything is shuffled; every slice, balance and window below starts here.
    """
    return postings.groupBy("merchant_id", "occurred_at", "recorded_at", "account", "event_type").agg(
        F.sum("amount_paise").alias("amount_paise"), F.count("*").alias("n")
    )


def weekly_windows(events: DataFrame, truncate: bool = True) -> DataFrame:
    """Seven-day windows from each merchant's first day; the last one ends with the data or runs on."""
    span = events.groupBy("merchant_id").agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    week = span.select(
        "merchant_id", "lo", "hi",
        F.explode(F.sequence(F.lit(0), F.floor(F.datediff("hi", "lo") / 7).cast("int"))).alias("window_id"),
    )
    start = F.date_add("lo", F.col("window_id") * 7)
    end = F.date_add(start, 6)
    return week.select(
        "merchant_id", "window_id", start.alias("window_start"),
        (F.least(end, F.col("hi")) if truncate else end).alias("window_end"),
    )


def whole_period(events: DataFrame) -> DataFrame:
    """One window per merchant over everything it has."""
    return events.groupBy("merchant_id").agg(
        F.lit(0).alias("window_id"), F.min("occurred_at").alias("window_start"), F.max("occurred_at").alias("window_end")
    )


def in_windows(rows: DataFrame, windows: DataFrame, day: str = "occurred_at") -> DataFrame:
    """Rows with each window their day falls into; equi-join on (merchant, day).

    Where ``windows`` carries ``known_by``, rows recorded later are left out of it.
    """
    spread = windows.withColumn("_day", F.explode(F.sequence("window_start", "window_end")))
    joined = rows.join(
        spread, (rows["merchant_id"] == spread["merchant_id"]) & (rows[day] == spread["_day"])
    ).drop(spread["merchant_id"]).drop("_day")
    if "known_by" in windows.columns:
        joined = joined.filter(F.col("known_by").isNull() | (F.col("recorded_at") <= F.col("known_by")))
    return joined


WINDOW = ["merchant_id", "window_id"]


def window_movements(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Sums per window, account and event type."""
    return (
        in_windows(daily, windows)
        .groupBy(*WINDOW, "account", "event_type")
        .agg(F.sum("amount_paise").alias("amount_paise"), F.sum("n").alias("n"))
    )


def movement_slices(moves: DataFrame) -> DataFrame:
    """Both levels at once: per account, and per account and event type (NULL event_type = whole account)."""
    return (
        moves.rollup("merchant_id", "window_id", "account", "event_type")
        .agg(F.sum("amount_paise").alias("amount_paise"), F.grouping_id().alias("_level"))
        .filter("_level <= 1")
        .drop("_level")
    )


def balances(daily: DataFrame) -> DataFrame:
    return daily.groupBy("merchant_id", "account").agg(F.sum("amount_paise").alias("balance_paise"))


def known(rows: DataFrame, occurred_by: Column, known_by: Column | None = None) -> DataFrame:
    """The ledger as it stood: happened by one day and, if given, recorded by another."""
    out = rows.filter(F.col("occurred_at") <= occurred_by)
    return out if known_by is None else out.filter(F.col("recorded_at") <= known_by)


def balance_delta(now: DataFrame, then: DataFrame) -> DataFrame:
    """What moved between two balance tables, account by account, zeros dropped."""
    later = now.select("merchant_id", "account", F.col("balance_paise").alias("_now"))
    earlier = then.select("merchant_id", "account", F.col("balance_paise").alias("_then"))
    delta = F.coalesce("_now", F.lit(0)) - F.coalesce("_then", F.lit(0))
    return (
        later.join(earlier, ["merchant_id", "account"], "full_outer")
        .select("merchant_id", "account", delta.alias("delta_paise"))
        .filter("delta_paise <> 0")
    )


def cash_position(daily: DataFrame) -> DataFrame:
    """What is in the bank, on its way, and blocked, per merchant."""
    names = [name for name, _, _ in ACCOUNTS]
    wide = daily.groupBy("merchant_id").pivot("account", names).agg(F.sum("amount_paise"))

    def at(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return wide.select(
        "merchant_id",
        at("bank").alias("available_paise"),
        at("settlement_in_transit").alias("in_transit_paise"),
        at("gateway_receivable").alias("receivable_paise"),
        at("on_hold").alias("on_hold_paise"),
        at("dispute_reserve").alias("dispute_reserve_paise"),
        (at("settlement_in_transit") + at("gateway_receivable")).alias("expected_soon_paise"),
        (at("on_hold") + at("dispute_reserve")).alias("blocked_paise"),
    )


def account_movements(moves: DataFrame) -> DataFrame:
    """What each account moved in a window; revenue counts only what was split off to others."""
    split = (F.col("account") == "revenue") & (F.col("event_type") == "route_transfer")
    return (
        moves.filter(~F.col("account").isin(*SUBJECT) | split)
        .groupBy(*WINDOW, "account")
        .agg(F.sum("amount_paise").alias("amount_paise"))
        .filter("amount_paise <> 0")
    )


def variance(moves: DataFrame, windows: DataFrame) -> DataFrame:
    """Captured against landed per window, and whether the account movements explain the gap."""
    account, kind, amount = F.col("account"), F.col("event_type"), F.col("amount_paise")
    split = (account == "revenue") & (kind == "route_transfer")

    def total(when: Column, sign: int = 1) -> Column:
        return F.coalesce(F.sum(F.when(when, amount * sign)), F.lit(0))

    sums = moves.groupBy(*WINDOW).agg(
        total((account == "revenue") & (kind == "payment_captured"), -1).alias("gross_paise"),
        total((account == "bank") & (kind == "bank_credit_received")).alias("credits_paise"),
        total(account == "bank").alias("landed_paise"),
        total(~account.isin(*SUBJECT) | split).alias("explained_paise"),
    )
    figures = ["gross_paise", "credits_paise", "landed_paise", "explained_paise"]
    full = windows.select(*WINDOW, "window_start", "window_end").join(sums, WINDOW, "left")
    for name in figures:
        full = full.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    gap = F.col("gross_paise") - F.col("landed_paise")
    return (
        full.withColumn("gap_paise", gap)
        .withColumn("remainder_paise", gap - F.col("explained_paise"))
        .withColumn("closes", F.col("remainder_paise") == 0)
    )
