"""Closing windows: findings, the proof that each account is claimed once, and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.operators.linkage import UNPLACED_DAYS, unattributed_credits
from khata.operators.movements import WINDOW, account_movements, in_windows, variance
from khata.plans import causes
from khata.plans.books import Books

CLAIMED = tuple(sorted({c.account for c in causes.CAUSES}))


def findings(books: Books, without: tuple[str, ...] = ()) -> DataFrame:
    """Supported causes with something left after refinement, biggest first within a window."""
    amounts = causes.refined(books.measured, without)
    kept = amounts.filter(causes.supported(amounts)).filter("amount_paise <> 0")
    biggest = Window.partitionBy(*WINDOW).orderBy(F.abs("amount_paise").desc(), "cause")
    cause = F.col("cause")
    return kept.select(
        *WINDOW, "cause", "amount_paise",
        causes.lookup(cause, "title").alias("title"),
        causes.lookup(cause, "alarming").alias("alarming"),
        causes.lookup(cause, "permanent").alias("permanent"),
        # at most one row per cause in a window, so this sorts seventeen rows
        F.row_number().over(biggest).alias("position"),
    )


def coverage(books: Books, without: tuple[str, ...] = ()) -> DataFrame:
    """Per window and account: what the causes claim against what moved."""
    amounts = causes.refined(books.measured, without)
    claimed = (
        amounts.withColumn("account", causes.lookup(F.col("cause"), "account"))
        .groupBy(*WINDOW, "account")
        .agg(F.sum("amount_paise").alias("claimed_paise"))
    )
    moved = account_movements(books.moves).withColumnRenamed("amount_paise", "actual_paise")
    grid = books.windows.select(*WINDOW, F.explode(F.array(*[F.lit(a) for a in CLAIMED])).alias("account"))
    out = grid.join(claimed, [*WINDOW, "account"], "left").join(moved, [*WINDOW, "account"], "left")
    for name in ("claimed_paise", "actual_paise"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out.withColumn("drift_paise", F.col("claimed_paise") - F.col("actual_paise")).withColumn(
        "ok", F.col("drift_paise") == 0
    )


def exceptions(books: Books) -> DataFrame:
    """Credits in a window that were not attributed to a payout."""
    return in_windows(unattributed_credits(books.credits, books.links), books.windows).select(
        *WINDOW, "bank_txn_id", "amount_paise", "occurred_at", "rule", "reason"
    )


def close_summary(books: Books, without: tuple[str, ...] = ()) -> DataFrame:
    """One row per window: the gap, what explains it, what is left, and whether every account is covered."""
    amount = F.col("amount_paise")
    found = findings(books, without).groupBy(*WINDOW).agg(
        F.sum(amount).alias("found_paise"),
        F.count("*").alias("findings"),
        F.count_if("alarming").alias("alarms"),
        F.coalesce(F.sum(F.when(F.col("permanent"), amount)), F.lit(0)).alias("permanent_paise"),
    )
    covered = coverage(books, without).groupBy(*WINDOW).agg(F.count_if(~F.col("ok")).alias("accounts_open"))
    open_items = exceptions(books).groupBy(*WINDOW).agg(
        F.count("*").alias("exceptions"), F.sum(amount).alias("unresolved_paise")
    )
    out = (
        variance(books.moves, books.windows)
        .drop("explained_paise", "remainder_paise", "closes")
        .join(found, WINDOW, "left")
        .join(covered, WINDOW, "left")
        .join(open_items, WINDOW, "left")
    )
    for name in ("found_paise", "findings", "alarms", "permanent_paise", "exceptions", "unresolved_paise"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    share: Column = F.when(F.col("gap_paise") == 0, F.lit(1.0)).otherwise(
        1 - F.abs("remainder_paise") / F.abs("gap_paise")
    )
    return (
        out.withColumnRenamed("found_paise", "explained_paise")
        .withColumn("remainder_paise", F.col("gap_paise") - F.col("explained_paise"))
        .withColumn("closes", F.col("remainder_paise") == 0)
        .withColumn("explained_fraction", F.round(share, 6))
        .withColumn("fully_covered", F.col("accounts_open") == 0)
        .withColumn("checked", F.lit(len(causes.CAUSES) - len(without)))
        .drop("accounts_open")
    )


def flagship(books: Books) -> DataFrame:
    """Per merchant and week: captured, landed, gap, what explains it; the remainder must be zero."""
    return close_summary(books).orderBy("merchant_id", "window_id")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def evidence_sql(found: DataFrame) -> DataFrame:
    """Adds a query that recomputes what a finding rests on, before anything that refines it is taken off.

    It reads the views ``postings``, ``events``, ``calendar``, ``contracts`` and ``credit_links``; nothing but literals of the finding stands in it.
    """
    end = _text("DATE '", F.col("window_end").cast("string"), "'")
    merchant = F.replace(F.col("merchant_id"), F.lit("'"), F.lit("''"))

    def span(rows: str) -> Column:
        return _text(f"{rows}.merchant_id = '", merchant, f"' AND {rows}.occurred_at BETWEEN DATE '", F.col("window_start").cast("string"), "' AND ", end)

    total = "SELECT coalesce(sum({}), 0) AS amount_paise FROM "
    priced = "CAST(round(CAST(e.amount_paise AS DECIMAL(20,0)) * c.rate / 100, 0) AS BIGINT)"
    contract = "JOIN contracts c ON c.merchant_id = e.merchant_id AND c.method = e.method WHERE e.type = 'payment_captured' AND "
    slipped = _text("c.t2_naive <= ", end, " AND c.t2_actual > ", end)
    made = {
        "normal_fee": _text(total.format(priced), "events e ", contract, span("e")),
        "fee_rate_increase": _text(total.format(f"e.fee_paise - coalesce({priced}, 0)"), "events e LEFT ", contract, span("e")),
        "bank_holiday_delay": _text(
            "SELECT coalesce((SELECT sum(p.amount_paise) FROM postings p JOIN calendar c ON c.d = p.occurred_at WHERE p.account = 'gateway_receivable' "
            "AND p.event_type = 'payment_captured' AND ", span("p"), " AND ", slipped, "), 0) - coalesce((SELECT sum(t.amount_paise) FROM events t "
            "JOIN events p ON p.merchant_id = t.merchant_id AND p.entity_id = t.counterparty AND p.type = 'payment_captured' "
            "JOIN calendar c ON c.d = p.occurred_at WHERE t.type = 'route_transfer' AND ", span("p"), " AND ", slipped, "), 0) AS amount_paise"),
        "settlement_never_arrived": _text(
            total.format("p.amount_paise"), "events p WHERE p.type = 'settlement_executed' AND ", span("p"), " AND p.occurred_at <= date_sub(", end,
            f", {causes.STALE_DAYS}) AND NOT EXISTS (SELECT 1 FROM credit_links l WHERE l.merchant_id = p.merchant_id AND l.settlement_id = p.entity_id) "
            "AND NOT EXISTS (SELECT 1 FROM events b JOIN credit_links l ON l.merchant_id = b.merchant_id AND l.bank_txn_id = b.entity_id AND l.settlement_id IS NULL "
            "WHERE b.type = 'bank_credit_received' AND b.merchant_id = p.merchant_id AND b.amount_paise = p.amount_paise "
            f"AND b.occurred_at BETWEEN date_sub(p.occurred_at, {UNPLACED_DAYS}) AND date_add(p.occurred_at, {UNPLACED_DAYS}))"),
    }
    text: Column | None = None
    for c in causes.CAUSES:
        kind = f" AND p.event_type = '{c.event_type}'" if c.event_type else ""
        slice_of_books = _text(total.format("p.amount_paise"), f"postings p WHERE p.account = '{c.account}'{kind} AND ", span("p"))
        body, match = made.get(c.name, slice_of_books), F.col("cause") == c.name
        text = F.when(match, body) if text is None else text.when(match, body)
    return found.withColumn("evidence_sql", text)


def drill_down(books: Books, found: DataFrame) -> DataFrame:
    """The postings behind every finding (merchant_id, window_id, cause) that is a slice of the books: those of its account and event type."""
    slices = [(c.name, c.account, c.event_type) for c in causes.CAUSES if c.name not in causes._PRICED + causes._DERIVED]
    kinds = found.sparkSession.createDataFrame(slices, "cause string, account string, kind string")
    # thirteen fixed rows
    asked = found.select(*WINDOW, "cause").join(F.broadcast(kinds), "cause")
    touched = in_windows(books.postings, books.windows).select(*WINDOW, "event_id", "account", "event_type", "occurred_at", "amount_paise", "ref")
    return touched.join(asked, [*WINDOW, "account"]).filter("kind IS NULL OR kind = event_type").select(
        *WINDOW, "cause", "event_id", "account", "occurred_at", "amount_paise", "ref")
