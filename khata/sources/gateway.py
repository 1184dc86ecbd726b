"""Gateway exports: the settlement report, the payments export and the refunds export.

The two money conventions differ and are never mixed: the report's fee excludes tax,
the payments export's fee includes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.dates import date_from_epoch
from khata.operators import payouts
from khata.schemas import COVERS, EVENTS, METHODS, conform, event_row

# Personal fields (email, contact, vpa, customer_id, card_id, notes) are not in the read
# schema, so they never enter the session.
ITEM = (
    "id string, entity string, entity_id string, type string, status string, amount bigint, debit bigint, credit bigint, "
    "fee bigint, tax bigint, amount_refunded bigint, currency string, created_at bigint, settled_at bigint, "
    "settlement_id string, settlement_utr string, order_id string, payment_id string, description string, "
    "method string, card_network string, error_code string, speed_processed string"
)
EXPORT = f"entity string, count bigint, items array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>"
PERSONAL = ("email", "contact", "vpa", "customer_id", "card_id", "notes")

# Row types of the report and states of a payment.
REPORT_TYPES = ("payment", "refund", "transfer", "adjustment")
PAYMENT_STATES = ("created", "authorized", "captured", "refunded", "failed")


class RefusedLoad(Exception):
    """A strict load met rows it must not guess about."""


def read_export(spark: SparkSession, path: str, merchant: Column | None = None) -> DataFrame:
    """One row per item with its file and place in it. ``merchant`` defaults to the file's folder."""
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    raw = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    return raw.select(
        (folder if merchant is None else merchant).alias("merchant_id"),
        F.col("_metadata.file_path").alias("file"),
        F.posexplode("items").alias("position", "item"),
    ).select("merchant_id", "file", "position", "item.*")


def export_kinds(items: DataFrame) -> DataFrame:
    """Per file: a payments export as soon as one row calls itself a payment, else a settlement report."""
    payment = F.max(F.coalesce(F.col("entity") == "payment", F.lit(False)))
    return items.groupBy("file").agg(F.when(payment, "payments").otherwise("report").alias("kind"))


def split_by_kind(items: DataFrame) -> dict[str, DataFrame]:
    marked = items.join(export_kinds(items), "file")
    return {kind: marked.filter(F.col("kind") == kind).drop("kind") for kind in ("payments", "report")}


def _foreign(currency: str) -> Column:
    return F.coalesce("currency", F.lit(currency)) != currency


def refuse_if_any(rejects: DataFrame, what: str) -> None:
    """Strict loads stop here; a handful of reasons is all that reaches the driver."""
    shown = [row["reason"] for row in rejects.select("reason").distinct().take(5)]
    if shown:
        raise RefusedLoad(f"{what}: {'; '.join(sorted(shown))}")


# --- settlement report -------------------------------------------------------------------


def report_rejects(items: DataFrame, currency: str = "INR", strict: bool = True) -> DataFrame:
    """Rows the report cannot be booked from, with the reason."""
    kind = F.col("type")
    unknown = kind.isNotNull() & ~kind.isin(*REPORT_TYPES) if strict else ~F.coalesce(kind.isin(*REPORT_TYPES), F.lit(False))
    reason = F.when(_foreign(currency), F.concat(F.lit("foreign currency "), "currency")).when(
        unknown, F.concat(F.lit("unmapped row type "), F.coalesce(kind, F.lit("none")))
    )
    return items.withColumn("reason", reason).filter("reason IS NOT NULL")


def credit_adjustments(items: DataFrame) -> DataFrame:
    """Adjustments in the merchant's favour: they raise the payout but have no posting, so they are listed."""
    return items.filter("type = 'adjustment' AND coalesce(debit, 0) = 0 AND coalesce(credit, 0) <> 0").withColumn(
        "reason", F.lit("adjustment in the merchant's favour has no posting")
    )


def _usable(items: DataFrame, currency: str, strict: bool) -> DataFrame:
    if strict:
        refuse_if_any(report_rejects(items, currency), "settlement report")
        return items
    known = F.coalesce(F.col("type").isin(*REPORT_TYPES), F.lit(False))
    return items.filter(~_foreign(currency) & known)


def _entity(items: DataFrame) -> DataFrame:
    named = F.when(F.coalesce("entity_id", F.lit("")) != "", F.col("entity_id"))
    return items.withColumn(
        "entity_id", F.coalesce(named, F.concat(F.lit("unknown_"), F.col("position").cast("string")))
    )


def report_events(items: DataFrame, pulled_on: Column, currency: str = "INR", strict: bool = True) -> DataFrame:
    """Settlement report -> events. ``pulled_on`` is the day the report was fetched."""
    rows = _entity(_usable(items, currency, strict))
    zero = F.lit(0).cast("bigint")
    entity, kind = F.col("entity_id"), F.col("type")
    occurred = date_from_epoch(F.col("created_at"), pulled_on)

    def some(name: str) -> Column:
        return F.coalesce(F.col(name), zero)

    def event(event_type: str, tag: str, amount: Column, **more: Column) -> Column:
        return event_row(
            merchant_id=F.col("merchant_id"), event_id=F.concat(F.lit(tag), entity), type=F.lit(event_type),
            occurred_at=occurred, recorded_at=pulled_on, entity_id=entity, amount_paise=amount,
            currency=F.lit(currency), **more,
        )

    blank = F.lit("")
    method = F.when(F.col("method").isin(*METHODS), F.col("method")).otherwise("netbanking")
    made = (
        F.when(kind == "payment", event(
            "payment_captured", "cap-", some("amount"), method=method, fee_paise=some("fee"), tax_paise=some("tax"),
            tds_paise=zero, counterparty=F.coalesce("order_id", blank)))
        .when(kind == "refund", event(
            "refund_issued", "ref-", some("amount"), counterparty=F.coalesce("payment_id", blank), detail=F.lit("normal")))
        .when(kind == "transfer", event(
            "route_transfer", "trf-", some("amount"), counterparty=F.coalesce("payment_id", blank),
            detail=F.when(F.col("description") != "", F.col("description")).otherwise("linked account")))
        .when((kind == "adjustment") & (some("debit") != 0), event(
            "gateway_adjustment", "adj-", some("debit"),
            detail=F.when(F.col("description") != "", F.col("description")).otherwise("gateway adjustment")))
    )
    from_items = rows.select(made.alias("e")).filter("e IS NOT NULL").select("e.*")
    paid = payouts.rebuild(rows.withColumn("position", F.struct("file", "position")))
    settled = date_from_epoch(F.col("settled_at"), pulled_on)
    from_payouts = paid.select(
        event_row(
            merchant_id=F.col("merchant_id"), event_id=F.concat(F.lit("setl-"), "settlement_id"),
            type=F.lit("settlement_executed"), occurred_at=settled, recorded_at=pulled_on,
            entity_id=F.col("settlement_id"), amount_paise=F.col("net_paise"), fee_paise=zero, utr=F.col("utr"),
            currency=F.lit(currency),
        ).alias("e")
    ).select("e.*")
    return conform(from_items.unionByName(from_payouts), EVENTS)


def report_covers(items: DataFrame, pulled_on: Column, currency: str = "INR", strict: bool = True) -> DataFrame:
    """Which items each payout of the report covers."""
    rows = _entity(_usable(items, currency, strict)).withColumn("position", F.struct("file", "position"))
    covers = payouts.covered(rows)
    out = covers.withColumn("settled_on", date_from_epoch(F.col("settled_at"), pulled_on))
    return conform(out.withColumn("recorded_at", pulled_on), COVERS)


# --- payments and refunds exports ------------------------------------------------------------


def payment_rejects(items: DataFrame, refunds: DataFrame | None = None, currency: str = "INR") -> DataFrame:
    """Payments that cannot be booked without guessing, with the reason."""
    tax, fee = F.coalesce("tax", F.lit(0)), F.coalesce("fee", F.lit(0))
    took = F.col("status").isin("captured", "refunded")
    reason = (
        F.when(_foreign(currency), F.concat(F.lit("foreign currency "), "currency"))
        .when(~F.coalesce(F.col("status").isin(*PAYMENT_STATES), F.lit(False)), F.concat(F.lit("unmapped status "), F.coalesce("status", F.lit("none"))))
        .when(F.coalesce("id", F.lit("")) == "", "payment without an id")
        .when(~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)), F.concat(F.lit("unmapped method "), F.coalesce("method", F.lit("none"))))
        .when(took & (tax > fee), "tax is more than the fee it is part of")
    )
    rows = items.withColumn("reason", reason).filter("reason IS NOT NULL")
    due = items.filter("coalesce(amount_refunded, 0) <> 0")
    if refunds is None:
        missing = due
    else:
        seen = refunds.filter("status IS DISTINCT FROM 'failed'").select("merchant_id", F.col("payment_id").alias("id"))
        missing = due.join(seen, ["merchant_id", "id"], "left_anti").select(*items.columns)
    return rows.unionByName(missing.withColumn("reason", F.lit("reports a refund but no refund row was supplied")))


def payment_events(
    items: DataFrame, refunds: DataFrame | None = None, currency: str = "INR", strict: bool = True
) -> DataFrame:
    """Payments export -> events; the ledger keeps fee and tax apart, so the fee is what was billed less tax."""
    bad_row = F.coalesce("id", F.lit("")) == ""
    too_much = F.col("status").isin("captured", "refunded") & (F.coalesce("tax", F.lit(0)) > F.coalesce("fee", F.lit(0)))
    if strict:
        refuse_if_any(payment_rejects(items, refunds, currency), "payments export")
        rows = items
    else:
        rows = items.filter(
            ~_foreign(currency) & F.coalesce(F.col("status").isin(*PAYMENT_STATES), F.lit(False))
        )
        # these two are refused in either mode
        refuse_if_any(
            rows.withColumn("reason", F.when(bad_row, "payment without an id").when(too_much, "tax is more than the fee it is part of"))
            .filter("reason IS NOT NULL"), "payments export")
        rows = rows.filter(F.coalesce(F.col("method").isin(*METHODS), F.lit(False)))
    zero = F.lit(0).cast("bigint")
    day = date_from_epoch(F.col("created_at"), F.lit(None).cast("date"))
    tax = F.coalesce("tax", zero)

    def event(event_type: str, **more: Column) -> Column:
        return event_row(
            merchant_id=F.col("merchant_id"), event_id=F.col("id"), type=F.lit(event_type), occurred_at=day,
            recorded_at=day, entity_id=F.col("id"), counterparty=F.coalesce("order_id", F.lit("")),
            method=F.col("method"), amount_paise=F.coalesce("amount", zero), currency=F.lit(currency), **more,
        )

    made = F.when(
        F.col("status").isin("captured", "refunded"),
        event("payment_captured", fee_paise=F.coalesce("fee", zero) - tax, tax_paise=tax, tds_paise=zero),
    ).when(F.col("status") == "failed", event("payment_failed", detail=F.coalesce("error_code", F.lit("unknown"))))
    out = rows.select(made.alias("e")).filter("e IS NOT NULL").select("e.*")
    return out if refunds is None else out.unionByName(refund_events(refunds, currency, strict))


def refund_events(items: DataFrame, currency: str = "INR", strict: bool = True) -> DataFrame:
    """Refunds export -> events; failed refunds moved no money."""
    incomplete = (F.coalesce("id", F.lit("")) == "") | (F.coalesce("payment_id", F.lit("")) == "")
    live = items.filter("status IS DISTINCT FROM 'failed'")
    reason = F.when(_foreign(currency), "foreign currency") if strict else F.lit(None).cast("string")
    refused = items.withColumn("reason", reason).filter("reason IS NOT NULL")
    kept = live if strict else live.filter(~_foreign(currency))
    nameless = kept.withColumn("reason", F.when(incomplete, "refund without an id or payment")).filter("reason IS NOT NULL")
    refuse_if_any(refused.unionByName(nameless), "refunds export")
    day = date_from_epoch(F.col("created_at"), F.lit(None).cast("date"))
    fast = F.coalesce(F.col("speed_processed") == "optimum", F.lit(False))
    return kept.select(
        event_row(
            merchant_id=F.col("merchant_id"), event_id=F.col("id"), type=F.lit("refund_issued"), occurred_at=day,
            recorded_at=day, entity_id=F.col("id"), counterparty=F.col("payment_id"),
            amount_paise=F.coalesce("amount", F.lit(0)), detail=F.when(fast, "instant").otherwise("normal"),
            currency=F.lit(currency),
        ).alias("e")
    ).select("e.*")


def input_report(items: DataFrame, events: DataFrame, currency: str = "INR") -> DataFrame:
    """What came in and what became of it: rows in, rows in other currencies, events out, period."""
    came = items.groupBy("merchant_id").agg(
        F.count("*").alias("rows_in"), F.count_if(_foreign(currency)).alias("foreign_rows")
    )
    made = events.groupBy("merchant_id").agg(
        F.count("*").alias("events"), F.min("occurred_at").alias("first_day"), F.max("occurred_at").alias("last_day")
    )
    return came.join(made, "merchant_id", "full_outer")
