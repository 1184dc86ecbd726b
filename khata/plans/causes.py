"""Why captured money is not banked money: seventeen causes, all windows in one plan.

A cause is a function from books to (merchant_id, window_id, cause, amount_paise). Add
one to ``SOURCES`` and to ``CAUSES`` and it takes part in every close.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.operators.linkage import no_unplaced_credit, payouts_not_linked
from khata.operators.movements import WINDOW, in_windows
from khata.plans.books import Books

STALE_DAYS = 3
REFS_SHOWN = 25


@dataclass(frozen=True)
class Cause:
    name: str
    title: str
    account: str
    alarming: bool = False
    permanent: bool = False
    refines: str | None = None
    bucket: str = "cost"
    refs: str | None = None
    event_type: str | None = None


# The causes, the account each one claims, which of them are alarming, gone for
# good, or part of another, and the bucket each falls into. Titles are our own.
CAUSES = (
    Cause("normal_fee", "Fees the contract allows", "fee_expense", permanent=True),
    Cause("fee_rate_increase", "Fees above the contract", "fee_expense", alarming=True, permanent=True, bucket="chase"),
    Cause("gst_on_fee", "GST on fees", "gst_input_credit", permanent=True, bucket="tax"),
    Cause("tds_194o", "TDS under section 194-O", "tds_receivable", bucket="tax"),
    Cause("instant_settlement_fee", "Cost of instant payouts", "fee_expense", permanent=True, event_type="settlement_executed"),
    Cause("bank_charges", "Bank charges", "bank_charges", permanent=True),
    Cause("refunds_issued", "Refunds to customers", "refunds", permanent=True, refs="refunds"),
    Cause("dispute_reserve_held", "Reserve for open disputes", "dispute_reserve", bucket="chase", refs="dispute_reserve"),
    Cause("chargeback_lost", "Disputes lost", "chargeback_loss", alarming=True, permanent=True, bucket="lost", refs="chargeback_loss"),
    Cause("gateway_adjustment", "Adjustments by the gateway", "gateway_adjustments", alarming=True, permanent=True, refs="gateway_adjustments"),
    Cause("other_bank_outflow", "Other payments out of the bank", "other_outflow", permanent=True, refs="other_outflow"),
    Cause("route_split", "Split to linked accounts", "revenue", permanent=True, event_type="route_transfer"),
    Cause("risk_hold", "Net change in held funds", "on_hold", alarming=True, bucket="chase", refs="on_hold"),
    Cause("captured_not_yet_settled", "Captured, not settled yet", "gateway_receivable", bucket="timing"),
    Cause("settlement_in_flight", "Paid out, not in the bank yet", "settlement_in_transit", bucket="timing"),
    Cause("bank_holiday_delay", "Payout pushed back by shut banks", "gateway_receivable", refines="captured_not_yet_settled", bucket="timing"),
    Cause("settlement_never_arrived", "Paid out, never credited", "settlement_in_transit", alarming=True, refines="settlement_in_flight", bucket="chase"),
)
BY_NAME = {c.name: c for c in CAUSES}
_PRICED = ("normal_fee", "fee_rate_increase")
_DERIVED = ("bank_holiday_delay", "settlement_never_arrived")
COLUMNS = [*WINDOW, "cause", "amount_paise"]


def lookup(cause: Column, attribute: str) -> Column:
    """An attribute of a cause as an expression; the table is fixed, so it needs no join."""
    out: Column | None = None
    for c in CAUSES:
        value = F.lit(getattr(c, attribute))
        out = F.when(cause == c.name, value) if out is None else out.when(cause == c.name, value)
    return out


def cause_table(spark: SparkSession) -> DataFrame:
    """The catalogue of causes."""
    schema = "cause string, title string, account string, alarming boolean, permanent boolean, refines string, bucket string"
    rows = [(c.name, c.title, c.account, c.alarming, c.permanent, c.refines, c.bucket) for c in CAUSES]
    return spark.createDataFrame(rows, schema)


def slice_causes(books: Books) -> DataFrame:
    """The causes that are the movement of one account, from one aggregate."""
    cause: Column | None = None
    for c in CAUSES:
        if c.name in _PRICED or c.name in _DERIVED:
            continue
        match = F.col("account") == c.account
        if c.event_type:
            match = match & (F.col("event_type") == c.event_type)
        cause = F.when(match, c.name) if cause is None else cause.when(match, c.name)
    return (
        books.moves.withColumn("cause", cause)
        .filter("cause IS NOT NULL")
        .groupBy(*WINDOW, "cause")
        .agg(F.sum("amount_paise").alias("amount_paise"))
    )


def window_fees(books: Books) -> DataFrame:
    """Fees billed and fees at contract per window and method."""
    return (
        in_windows(books.daily_fees, books.windows)
        .groupBy(*WINDOW, "method")
        .agg(
            F.sum("captures").alias("captures"),
            F.sum("gross_paise").alias("gross_paise"),
            F.sum("fee_paise").alias("fee_paise"),
            F.sum("tax_paise").alias("tax_paise"),
            F.sum("tds_paise").alias("tds_paise"),
            F.sum("contract_paise").alias("contract_paise"),
        )
    )


def fee_causes(books: Books) -> DataFrame:
    """Contract price and excess. Without any contract neither is supported."""
    priced = (
        window_fees(books)
        .join(books.contracts.select("merchant_id").distinct(), "merchant_id", "left_semi")
        .groupBy(*WINDOW)
        .agg(F.sum("contract_paise").alias("at_contract"), F.sum("fee_paise").alias("billed"))
    )
    pair = F.array(
        F.struct(F.lit("normal_fee").alias("cause"), F.col("at_contract").alias("amount_paise")),
        F.struct(F.lit("fee_rate_increase").alias("cause"), (F.col("billed") - F.col("at_contract")).alias("amount_paise")),
    )
    return priced.select(*WINDOW, F.explode(pair).alias("p")).select(*WINDOW, "p.cause", "p.amount_paise")


def _slipped_windows(books: Books) -> DataFrame:
    """Days of a window whose naive T+2 is inside it and whose real one is not."""
    windows = books.windows.withColumn("d", F.explode(F.sequence("window_start", "window_end")))
    days = books.calendar.select("d", "t2_naive", "t2_actual")
    return windows.join(F.broadcast(days), "d").filter("t2_naive <= window_end AND t2_actual > window_end")


def holiday_delay(books: Books) -> DataFrame:
    """Captures held back because the bank was shut, less what was split off them."""
    slipped = _slipped_windows(books).withColumnRenamed("d", "occurred_at")
    cut_off = "known_by" in books.windows.columns
    in_time = F.col("known_by").isNull() | (F.col("recorded_at") <= F.col("known_by")) if cut_off else F.lit(True)
    held = (
        books.daily.filter("account = 'gateway_receivable' AND event_type = 'payment_captured'")
        .join(slipped, ["merchant_id", "occurred_at"])
        .filter(in_time)
        .groupBy(*WINDOW)
        .agg(F.sum("amount_paise").alias("amount_paise"))
    )
    taken = books.events.filter("type = 'payment_captured'").select(
        "merchant_id", F.col("entity_id").alias("payment_id"), "occurred_at", "recorded_at"
    )
    split = books.events.filter("type = 'route_transfer'").select(
        "merchant_id", F.col("counterparty").alias("payment_id"), F.col("event_id").alias("split_id"),
        "amount_paise", F.col("recorded_at").alias("split_recorded"),
    )
    known_split = F.col("known_by").isNull() | (F.col("split_recorded") <= F.col("known_by")) if cut_off else F.lit(True)
    passed_on = (
        taken.join(split, ["merchant_id", "payment_id"])
        .join(slipped, ["merchant_id", "occurred_at"])
        .filter(in_time & known_split)
        .select(*WINDOW, "split_id", "amount_paise")
        .distinct()
        .groupBy(*WINDOW)
        .agg((-F.sum("amount_paise")).alias("amount_paise"))
    )
    return (
        held.unionByName(passed_on)
        .groupBy(*WINDOW)
        .agg(F.sum("amount_paise").alias("amount_paise"))
        .withColumn("cause", F.lit("bank_holiday_delay"))
        .select(*COLUMNS)
    )


def missing_payouts(books: Books, links: DataFrame | None = None, keys: list[str] | None = None,
                    payouts: DataFrame | None = None, credits: DataFrame | None = None) -> DataFrame:
    """Payouts no credit links to and no unplaced credit of that amount could be."""
    links = books.links if links is None else links
    payouts = books.payouts if payouts is None else payouts
    credits = books.credits if credits is None else credits
    return no_unplaced_credit(payouts_not_linked(payouts, links, keys), credits, links, keys)


def never_arrived_payouts(books: Books) -> DataFrame:
    """Missing payouts with the windows that should report them."""
    if "known_by" in books.windows.columns:
        found = _missing_as_known(books)
    else:
        found = in_windows(missing_payouts(books), books.windows)
    return found.filter(F.col("occurred_at") <= F.date_sub("window_end", STALE_DAYS))


def _missing_as_known(books: Books) -> DataFrame:
    """Missing payouts per window from what was recorded when it was signed, however far back that reaches."""
    history = books.history
    asked = in_windows(books.payouts, books.windows).withColumn("known_by", F.coalesce("known_by", F.lit("9999-12-31").cast("date")))
    asked = cut(asked.filter("occurred_at <= known_by").join(history.settled, ["merchant_id", "settlement_id"]), "asked")
    open_then = F.col("settled") > F.col("known_by")
    settled = asked.filter(~open_then).join(missing_payouts(books).select("merchant_id", "settlement_id"), ["merchant_id", "settlement_id"], "left_semi")
    links, credits, paid = history.relinked(asked.filter(open_then), WINDOW)
    missing = missing_payouts(books, links, WINDOW, paid, credits).select(*WINDOW, "settlement_id")
    return settled.unionByName(asked.filter(open_then).join(missing, [*WINDOW, "settlement_id"], "left_semi").select(*settled.columns))


def never_arrived(books: Books) -> DataFrame:
    return (
        never_arrived_payouts(books)
        .groupBy(*WINDOW)
        .agg(F.sum("amount_paise").alias("amount_paise"))
        .withColumn("cause", F.lit("settlement_never_arrived"))
        .select(*COLUMNS)
    )


SOURCES: list[Callable[[Books], DataFrame]] = [slice_causes, fee_causes, holiday_delay, never_arrived]


def measure(books: Books) -> DataFrame:
    """Raw amount of every cause that is not zero, per window."""
    out: DataFrame | None = None
    for source in SOURCES:
        rows = source(books).select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out.filter("amount_paise <> 0")


def refined(raw: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Raw and refined amount per cause: what refines another is taken off it."""
    kept = raw.filter(~F.col("cause").isin(*without)) if without else raw
    parent = lookup(F.col("cause"), "refines")
    rows = F.array(
        F.struct(F.col("cause"), F.col("amount_paise").alias("raw"), F.col("amount_paise").alias("refined")),
        F.when(
            parent.isNotNull() & ~parent.isin(*without) if without else parent.isNotNull(),
            F.struct(parent.alias("cause"), F.lit(0).cast("bigint").alias("raw"), (-F.col("amount_paise")).alias("refined")),
        ),
    )
    return (
        kept.select(*WINDOW, F.explode(rows).alias("r"))
        .filter("r IS NOT NULL")
        .groupBy(*WINDOW, "r.cause")
        .agg(F.sum("r.raw").alias("raw_paise"), F.sum("r.refined").alias("amount_paise"))
    )


def supported(rows: DataFrame) -> Column:
    raw = F.col("raw_paise")
    return F.when(F.col("cause") == "normal_fee", raw > 0).otherwise(raw != 0)


def all_evidence(books: Books, amounts: DataFrame) -> DataFrame:
    """Every cause for every window, supported or not."""
    grid = books.windows.select(*WINDOW, F.explode(F.array(*[F.lit(c.name) for c in CAUSES])).alias("cause"))
    full = grid.join(amounts, [*WINDOW, "cause"], "left")
    for name in ("raw_paise", "amount_paise"):
        full = full.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return full.withColumn("supported", supported(full)).withColumn("title", lookup(F.col("cause"), "title"))


def evidence_refs(books: Books) -> DataFrame:
    """What each finding cites, one row per reference: its account's references, the overcharged
    methods, the shut days, every missing payout."""
    cites = {c.refs: c.name for c in CAUSES if c.refs}
    cause: Column | None = None
    for account, name in cites.items():
        cause = F.when(F.col("account") == account, name) if cause is None else cause.when(F.col("account") == account, name)
    touched = (
        in_windows(books.postings.filter(F.col("account").isin(*cites) & (F.col("ref") != "")), books.windows)
        .withColumn("cause", cause)
        .select(*WINDOW, "cause", "ref")
        .distinct()
    )
    fees = (
        window_fees(books)
        .join(books.contracts.select("merchant_id").distinct(), "merchant_id", "left_semi")
        .filter("fee_paise <> contract_paise")
        .select(*WINDOW, F.lit("fee_rate_increase").alias("cause"), F.col("method").alias("ref"))
    )
    shut = (
        _slipped_windows(books)
        .select(*WINDOW, F.lit("bank_holiday_delay").alias("cause"), F.col("t2_naive").cast("string").alias("ref"))
        .distinct()
    )
    lost = never_arrived_payouts(books).select(
        *WINDOW, F.lit("settlement_never_arrived").alias("cause"), F.col("utr").alias("ref")
    )
    return touched.unionByName(fees).unionByName(shut).unionByName(lost)


def shown_refs(books: Books) -> DataFrame:
    """The references a report shows: of an account's, the first ``REFS_SHOWN`` of a finding; of the others all."""
    listed = F.col("cause").isin(*[c.name for c in CAUSES if c.refs])
    place = F.row_number().over(Window.partitionBy(*WINDOW, "cause").orderBy("ref"))
    return evidence_refs(books).withColumn("_at", place).filter(~listed | (F.col("_at") <= REFS_SHOWN)).drop("_at")
