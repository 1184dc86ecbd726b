"""The whole job: a gateway export, a bank statement and a tax return to closed windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.operators import fees, movements
from khata.operators.calendar import bank_calendar, event_span
from khata.operators.linkage import unattributed_credits
from khata.plans import causes, close, insights, tax
from khata.plans.books import Books
from khata.sources import gateway, gst, statement


class UnreliableInput(Exception):
    """An input that must not be reconciled against."""


@dataclass
class Reconciliation:
    books: Books
    summary: DataFrame
    findings: DataFrame
    coverage: DataFrame
    exceptions: DataFrame
    actions: DataFrame
    risks: DataFrame
    inputs: DataFrame
    refused: DataFrame


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def reconcile(
    spark: SparkSession, exports: str, statements: str, contracts: DataFrame, pulled_on: Column, *,
    refunds: str | None = None, returns: str | None = None, form_26as: DataFrame | None = None,
    holidays: DataFrame | None = None, gateway_gstin: str = "", strict: bool = True, weekly: bool = False,
) -> Reconciliation:
    """Reads files laid out as <merchant>/<file> and closes the period they cover.

    A statement that contradicts its own balance, or a contract that cannot be read,
    stops the job; nothing is reconciled against it. So does a statement or return that
    cannot be read, unless ``strict`` is off: then it is listed in ``refused``.
    """
    bad = fees.invalid_contracts(contracts).select("reason").distinct().take(3)
    if bad:
        raise UnreliableInput("; ".join(sorted(r["reason"] for r in bad)))
    contracts = contracts.withColumn("rate", F.col("rate").cast("decimal(12,6)"))

    items = gateway.read_export(spark, exports)
    kinds = gateway.split_by_kind(items)
    refund_items = None if refunds is None else gateway.read_export(spark, refunds)
    sold = gateway.report_events(kinds["report"], pulled_on, strict=strict).unionByName(
        gateway.payment_events(kinds["payments"], refund_items, strict=strict))

    parsed = statement.load(spark, statements, strict)
    refused = parsed["unreadable"].withColumn("kind", F.lit("statement"))
    told = cut(statement.statement_report(parsed["lines"]), "statement-report")
    broken = [r["file"] for r in told.filter("checked > 0 AND broken > 0").select("file").take(3)]
    if broken:
        raise UnreliableInput(f"statement disagrees with its own balance: {broken}")
    banked = statement.statement_events(parsed["rows"], _folder(F.col("file")))

    events = cut(sold.unionByName(banked), "events")
    calendar = cut(bank_calendar(event_span(events, 14, 40), holidays), "calendar")
    windows = movements.weekly_windows(events) if weekly else movements.whole_period(events)
    books = Books(events, calendar, contracts, cut(windows, "windows"))
    found = close.findings(books)

    invoices = None
    if returns is not None:
        read = gst.load(spark, returns, strict=strict)
        filed = read["invoices"]
        refused = refused.unionByName(read["unreadable"].withColumn("kind", F.lit("return")))
        # a return is for the window its merchant is closed over; weekly windows take invoices by date
        keyed = books.windows.select("merchant_id", "window_id", "window_start", "window_end")
        invoices = filed.join(keyed, "merchant_id")
        if weekly:
            invoices = invoices.filter("invoice_date BETWEEN window_start AND window_end")
        invoices = invoices.drop("window_start", "window_end")
    risks = tax.assess(causes.window_fees(books), invoices, form_26as, gateway_gstin)
    return Reconciliation(
        books, close.close_summary(books), found, close.coverage(books), close.exceptions(books),
        insights.actions(found, books.windows), risks, gateway.input_report(items, events), refused,
    )


def open_credits(result: Reconciliation) -> DataFrame:
    return unattributed_credits(result.books.credits, result.books.links)
