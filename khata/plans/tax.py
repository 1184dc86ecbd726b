"""Tax the merchant has paid but may not be able to claim. Outside the gap identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.text import is_gstin
from khata.operators.movements import WINDOW


def total_tax(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn(
        "tax_paise", F.col("igst_paise") + F.col("cgst_paise") + F.col("sgst_paise") + F.col("cess_paise")
    )


def supplier_credit(invoices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Input credit available per supplier; tax numbers compare without case."""
    keys = keys or ["merchant_id"]
    return total_tax(invoices).groupBy(*keys, F.upper("supplier_gstin").alias("supplier_gstin")).agg(
        F.count("*").alias("invoices"), F.sum("tax_paise").alias("credit_paise")
    )


def gst_shortfall(fees: DataFrame, invoices: DataFrame, gateway_gstin: str) -> DataFrame:
    """Tax charged on fees in a window less what the gateway's invoices let the merchant claim.

    ``fees`` has the window's ``tax_paise``; ``invoices`` carries the window its return is for.
    """
    paid = fees.groupBy(*WINDOW).agg(F.sum("tax_paise").alias("paid_paise")).filter("paid_paise <> 0")
    filed = (
        supplier_credit(invoices, WINDOW)
        .filter(F.col("supplier_gstin") == gateway_gstin.upper())
        .select(*WINDOW, "credit_paise")
    )
    joined = paid.join(filed, WINDOW, "left").withColumn("credit_paise", F.coalesce("credit_paise", F.lit(0)))
    return joined.select(
        *WINDOW, F.lit("gst_input_credit").alias("kind"),
        F.greatest(F.col("paid_paise") - F.col("credit_paise"), F.lit(0)).alias("amount_paise"),
        F.col("paid_paise"), F.col("credit_paise").alias("shown_paise"),
    )


def malformed_gstins(invoices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Credit that sits against supplier numbers which cannot be right."""
    keys = keys or WINDOW
    bad = total_tax(invoices).filter(~is_gstin(F.col("supplier_gstin")))
    return bad.groupBy(*keys).agg(F.count("*").alias("invoices"), F.sum("tax_paise").alias("amount_paise")).withColumn(
        "kind", F.lit("malformed_gstin")
    )


def tds_gap(fees: DataFrame, form_26as: DataFrame | None = None) -> DataFrame:
    """TDS withheld in a window less what the tax office shows; all of it while nothing is shown."""
    withheld = fees.groupBy(*WINDOW).agg(F.sum("tds_paise").alias("paid_paise")).filter("paid_paise <> 0")
    if form_26as is None:
        joined = withheld.withColumn("shown_paise", F.lit(None).cast("bigint"))
    else:
        joined = withheld.join(
            form_26as.select(*WINDOW, F.col("amount_paise").alias("shown_paise")), WINDOW, "left"
        )
    gap = F.greatest(F.col("paid_paise") - F.coalesce("shown_paise", F.lit(0)), F.lit(0))
    return joined.select(
        *WINDOW, F.lit("tds_194o").alias("kind"), gap.alias("amount_paise"), "paid_paise", "shown_paise"
    )


def assess(fees: DataFrame, invoices: DataFrame | None, form_26as: DataFrame | None, gateway_gstin: str) -> DataFrame:
    """Every tax risk of a window, biggest first."""
    columns = [*WINDOW, "kind", "amount_paise"]
    out = tds_gap(fees, form_26as).select(*columns)
    if invoices is not None:
        out = out.unionByName(gst_shortfall(fees, invoices, gateway_gstin).select(*columns))
        out = out.unionByName(malformed_gstins(invoices).select(*columns))
    # three kinds at most per window
    biggest = Window.partitionBy(*WINDOW).orderBy(F.abs("amount_paise").desc(), "kind")
    return out.withColumn("position", F.row_number().over(biggest))
