"""GST returns, as the portal's JSON or as a CSV export; the content decides which it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.dates import RETURN_LAYOUTS, parse_date
from khata.functions.money import paise_or_zero
from khata.lineage import cut
from khata.schemas import INVOICES, conform
from khata.sources import delimited
from khata.sources.delimited import cell

_DETAIL = "txval:string, igst:string, cgst:string, sgst:string, cess:string"
_ITEM = f"struct<itm_det:struct<{_DETAIL}>, {_DETAIL}>"
_B2B = f"array<struct<ctin:string, trdnm:string, inv:array<struct<inum:string, dt:string, val:string, itms:array<{_ITEM}>>>>>"
_INNER = f"rtnprd:string, gstin:string, docdata:struct<b2b:{_B2B}>"
RETURN = f"struct<data:struct<{_INNER}>, {_INNER}>"

# How exports head each column (letters and digits only).
COLUMNS = {
    "supplier_gstin": ("gstinofsupplier", "suppliergstin", "ctin", "gstin"),
    "supplier_name": ("tradelegalname", "suppliername", "tradename", "legalname"),
    "invoice_no": ("invoicenumber", "invoiceno", "documentnumber", "inum"),
    "invoice_date": ("invoicedate", "documentdate", "date"),
    "taxable_value": ("taxablevalue", "taxablevaluers", "txval"),
    "igst": ("integratedtaxrs", "integratedtax", "igst"),
    "cgst": ("centraltaxrs", "centraltax", "cgst"),
    "sgst": ("stateutterritorytaxrs", "stateutterritorytax", "stateuttaxrs", "stateuttax", "statetaxrs", "statetax",
             "sgst", "sgstutgst"),
    "cess": ("cessrs", "cess"),
}
HEADER_LINES = 30
_TAXES = ("igst", "cgst", "sgst", "cess")


def is_json(content: Column) -> Column:
    return F.substring(F.ltrim(F.regexp_replace(delimited.decoded(content), r"^\s+", "")), 1, 1).isin("{", "[")


def json_invoices(files: DataFrame) -> DataFrame:
    """Suppliers, their invoices and the items of each, summed to one row per invoice.

    An invoice's place in its file keeps two of the same number apart.
    """
    read = files.select("file", F.from_json(delimited.decoded(F.col("content")), RETURN).alias("r"))
    body = F.coalesce("r.data.docdata.b2b", "r.docdata.b2b")
    invoices = (
        read.select("file", F.posexplode(body).alias("_supplier", "s"))
        .select("file", "_supplier", "s.ctin", "s.trdnm", F.posexplode("s.inv").alias("_invoice", "i"))
        .select("file", F.coalesce("ctin", F.lit("")).alias("supplier_gstin"), F.coalesce("trdnm", F.lit("")).alias("supplier_name"), "i")
    )

    def total(name: str) -> Column:
        items = F.coalesce("i.itms", F.array().cast(f"array<{_ITEM}>"))
        value = lambda it: paise_or_zero(F.when(it["itm_det"].isNotNull(), it["itm_det"][name]).otherwise(it[name]))
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, it: acc + value(it))

    return invoices.select(
        "file", "supplier_gstin", "supplier_name", F.coalesce("i.inum", F.lit("")).alias("invoice_no"),
        parse_date(F.col("i.dt"), RETURN_LAYOUTS).alias("invoice_date"), total("txval").alias("taxable_paise"),
        *[total(t).alias(f"{t}_paise") for t in _TAXES],
    )


def csv_invoices(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoices, and (file, reason) of files without a header."""
    rows = cut(delimited.cells(files), "return-cells")
    enough = F.col("supplier_gstin").isNotNull() & F.col("invoice_no").isNotNull()
    heads = delimited.best_header(rows, COLUMNS, delimited.named_roles(COLUMNS), HEADER_LINES, enough, None)
    heads = cut(heads, "return-heads")
    headless = files.select("file").join(heads.filter("readable").select("file"), "file", "left_anti")
    body = rows.join(heads.filter("readable"), "file").filter("line > header_line")
    invoices = body.select(
        "file", cell("supplier_gstin").alias("supplier_gstin"), cell("supplier_name").alias("supplier_name"),
        cell("invoice_no").alias("invoice_no"), parse_date(cell("invoice_date"), RETURN_LAYOUTS).alias("invoice_date"),
        paise_or_zero(cell("taxable_value")).alias("taxable_paise"),
        *[paise_or_zero(cell(t)).alias(f"{t}_paise") for t in _TAXES],
    )
    return invoices, headless.select("file", F.lit("neither a return in JSON nor a table with its columns").alias("reason"))


def parse(files: DataFrame, merchant: Column | None = None) -> dict[str, DataFrame]:
    """Return files -> ``invoices``, ``skipped`` and ``unreadable``; ``merchant`` defaults to the file's folder.

    What looks like JSON but is not a return is tried as a table, as an export may start with a bracket.
    """
    a_return = F.from_json(delimited.decoded(F.col("content")), RETURN)
    marked = files.withColumn("_json", is_json(F.col("content")) & F.coalesce(a_return["data"]["docdata"].isNotNull() | a_return["docdata"].isNotNull(), F.lit(False)))
    tables, headless = csv_invoices(marked.filter("NOT _json").drop("_json"))
    every = json_invoices(marked.filter("_json").drop("_json")).unionByName(tables)
    folder = F.element_at(F.split("file", "/"), -2)
    every = every.withColumn("merchant_id", folder if merchant is None else merchant)
    readable = F.col("invoice_date").isNotNull() & (F.col("supplier_gstin") != "")
    return {
        "invoices": conform(every.filter(readable), INVOICES),
        "skipped": every.filter(~readable).select(
            "file", "supplier_gstin", "invoice_no", F.lit("unreadable date or no supplier").alias("reason")
        ),
        "unreadable": headless,
    }


def load(spark: SparkSession, path: str, merchant: Column | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """Parsed returns of a folder. A strict load stops at files that cannot be read; a lenient one lists them."""
    parsed = parse(delimited.read_files(spark, path, strict), merchant)
    if strict:
        bad = [r["file"] for r in parsed["unreadable"].select("file").take(3)]
        if bad:
            raise delimited.RefusedFile(f"not a return: {bad}")
        return parsed
    return parsed | {"unreadable": parsed["unreadable"].unionByName(delimited.oversized(spark, path))}
