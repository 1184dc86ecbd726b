"""A sealed close: every figure of a window as lines, and one digest over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions.money import money_text
from khata.operators.log import roots
from khata.operators.movements import WINDOW
from khata.plans import causes
from khata.plans.books import Books
from khata.plans.close import close_summary, coverage, exceptions, findings


def _lines(frame: DataFrame, section: str, key: str, columns: list[str]) -> DataFrame:
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return frame.select(*WINDOW, F.lit(section).alias("section"), F.col(key).alias("item"), body.alias("body"))


def pack_lines(books: Books, risks: DataFrame | None = None) -> DataFrame:
    """Findings, exceptions, the account proof, cited references and risks, one line each."""
    out = _lines(
        findings(books).withColumn("display", money_text(F.col("amount_paise"))), "finding", "cause",
        ["cause", "amount_paise", "display", "alarming", "permanent"])
    out = out.unionByName(_lines(exceptions(books), "exception", "bank_txn_id", ["bank_txn_id", "amount_paise", "rule", "reason"]))
    out = out.unionByName(_lines(coverage(books), "account", "account", ["account", "claimed_paise", "actual_paise", "ok"]))
    refs = causes.evidence_refs(books).withColumn("item", F.concat_ws("|", "cause", "ref"))
    out = out.unionByName(_lines(refs, "reference", "item", ["cause", "ref"]))
    if risks is not None:
        out = out.unionByName(_lines(risks, "risk", "kind", ["kind", "amount_paise"]))
    return out


def _seal(head: DataFrame) -> DataFrame:
    named = sorted(c for c in head.columns if c != "digest")
    return head.withColumn("digest", F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256))


def lines_root(lines: DataFrame) -> DataFrame:
    line = F.sha2(F.concat_ws("|", "section", "item", "body"), 256)
    return roots(lines.withColumn("_line", line), WINDOW, "_line").select(*WINDOW, F.col("root").alias("lines_root"))


def build(books: Books, log_heads: DataFrame, risks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(heads, lines). The head of a window holds its totals, the log head it was computed
    from, the root over its lines, and a digest over all of that."""
    lines = pack_lines(books, risks)
    head = (
        close_summary(books).drop("alarms")
        .join(log_heads.select("merchant_id", "log_head", F.col("facts").alias("log_facts")), "merchant_id")
        .join(lines_root(lines), WINDOW, "left")
    )
    if "known_by" in books.windows.columns:
        head = head.join(books.windows.select(*WINDOW, F.col("known_by").alias("as_of")), WINDOW)
    return _seal(head), lines


def verify(heads: DataFrame, lines: DataFrame, fresh: DataFrame, log_heads: DataFrame) -> DataFrame:
    """Packs that do not hold, with the first reason: their own contents, the log, or a recomputation."""
    resealed = _seal(heads.drop("digest")).select(*WINDOW, F.col("digest").alias("_again"))
    told = lines_root(lines).select(*WINDOW, F.col("lines_root").alias("_root"))
    now = log_heads.select("merchant_id", F.col("log_head").alias("_head"))
    again = fresh.select(*WINDOW, F.col("digest").alias("_fresh"))
    joined = (
        heads.join(resealed, WINDOW).join(told, WINDOW, "left").join(now, "merchant_id", "left").join(again, WINDOW, "left")
    )
    reason = (
        F.when(F.col("digest") != F.col("_again"), "contents do not match the digest")
        .when(~F.col("lines_root").eqNullSafe(F.col("_root")), "lines do not match the digest")
        .when(~F.col("log_head").eqNullSafe(F.col("_head")), "computed from another log")
        .when(~F.col("digest").eqNullSafe(F.col("_fresh")), "not reproducible")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select(*WINDOW, "reason")
