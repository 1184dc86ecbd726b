"""Exact money arithmetic as Column expressions (integer paise, half-up)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paise_from_rupees(text: Column) -> Column:
    """Rupees (text or decimal) to paise, half-up; NULL when it is not a number."""
    rupees = text.cast("string").try_cast("decimal(33,10)")
    return F.round(rupees * F.lit(100).cast("decimal(3,0)"), 0).try_cast("bigint")


def paise_or_zero(text: Column) -> Column:
    """Rupees as printed on a tax return; blanks, dashes and junk count as zero."""
    plain = F.regexp_replace(text.cast("string"), "[,₹]", "")
    return F.coalesce(paise_from_rupees(F.trim(plain)), F.lit(0).cast("bigint"))


def apply_rate(paise: Column, rate_percent: Column) -> Column:
    """``rate_percent`` of an amount, half-up to the paisa."""
    rate = rate_percent.cast("decimal(12,6)")
    return F.round(paise.cast("decimal(20,0)") * rate / F.lit(100).cast("decimal(3,0)"), 0).cast("bigint")


def ratio_half_up(amount: Column, numerator: Column, denominator: Column) -> Column:
    """``amount * numerator / denominator`` half away from zero, without rounding in between.

    A zero denominator gives zero. The denominator is taken as positive.
    """
    wide = "decimal(38,0)"
    product = F.abs(amount).cast("decimal(19,0)") * F.abs(numerator).cast("decimal(19,0)")
    den = F.when(denominator == 0, F.lit(None)).otherwise(denominator).cast("decimal(18,0)")
    twice = (product.cast(wide) * F.lit(2).cast("decimal(1,0)")).cast(wide) + den
    # integer division of decimals keeps every digit
    rounded = F.call_function("div", twice.cast(wide), (den * F.lit(2).cast("decimal(1,0)")).cast(wide))
    sign = F.when((amount < 0) != (numerator < 0), F.lit(-1)).otherwise(F.lit(1))
    return F.coalesce(sign.cast("bigint") * rounded.cast("bigint"), F.lit(0).cast("bigint"))


def indian_grouping(whole: Column) -> Column:
    """12345678 as 1,23,45,678 (last three digits, then pairs)."""
    digits = whole.cast("string")
    head = F.when(F.length(digits) > 3, digits.substr(F.lit(1), F.length(digits) - 3))
    tail = F.right(digits, F.lit(3))
    grouped = F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,")
    return F.when(F.length(digits) > 3, F.concat(grouped, F.lit(","), tail)).otherwise(digits)


def money_text(paise: Column, currency: Column | None = None) -> Column:
    """'INR 1,26,907.00', with the sign in front."""
    name = F.lit("INR") if currency is None else currency
    size = F.abs(paise)
    whole = F.call_function("div", size, F.lit(100).cast("bigint"))
    part = F.lpad((size % 100).cast("string"), 2, "0")
    sign = F.when(paise < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, name, F.lit(" "), indian_grouping(whole), F.lit("."), part)


def render_money_columns(df: DataFrame) -> DataFrame:
    """Show every integer column whose name says money as grouped text."""
    plain_names = {"balance", "amount", "fee", "tax"}
    out = []
    for field in df.schema:
        named = field.name.lower()
        money = named.endswith("paise") or named in plain_names
        if money and field.dataType.typeName() in ("long", "integer"):
            out.append(money_text(F.col(field.name).cast("bigint")).alias(field.name))
        else:
            out.append(F.col(field.name).cast("string").alias(field.name))
    return df.select(*out)


# The spellings that mean "no figure here".
NO_FIGURE = ("", "-", "--", "NA", "N/A")


def signed_amount(text: Column) -> Column:
    """Struct(paise, sign): sign is 1 / -1 where the text says so, else 0.

    Understands Cr/Dr suffixes, accounting parentheses, grouping commas, the rupee
    mark, an INR prefix and a leading minus. ``paise`` is the size, NULL when missing.
    """
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    missing = raw.isin(*NO_FIGURE)
    mark = F.lower(F.regexp_extract(raw, r"(?i)(cr|dr)\s*$", 1))
    bare = F.regexp_replace(raw, r"(?i)\s*(cr|dr)\s*$", "")
    boxed = bare.startswith("(") & bare.endswith(")")
    bare = F.when(boxed, bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare)
    bare = F.trim(F.regexp_replace(bare, "[,₹]|INR", ""))
    minus = bare.startswith("-")
    bare = F.when(minus, bare.substr(F.lit(2), F.length(bare))).otherwise(bare)
    paise = F.when(~missing, paise_from_rupees(bare))
    sign = (
        F.when(paise.isNull(), 0)
        .when(minus | boxed, -1)
        .when(mark == "cr", 1)
        .when(mark == "dr", -1)
        .otherwise(0)
    )
    return F.struct(paise.alias("paise"), sign.alias("sign"))


def signed_paise(text: Column) -> Column:
    parsed = signed_amount(text)
    paise = parsed.getField("paise")
    return F.when(parsed.getField("sign") < 0, -paise).otherwise(paise)


def per_year(paise: Column, days: Column) -> Column:
    """Scale an amount seen over ``days`` to a year, half to even."""
    span = F.greatest(days, F.lit(1)).cast("decimal(10,0)")
    return F.bround(paise.cast("decimal(20,0)") * F.lit(365).cast("decimal(3,0)") / span, 0).cast("bigint")
