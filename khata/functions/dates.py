"""Dates as gateways, banks and tax offices write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layouts tried in turn, in the order they are tried.
STATEMENT_LAYOUTS = (
    "d/m/Y", "d/m/y", "d-m-Y", "d-m-y", "d-b-Y", "d-b-y", "d b Y", "d B Y", "Y-m-d", "m/d/Y",
)
RETURN_LAYOUTS = ("d-m-Y", "d/m/Y", "Y-m-d", "d-b-Y", "d-m-y")

_MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
_PART = {
    "d": r"(\d{1,2})", "m": r"(\d{1,2})", "Y": r"(\d{4})", "y": r"(\d{2})",
    "b": "(" + "|".join(m[:3] for m in _MONTHS) + ")",
    "B": "(" + "|".join(_MONTHS) + ")",
}


def _month_number(name: Column) -> Column:
    pairs = []
    for number, month in enumerate(_MONTHS, start=1):
        pairs += [F.lit(month[:3]), F.lit(str(number))]
    return F.element_at(F.create_map(*pairs), name.substr(1, 3))


def _read(text: Column, layout: str) -> Column:
    letters = [c for c in layout if c.isalpha()]
    pattern = "^" + "".join(_PART.get(c, r"\s+" if c == " " else c) for c in layout) + "$"
    part = {c: F.regexp_extract(text, pattern, i) for i, c in enumerate(letters, start=1)}
    if "Y" in part:
        year = part["Y"]
    else:
        short = part["y"].try_cast("int")
        # two-digit years: 69..99 are the nineteen hundreds
        year = (short + F.when(short >= 69, 1900).otherwise(2000)).cast("string")
    if "m" in part:
        month = part["m"]
    else:
        month = _month_number(part["b" if "b" in part else "B"])
    iso = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(part["d"], 2, "0"))
    return F.when(text.rlike(pattern), iso.try_cast("date"))


def parse_date(text: Column, layouts: tuple[str, ...] = STATEMENT_LAYOUTS) -> Column:
    """The date under the first layout that fits, NULL when none does."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return F.coalesce(*[_read(plain, layout) for layout in layouts])


def date_from_epoch(seconds: Column, otherwise: Column) -> Column:
    """UTC day of an epoch second; absent or zero means ``otherwise``."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.when(F.coalesce(seconds, F.lit(0)) != 0, day).otherwise(otherwise)


def lag_days(occurred: Column, recorded: Column) -> Column:
    return F.datediff(recorded, occurred)


def tax_claim_deadline(day: Column) -> Column:
    """30 November after the end of the financial year (April to March) of ``day``."""
    year = F.year(day) + F.when(F.month(day) >= 4, 1).otherwise(0)
    return F.make_date(year, F.lit(11), F.lit(30))


def week_number(day: Column, origin: Column) -> Column:
    return F.floor(F.datediff(day, origin) / 7).cast("int")
