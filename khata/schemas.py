"""The canonical tables. Amounts are paise in BIGINT, rates are percent in DECIMAL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = T.DecimalType(12, 6)


def _struct(text: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(),
        "date": T.DateType(), "bool": T.BooleanType(), "double": T.DoubleType(),
        "rate": RATE,
    }
    fields = [pair.split() for pair in text.replace("\n", " ").split(",")]
    return T.StructType([T.StructField(name, kinds[kind], True) for name, kind in fields])


EVENTS = _struct(
    """merchant_id string, event_id string, type string, occurred_at date, recorded_at date,
    entity_id string, counterparty string, method string, amount_paise long, fee_paise long,
    tax_paise long, tds_paise long, utr string, narration string, detail string,
    currency string, won bool, value_date date"""
)
POSTINGS = _struct(
    """merchant_id string, event_id string, event_type string, occurred_at date,
    recorded_at date, account string, amount_paise long, ref string, memo string"""
)
COVERS = _struct(
    """merchant_id string, settlement_id string, utr string, payment_id string,
    settled_on date, recorded_at date"""
)
LINKS = _struct(
    """merchant_id string, bank_txn_id string, settlement_id string, rule string,
    confidence double, candidates long, reason string"""
)
STATEMENT_ROWS = _struct(
    """file string, line long, txn_date date, value_date date, narration string, ref string,
    debit_paise long, credit_paise long, balance_paise long"""
)
INVOICES = _struct(
    """merchant_id string, supplier_gstin string, supplier_name string, invoice_no string,
    invoice_date date, taxable_paise long, igst_paise long, cgst_paise long,
    sgst_paise long, cess_paise long"""
)
CONTRACTS = _struct("merchant_id string, method string, rate rate")

# The instruments, the 14 accounts with their normal side and
# whether they may never sit on the other side.
METHODS = ("card", "upi", "netbanking", "wallet", "emi")
ACCOUNTS = (
    ("bank", "debit", False),
    ("gateway_receivable", "debit", True),
    ("on_hold", "debit", True),
    ("settlement_in_transit", "debit", False),
    ("dispute_reserve", "debit", True),
    ("tds_receivable", "debit", False),
    ("gst_input_credit", "debit", False),
    ("revenue", "credit", False),
    ("fee_expense", "debit", False),
    ("bank_charges", "debit", False),
    ("gateway_adjustments", "debit", False),
    ("other_outflow", "debit", False),
    ("refunds", "debit", False),
    ("chargeback_loss", "debit", False),
)


def event_row(**given: Column) -> Column:
    """One event as a struct in schema order; what is not given is NULL."""
    unknown = set(given) - set(EVENTS.names)
    if unknown:
        raise ValueError(f"not event columns: {sorted(unknown)}")
    return F.struct(
        *[
            (given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENTS
        ]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Order, type and fill ``df`` so that it has exactly ``schema``."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
