"""Events of one kind, each with the columns that kind carries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {
    "captures": "payment_captured",
    "settlements": "settlement_executed",
    "credits": "bank_credit_received",
    "refunds": "refund_issued",
    "disputes": "dispute_opened",
    "resolutions": "dispute_resolved",
    "holds": "risk_hold_applied",
    "releases": "risk_hold_released",
    "transfers": "route_transfer",
    "adjustments": "gateway_adjustment",
}
BANK_OUTFLOWS = ("bank_charge_applied", "bank_debit")


def select(events: DataFrame, what: str) -> DataFrame:
    """``what`` is a key of KINDS or 'bank_outflows'; the filter reaches the Parquet scan."""
    if what == "bank_outflows":
        return events.filter(F.col("type").isin(*BANK_OUTFLOWS))
    return events.filter(F.col("type") == KINDS[what])


def union_sources(*sources: DataFrame) -> DataFrame:
    """Events of several sources in ledger order."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.orderBy("merchant_id", "occurred_at", "event_id")
