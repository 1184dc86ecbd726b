"""The questions merchants ask most, as parameterised SQL over the ledger's views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from khata.plans.books import Books

VIEWS = ("events", "postings", "settlement_covers", "calendar", "credit_links")
# Fixed value: rows an answer shows.
ROWS_SHOWN = 200

NAMED = {
    "largest_payouts": """
        SELECT merchant_id, entity_id AS settlement_id, utr, occurred_at, amount_paise FROM events
        WHERE type = 'settlement_executed' ORDER BY amount_paise DESC, merchant_id, entity_id LIMIT :top""",
    "payouts_without_credit": """
        SELECT s.merchant_id, s.entity_id AS settlement_id, s.utr, s.occurred_at, s.amount_paise FROM events s
        LEFT ANTI JOIN credit_links l ON l.merchant_id = s.merchant_id AND l.settlement_id = s.entity_id
        WHERE s.type = 'settlement_executed'""",
    "failed_by_method": """
        SELECT merchant_id, method, count(*) AS failed, sum(amount_paise) AS amount_paise FROM events
        WHERE type = 'payment_failed' GROUP BY merchant_id, method""",
    "fees_by_method": """
        SELECT merchant_id, method, count(*) AS captures, sum(fee_paise) AS fee_paise, sum(tax_paise) AS gst_paise
        FROM events WHERE type = 'payment_captured' GROUP BY merchant_id, method""",
    "refunds": """
        SELECT merchant_id, occurred_at, entity_id AS refund_id, counterparty AS payment_id, amount_paise FROM events
        WHERE type = 'refund_issued'""",
    "disputes": """
        SELECT merchant_id, occurred_at, type, entity_id AS dispute_id, counterparty AS payment_id, amount_paise, detail AS reason
        FROM events WHERE type IN ('dispute_opened', 'dispute_resolved')""",
    "unattributed_credits": """
        SELECT e.merchant_id, l.bank_txn_id, e.amount_paise, e.occurred_at, l.rule FROM credit_links l
        JOIN events e ON e.merchant_id = l.merchant_id AND e.entity_id = l.bank_txn_id
        WHERE l.settlement_id IS NULL AND e.type = 'bank_credit_received'""",
    "slipped_days": "SELECT d, t2_naive, t2_actual, slipped_days FROM calendar WHERE slipped_days > 0",
    "account_balances": """
        SELECT merchant_id, account, sum(amount_paise) AS balance_paise FROM postings GROUP BY merchant_id, account""",
}
# What points to each of them in a question, as patterns over its lower-case text.
CLUES = {
    "largest_payouts": (r"(big|large|high|great)(ger|gest|st|er|est)?\b", r"\btop\b", r"\bbiggest\b"),
    "payouts_without_credit": (r"(not|n't|never|no[tr]? yet)\s+(\w+\s+)?(arriv|land|reach|com|show|paid|receiv|credit)", r"\bmissing\b", r"\bunpaid\b", r"where is"),
    "failed_by_method": (r"\bfail", r"\bdeclin", r"\breject", r"did(n't| not) go through"),
    "fees_by_method": (r"\bfees?\b", r"\bcharged?\b", r"\bcommission", r"\bcosts?\b"),
    "refunds": (r"\brefund", r"(paid|gave|sent|given) back", r"\breturned\b"),
    "disputes": (r"\bdisput", r"\bcharge-?back", r"\bcontest"),
    "unattributed_credits": (r"un(match|link|attribut|explain)", r"(not|n't|no)\s+(\w+\s+)?(match|link|explain|attribut)", r"\bexception", r"\babstain"),
    "slipped_days": (r"\bholiday", r"\bdelay", r"\blate\b", r"\bslip", r"\bcalendar"),
    "account_balances": (r"\bbalances?\b", r"\bposition", r"\baccounts?\b", r"how much (is|do we|have)"),
}
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def register_views(spark: SparkSession, books: Books, covers: DataFrame, prefix: str = "") -> None:
    tables = dict(zip(VIEWS, (books.events, books.postings, covers, books.calendar, books.links)))
    for name, table in tables.items():
        table.createOrReplaceTempView(prefix + name)
    # evidence prices captures
    books.contracts.createOrReplaceTempView(prefix + "contracts")


def ask(spark: SparkSession, name: str, **args) -> DataFrame:
    """Run a named question; parameters are bound, never spliced into the text."""
    if name == "largest_payouts":
        args.setdefault("top", 10)
    return spark.sql(NAMED[name], args=args)


def which(question: str) -> str | None:
    """The named question with the most clues in ``question``; of equals, the one whose clue comes first."""
    text = question.lower().replace("\u2019", "'")
    found = {name: [m.start() for clue in clues for m in re.finditer(clue, text)] for name, clues in CLUES.items()}
    found = {name: at for name, at in found.items() if at}
    return min(found, key=lambda name: (-len(found[name]), min(found[name])), default=None)


def how_many(question: str, otherwise: int = 10) -> int:
    """The number of rows a question asks for, in digits or as a word up to twenty."""
    for word in re.findall(r"[a-z]+|[0-9]+", question.lower()):
        number = int(word) if word.isdigit() else _UNITS.index(word) if word in _UNITS else 0
        if 0 < number <= ROWS_SHOWN:
            return number
    return otherwise


def answer(spark: SparkSession, question: str) -> DataFrame | None:
    """The answer to a question in words; None when nothing in it is known."""
    name = which(question)
    return None if name is None else ask(spark, name, **({"top": how_many(question)} if name == "largest_payouts" else {}))


def shown(answer: DataFrame, rows: int = ROWS_SHOWN) -> DataFrame:
    """What of an answer is put in front of a reader; the answer itself is not cut."""
    return answer.limit(rows)
