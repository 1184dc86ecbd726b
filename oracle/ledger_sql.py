"""The sample ledger in plain SQL, as named common table expressions.

``query(body)`` puts the expressions the body mentions, and what they need, in front of it.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["facts"] = """
SELECT o_orderkey AS k, n_regionkey, 'm' || n_regionkey AS merchant_id, CAST(o_orderdate AS DATE) AS d, gross, method,
       NOT (o_orderstatus = 'P' AND o_orderkey % 10 = 0) AS captured, returned_on, fee,
       CAST((fee * 36 + 100) // 200 AS BIGINT) AS tax,
       CAST(CASE WHEN o_orderkey % 7 = 0 THEN (gross * 20 + 10000) // 20000 ELSE 0 END AS BIGINT) AS tds
FROM (SELECT *, CAST((gross * 2 * CASE WHEN method = 'card' AND CAST(o_orderdate AS DATE) >= DATE '1998-07-01'
                     THEN 236 ELSE 200 END + 10000) // 20000 AS BIGINT) AS fee
      FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS gross,
                   CASE left(o_orderpriority, 1) WHEN '1' THEN 'card' WHEN '2' THEN 'upi' WHEN '3' THEN 'netbanking'
                        WHEN '4' THEN 'wallet' ELSE 'emi' END AS method
            FROM orders) o
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS returned_on
                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                 WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE)
                 GROUP BY l_orderkey) r ON r.l_orderkey = o_orderkey) x"""

CTES["cal0"] = """
SELECT CAST(g AS DATE) AS d,
       NOT (isodow(g) = 7 OR (isodow(g) = 6 AND (day(g) BETWEEN 8 AND 14 OR day(g) BETWEEN 22 AND 28))
            OR strftime(g, '%m-%d') IN ('01-01', '01-26', '05-01', '08-15', '10-02', '12-25')) AS is_bank_day
FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE) - INTERVAL 14 DAY,
                                    CAST(max(o_orderdate) AS DATE) + INTERVAL 180 DAY, INTERVAL 1 DAY)) AS g FROM orders)"""
CTES["cal1"] = """
SELECT d, is_bank_day, CAST(sum(CAST(is_bank_day AS INT)) OVER (ORDER BY d) AS BIGINT) AS open_ordinal FROM cal0"""
CTES["calendar"] = """
SELECT c.d, c.is_bank_day, c.open_ordinal, nx.d AS next_open, c.d + 2 AS t2_naive, o.d AS t2_actual,
       CAST(o.d - (c.d + 2) AS INT) AS slipped_days
FROM cal1 c JOIN cal1 o ON o.is_bank_day AND o.open_ordinal = c.open_ordinal + 2
JOIN cal1 nx ON nx.is_bank_day AND nx.open_ordinal = c.open_ordinal + CASE WHEN c.is_bank_day THEN 0 ELSE 1 END
WHERE c.d <= (SELECT CAST(max(o_orderdate) AS DATE) + 150 FROM orders)"""


def _ev(kind, prefix, day, amount, where, recorded=None, counterparty="NULL", method="NULL", fee="NULL", tax="NULL",
        tds="NULL", narration="NULL", detail="NULL", won="NULL", value_date="NULL", source="facts"):
    return (
        f"SELECT merchant_id, '{kind}:{prefix}' || k AS event_id, '{kind}' AS type, CAST({day} AS DATE) AS occurred_at, "
        f"CAST({recorded or day} AS DATE) AS recorded_at, '{prefix}' || k AS entity_id, "
        f"CAST({counterparty} AS VARCHAR) AS counterparty, CAST({method} AS VARCHAR) AS method, "
        f"CAST({amount} AS BIGINT) AS amount_paise, CAST({fee} AS BIGINT) AS fee_paise, CAST({tax} AS BIGINT) AS tax_paise, "
        f"CAST({tds} AS BIGINT) AS tds_paise, CAST(NULL AS VARCHAR) AS utr, CAST({narration} AS VARCHAR) AS narration, "
        f"CAST({detail} AS VARCHAR) AS detail, 'INR' AS currency, CAST({won} AS BOOLEAN) AS won, "
        f"CAST({value_date} AS DATE) AS value_date FROM {source} WHERE {where}"
    )


CTES["order_events"] = "\nUNION ALL ".join([
    _ev("order_placed", "ord_", "d", "gross", "k % 5 = 0", counterparty="'cust_' || k"),
    _ev("payment_captured", "pay_", "d", "gross", "captured", counterparty="'ord_' || k", method="method", fee="fee",
        tax="tax", tds="tds"),
    _ev("payment_failed", "pay_", "d", "gross", "NOT captured", counterparty="'ord_' || k", method="method",
        detail="CASE WHEN k % 3 = 0 THEN 'BAD_REQUEST' ELSE 'GATEWAY_ERROR' END"),
    _ev("refund_issued", "rfnd_", "returned_on", "gross * 3 // 10", "captured AND returned_on IS NOT NULL",
        counterparty="'pay_' || k", detail="CASE WHEN k % 2 = 0 THEN 'instant' ELSE 'normal' END"),
    _ev("dispute_opened", "disp_", "d + 5", "gross // 2", "captured AND k % 50 = 11",
        recorded="d + 5 + CAST(7 + k % 15 AS INT)", counterparty="'pay_' || k",
        detail="CASE WHEN k % 4 = 1 THEN 'goods_not_received' ELSE 'fraudulent' END"),
    _ev("dispute_resolved", "disp_", "d + 40", "gross // 2", "captured AND k % 100 = 11", counterparty="'pay_' || k",
        won="k % 200 = 11"),
    _ev("risk_hold_applied", "hold_", "d + 1", "gross // 4", "captured AND k % 400 = 23",
        detail="CASE WHEN k % 3 = 0 THEN 'kyc_pending' ELSE 'risk_review' END"),
    _ev("risk_hold_released", "hold_", "d + 12", "gross // 4", "captured AND k % 800 = 23"),
    _ev("route_transfer", "trf_", "d", "gross // 5", "captured AND k % 60 = 17", counterparty="'pay_' || k",
        detail="'acc_' || (k % 13)"),
    _ev("gateway_adjustment", "adj_", "d + 1", "35000", "k % 150 = 31", detail="'monthly minimum'"),
    _ev("bank_charge_applied", "chg_", "d + 2", "59000 + k % 1000", "k % 90 = 41", narration="'SMS ALERT CHRG ' || k",
        value_date="d + 2"),
    _ev("bank_debit", "out_", "d + 3", "100000 + k % 7777", "k % 120 = 53", narration="'VENDOR PAYMENT ' || k",
        value_date="d + 3"),
])

# account | signed amount | ref | memo, per event type
_RULES = {
    "payment_captured": [
        ("gateway_receivable", "abs(amount_paise - fee_paise - tax_paise - tds_paise)", "entity_id", "'owed by the gateway'"),
        ("fee_expense", "abs(fee_paise)", "entity_id", "method || ' fee'"),
        ("gst_input_credit", "abs(tax_paise)", "entity_id", "'tax on the charge'"),
        ("tds_receivable", "abs(tds_paise)", "entity_id", "'withheld at source'"),
        ("revenue", "-abs(amount_paise)", "entity_id", "counterparty"),
    ],
    "refund_issued": [("refunds", "abs(amount_paise)", "entity_id", "'back for ' || counterparty"),
                      ("gateway_receivable", "-abs(amount_paise)", "entity_id", "counterparty")],
    "dispute_opened": [("dispute_reserve", "abs(amount_paise)", "entity_id", "'set aside: ' || detail"),
                       ("gateway_receivable", "-abs(amount_paise)", "entity_id", "counterparty")],
    "risk_hold_applied": [("on_hold", "abs(amount_paise)", "entity_id", "detail"),
                          ("gateway_receivable", "-abs(amount_paise)", "entity_id", "'kept back'")],
    "risk_hold_released": [("gateway_receivable", "abs(amount_paise)", "entity_id", "'no longer kept back'"),
                           ("on_hold", "-abs(amount_paise)", "entity_id", "'handed on'")],
    "settlement_executed": [
        ("settlement_in_transit", "abs(amount_paise)", "utr", "entity_id"),
        ("fee_expense", "abs(fee_paise)", "entity_id", "'charge for paying at once'"),
        ("gateway_receivable", "-abs(amount_paise + fee_paise)", "entity_id", "utr")],
    "bank_credit_received": [("bank", "abs(amount_paise)", "entity_id", "narration"),
                             ("settlement_in_transit", "-abs(amount_paise)", "entity_id", "'arrived'")],
    "bank_charge_applied": [("bank_charges", "abs(amount_paise)", "entity_id", "narration"),
                            ("bank", "-abs(amount_paise)", "entity_id", "'taken by the bank'")],
    "bank_debit": [("other_outflow", "abs(amount_paise)", "entity_id", "narration"),
                   ("bank", "-abs(amount_paise)", "entity_id", "'left the account'")],
    "gateway_adjustment": [("gateway_adjustments", "abs(amount_paise)", "entity_id", "detail"),
                           ("gateway_receivable", "-abs(amount_paise)", "entity_id", "'taken from a payout'")],
    "route_transfer": [("revenue", "abs(amount_paise)", "entity_id", "'share of ' || detail"),
                       ("gateway_receivable", "-abs(amount_paise)", "entity_id", "counterparty")],
}


def _postings(source: str) -> str:
    parts = []

    def one(kind, account, amount, ref, memo, extra=""):
        parts.append(
            f"SELECT merchant_id, event_id, type AS event_type, occurred_at, recorded_at, '{account}' AS account, "
            f"CAST({amount} AS BIGINT) AS amount_paise, coalesce({ref}, '') AS ref, coalesce({memo}, '') AS memo "
            f"FROM {source} WHERE type = '{kind}'{extra}"
        )

    for kind, rows in _RULES.items():
        for row in rows:
            one(kind, *row)
    one("dispute_resolved", "gateway_receivable", "abs(amount_paise)", "entity_id", "'set aside no longer'", " AND won")
    one("dispute_resolved", "chargeback_loss", "abs(amount_paise)", "entity_id", "'lost to the buyer'", " AND NOT won")
    one("dispute_resolved", "dispute_reserve", "-abs(amount_paise)", "entity_id", "counterparty")
    return "\nUNION ALL ".join(parts)


CTES["order_postings"] = _postings("order_events")
CTES["payout_net"] = """
SELECT merchant_id, day, net, CAST(day - DATE '1994-01-01' AS INT) AS n,
       (CAST(day - DATE '1994-01-01' AS INT) % 41 IN (0, 2)) AND net > 6000000 AS swept
FROM (SELECT merchant_id, t2_actual AS day, CAST(sum(amount_paise) AS BIGINT) AS net
      FROM order_postings JOIN calendar ON calendar.d = occurred_at
      WHERE account = 'gateway_receivable' GROUP BY ALL) WHERE net > 0"""
CTES["payouts"] = """
SELECT merchant_id, day, n, suffix, CAST(gross_out - fee AS BIGINT) AS net, CAST(fee AS BIGINT) AS fee,
       'setl_' || merchant_id || '_' || strftime(day, '%Y%m%d') || suffix AS settlement_id,
       strftime(day, '%Y%m%d') || lpad(substr(merchant_id, 2), 2, '0')
         || lpad(CAST(n + CASE WHEN suffix = 'b' THEN 500000 ELSE 0 END AS VARCHAR), 6, '0') AS utr
FROM (SELECT *, CASE WHEN n % 11 = 5 AND suffix = '' THEN (gross_out * 2 + 500) // 1000 ELSE 0 END AS fee
      FROM (SELECT merchant_id, day, n, '' AS suffix, net - CASE WHEN swept THEN 5000000 ELSE 0 END AS gross_out FROM payout_net
            UNION ALL SELECT merchant_id, day, n, 'b', 5000000 FROM payout_net WHERE swept))"""
_NARR = """CASE WHEN suffix = 'b' THEN 'INWARD FROM GATEWAY'
  WHEN n % 5 = 0 THEN 'GATEWAY DAY CLOSE ' || utr
  WHEN n % 5 = 1 THEN 'PAYOUT GATEWAY ' || substr(utr, 1, 8) || '-' || substr(utr, 9)
  WHEN n % 5 = 2 THEN 'SHORT SLIP ' || substr(utr, 1, 10)
  WHEN n % 5 = 3 THEN 'INWARD FROM GATEWAY'
  ELSE 'GATEWAY SLIP NO ' || utr || lpad(CAST(n % 100 AS VARCHAR), 2, '0') END"""
CTES["payout_events"] = f"""
SELECT merchant_id, 'settlement_executed:' || settlement_id AS event_id, 'settlement_executed' AS type, day AS occurred_at,
       day AS recorded_at, settlement_id AS entity_id, CAST(NULL AS VARCHAR) AS counterparty, CAST(NULL AS VARCHAR) AS method,
       net AS amount_paise, fee AS fee_paise, CAST(NULL AS BIGINT) AS tax_paise, CAST(NULL AS BIGINT) AS tds_paise, utr,
       CAST(NULL AS VARCHAR) AS narration, CAST(NULL AS VARCHAR) AS detail, 'INR' AS currency, CAST(NULL AS BOOLEAN) AS won,
       CAST(NULL AS DATE) AS value_date FROM payouts
UNION ALL
SELECT merchant_id, 'bank_credit_received:' || id, 'bank_credit_received', lands_on, lands_on, id, NULL, NULL, amount, NULL, NULL, NULL, NULL,
       narration, NULL, 'INR', NULL, lands_on
FROM (SELECT merchant_id, day + CAST(n % 3 AS INT) AS lands_on, 'btx_' || merchant_id || '_' || n || suffix AS id, net AS amount,
             {_NARR} AS narration FROM payouts WHERE n % 37 <> 0 OR suffix = 'b'
      UNION ALL SELECT merchant_id, day + CAST(n % 3 AS INT), 'bts_' || merchant_id || '_' || n, CAST(1725000 + n AS BIGINT),
             'SOME OTHER PAYER' FROM payouts WHERE n % 53 = 7 AND suffix = '')"""
CTES["events"] = """
SELECT * FROM order_events UNION ALL SELECT * FROM payout_events
UNION ALL SELECT 'm' || r_regionkey, 'fee_schedule_changed:m' || r_regionkey, 'fee_schedule_changed', DATE '1998-07-01',
       DATE '1998-07-01', NULL, NULL, 'card', NULL, NULL, NULL, NULL, NULL, NULL, '2.36', 'INR', NULL, NULL FROM region"""
CTES["postings"] = _postings("ev")
CTES["covers"] = """
SELECT p.merchant_id, p.settlement_id, p.utr, e.entity_id AS payment_id, p.day AS settled_on
FROM ev e JOIN calendar c ON c.d = e.occurred_at JOIN payouts p ON p.merchant_id = e.merchant_id AND p.day = c.t2_actual
WHERE e.type = 'payment_captured' AND p.suffix = ''"""
CTES["contracts"] = """
SELECT 'm' || r_regionkey AS merchant_id, m AS method, CAST(2 AS DECIMAL(12,6)) AS rate
FROM region, (VALUES ('card'), ('upi'), ('netbanking'), ('wallet'), ('emi')) t(m)"""
# the driver registers a view called events, so the ledger's own goes by ev
CTES["ev"] = CTES.pop("events")
CTES["windows"] = """
SELECT merchant_id, CAST(w AS INT) AS window_id, CAST(lo + CAST(7 * w AS INT) AS DATE) AS window_start,
       CAST(least(lo + CAST(7 * w + 6 AS INT), hi) AS DATE) AS window_end
FROM (SELECT merchant_id, lo, hi, unnest(range(0, CAST((hi - lo) // 7 AS BIGINT) + 1)) AS w
      FROM (SELECT merchant_id, min(occurred_at) AS lo, max(occurred_at) AS hi FROM ev GROUP BY merchant_id))"""


def query(body: str, **local: str) -> str:
    """``body`` with every CTE it needs, in dependency order. ``local`` adds CTEs of its own."""
    order: list[str] = []
    known = {**CTES, **local}

    def visit(text: str, skip: str = "") -> None:
        words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_][a-z_0-9]*)", text))
        for name in known:
            if name in words and name != skip and name not in order:
                visit(known[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{name} AS MATERIALIZED ({known[name].strip()})" for name in order)
    return f"WITH {parts}\n{body.strip()}"


# Shared steps above the ledger itself.
CTES["moves"] = """
SELECT p.merchant_id, w.window_id, account, event_type, CAST(sum(amount_paise) AS BIGINT) AS amount_paise, count(*) AS n
FROM postings p JOIN windows w ON w.merchant_id = p.merchant_id AND p.occurred_at BETWEEN window_start AND window_end GROUP BY ALL"""
CTES["priced"] = """
SELECT e.merchant_id, entity_id AS payment_id, occurred_at, recorded_at, e.method, amount_paise, fee_paise, tax_paise, tds_paise,
       coalesce(CAST(round(CAST(amount_paise AS DECIMAL(38,6)) * rate / 100, 0) AS BIGINT), 0) AS contract_paise
FROM ev e LEFT JOIN contracts k ON k.merchant_id = e.merchant_id AND k.method = e.method WHERE type = 'payment_captured'"""
CTES["pairs"] = r"""
SELECT c.merchant_id, c.entity_id AS bank_txn_id, c.occurred_at AS cday, c.amount_paise AS camt,
       p.entity_id AS settlement_id, p.utr, p.occurred_at AS pday, p.amount_paise AS pamt,
       contains(c.narration, p.utr) AS ex,
       contains(regexp_replace(upper(c.narration), '[^\p{L}\p{N}]', '', 'g'), p.utr) AS nm,
       c.amount_paise = p.amount_paise
         AND contains(regexp_replace(upper(c.narration), '[^\p{L}\p{N}]', '', 'g'), left(p.utr, 8)) AS st
FROM ev c JOIN ev p ON p.merchant_id = c.merchant_id AND p.occurred_at BETWEEN c.occurred_at - 6 AND c.occurred_at + 1
WHERE c.type = 'bank_credit_received' AND p.type = 'settlement_executed'"""
CTES["by_ref"] = """
SELECT merchant_id, bank_txn_id, cday, CASE WHEN en = 1 THEN 'exact_utr' WHEN nn = 1 THEN 'normalised_utr' WHEN sn = 1 THEN 'truncated_prefix' END AS rule,
       CASE WHEN en = 1 THEN eid WHEN nn = 1 THEN nid WHEN sn = 1 THEN sid END AS settlement_id
FROM (SELECT merchant_id, bank_txn_id, cday, count(*) FILTER (WHERE ex) AS en, min(settlement_id) FILTER (WHERE ex) AS eid,
             count(*) FILTER (WHERE nm) AS nn, min(settlement_id) FILTER (WHERE nm) AS nid,
             count(*) FILTER (WHERE st) AS sn, min(settlement_id) FILTER (WHERE st) AS sid FROM pairs GROUP BY ALL)
WHERE en = 1 OR nn = 1 OR sn = 1"""
CTES["by_amount"] = """
SELECT *, count(*) OVER (PARTITION BY merchant_id, bank_txn_id) AS exact_n
FROM (SELECT * FROM pairs x WHERE camt = pamt
      AND NOT EXISTS (SELECT 1 FROM by_ref r WHERE r.merchant_id = x.merchant_id AND r.bank_txn_id = x.bank_txn_id)
      AND NOT EXISTS (SELECT 1 FROM by_ref r WHERE r.merchant_id = x.merchant_id AND r.settlement_id = x.settlement_id))"""
CTES["sharing"] = """
SELECT a.merchant_id, a.bank_txn_id, count(DISTINCT b.bank_txn_id) AS sharing
FROM by_amount a JOIN by_amount b ON a.merchant_id = b.merchant_id AND a.settlement_id = b.settlement_id GROUP BY ALL"""
CTES["links"] = """
SELECT c.merchant_id, c.entity_id AS bank_txn_id,
       CASE WHEN r.rule IS NOT NULL THEN r.settlement_id WHEN a.exact_n = 1 AND s.sharing = 1 THEN a.settlement_id END AS settlement_id,
       CASE WHEN r.rule IS NOT NULL THEN r.rule WHEN a.exact_n = 1 AND s.sharing = 1 THEN 'amount_date_unique'
            WHEN a.exact_n IS NOT NULL THEN 'abstain_ambiguous' ELSE 'abstain_no_candidate' END AS rule,
       CASE WHEN r.rule IS NOT NULL THEN 1 WHEN a.exact_n IS NOT NULL THEN a.exact_n
            WHEN EXISTS (SELECT 1 FROM pairs x LEFT JOIN by_ref t ON t.merchant_id = x.merchant_id AND t.settlement_id = x.settlement_id
                         WHERE x.merchant_id = c.merchant_id AND x.bank_txn_id = c.entity_id
                         AND (t.bank_txn_id IS NULL OR (t.cday, t.bank_txn_id) >= (c.occurred_at, c.entity_id)))
            THEN (SELECT count(*) FROM pairs x WHERE x.merchant_id = c.merchant_id AND x.bank_txn_id = c.entity_id
                  AND NOT EXISTS (SELECT 1 FROM by_ref t WHERE t.merchant_id = x.merchant_id AND t.settlement_id = x.settlement_id))
            ELSE 0 END AS candidates
FROM ev c
LEFT JOIN by_ref r ON r.merchant_id = c.merchant_id AND r.bank_txn_id = c.entity_id
LEFT JOIN (SELECT merchant_id, bank_txn_id, max(exact_n) AS exact_n, min(settlement_id) AS settlement_id FROM by_amount GROUP BY ALL) a
  ON a.merchant_id = c.merchant_id AND a.bank_txn_id = c.entity_id
LEFT JOIN sharing s ON s.merchant_id = c.merchant_id AND s.bank_txn_id = c.entity_id
WHERE c.type = 'bank_credit_received'"""
CTES["missing"] = """
SELECT p.* FROM ev p WHERE p.type = 'settlement_executed'
AND NOT EXISTS (SELECT 1 FROM links l WHERE l.merchant_id = p.merchant_id AND l.settlement_id = p.entity_id)
AND NOT EXISTS (SELECT 1 FROM links l JOIN ev b ON b.merchant_id = l.merchant_id AND b.entity_id = l.bank_txn_id AND b.type = 'bank_credit_received'
                WHERE l.settlement_id IS NULL AND b.merchant_id = p.merchant_id AND b.amount_paise = p.amount_paise
                AND b.occurred_at BETWEEN p.occurred_at - 6 AND p.occurred_at + 6)"""
CTES["delayed"] = """
SELECT w.merchant_id, w.window_id, p.ref AS payment_id, p.amount_paise
FROM postings p JOIN windows w ON w.merchant_id = p.merchant_id AND p.occurred_at BETWEEN window_start AND window_end
JOIN calendar c ON c.d = p.occurred_at
WHERE p.account = 'gateway_receivable' AND p.event_type = 'payment_captured' AND c.t2_naive <= window_end AND c.t2_actual > window_end"""

_SLICES = [
    ("gst_on_fee", "gst_input_credit", None), ("tds_194o", "tds_receivable", None),
    ("instant_settlement_fee", "fee_expense", "settlement_executed"), ("bank_charges", "bank_charges", None),
    ("refunds_issued", "refunds", None), ("dispute_reserve_held", "dispute_reserve", None),
    ("chargeback_lost", "chargeback_loss", None), ("gateway_adjustment", "gateway_adjustments", None),
    ("other_bank_outflow", "other_outflow", None), ("route_split", "revenue", "route_transfer"), ("risk_hold", "on_hold", None),
    ("captured_not_yet_settled", "gateway_receivable", None), ("settlement_in_flight", "settlement_in_transit", None),
]
CTES["measured"] = "SELECT * FROM (" + " UNION ALL ".join(
    [
        f"SELECT merchant_id, window_id, '{cause}' AS cause, CAST(sum(amount_paise) AS BIGINT) AS raw_paise FROM moves "
        f"WHERE account = '{account}'" + (f" AND event_type = '{kind}'" if kind else "") + " GROUP BY ALL"
        for cause, account, kind in _SLICES
    ]
    + [
        "SELECT p.merchant_id, window_id, 'normal_fee', CAST(sum(contract_paise) AS BIGINT) FROM priced p JOIN windows w "
        "ON w.merchant_id = p.merchant_id AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL",
        "SELECT p.merchant_id, window_id, 'fee_rate_increase', CAST(sum(fee_paise - contract_paise) AS BIGINT) FROM priced p JOIN windows w "
        "ON w.merchant_id = p.merchant_id AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL",
        "SELECT merchant_id, window_id, 'bank_holiday_delay', CAST(sum(a) AS BIGINT) FROM ("
        "SELECT merchant_id, window_id, amount_paise AS a FROM delayed UNION ALL "
        "SELECT d.merchant_id, d.window_id, -t.amount_paise FROM (SELECT DISTINCT merchant_id, window_id, payment_id FROM delayed) d "
        "JOIN ev t ON t.merchant_id = d.merchant_id AND t.type = 'route_transfer' AND t.counterparty = d.payment_id) GROUP BY ALL",
        "SELECT m.merchant_id, window_id, 'settlement_never_arrived', CAST(sum(amount_paise) AS BIGINT) FROM missing m JOIN windows w "
        "ON w.merchant_id = m.merchant_id AND m.occurred_at BETWEEN window_start AND window_end AND m.occurred_at <= window_end - 3 GROUP BY ALL",
    ]
) + ") WHERE raw_paise <> 0"
CTES["refined"] = """
SELECT merchant_id, window_id, cause, CAST(sum(r) AS BIGINT) AS raw_paise, CAST(sum(a) AS BIGINT) AS amount_paise FROM (
  SELECT merchant_id, window_id, cause, raw_paise AS r, raw_paise AS a FROM measured
  UNION ALL SELECT merchant_id, window_id, 'captured_not_yet_settled', 0, -raw_paise FROM measured WHERE cause = 'bank_holiday_delay'
  UNION ALL SELECT merchant_id, window_id, 'settlement_in_flight', 0, -raw_paise FROM measured WHERE cause = 'settlement_never_arrived')
GROUP BY ALL"""
_ALARM = "('fee_rate_increase', 'chargeback_lost', 'gateway_adjustment', 'risk_hold', 'settlement_never_arrived')"
_PERM = ("('normal_fee', 'gst_on_fee', 'instant_settlement_fee', 'bank_charges', 'gateway_adjustment', 'fee_rate_increase', "
         "'refunds_issued', 'chargeback_lost', 'route_split', 'other_bank_outflow')")
CTES["findings"] = f"""
SELECT merchant_id, window_id, cause, amount_paise, cause IN {_ALARM} AS alarming, cause IN {_PERM} AS permanent,
       CAST(row_number() OVER (PARTITION BY merchant_id, window_id ORDER BY abs(amount_paise) DESC, cause) AS INT) AS position
FROM refined WHERE amount_paise <> 0 AND raw_paise <> 0 AND (cause <> 'normal_fee' OR raw_paise > 0)"""
CTES["claim_of"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{a}')" for c, a, _ in _SLICES
) + (", ('normal_fee', 'fee_expense'), ('fee_rate_increase', 'fee_expense'), ('bank_holiday_delay', 'gateway_receivable'), "
     "('settlement_never_arrived', 'settlement_in_transit')) t(cause, account)")
CTES["moved"] = """
SELECT merchant_id, window_id, account, CAST(sum(amount_paise) AS BIGINT) AS actual_paise FROM moves
WHERE account NOT IN ('revenue', 'bank') OR (account = 'revenue' AND event_type = 'route_transfer') GROUP BY ALL"""
CTES["coverage"] = """
SELECT w.merchant_id, w.window_id, a.account, CAST(coalesce(c.claimed_paise, 0) AS BIGINT) AS claimed_paise,
       CAST(coalesce(m.actual_paise, 0) AS BIGINT) AS actual_paise
FROM windows w CROSS JOIN (SELECT DISTINCT account FROM claim_of) a
LEFT JOIN (SELECT merchant_id, window_id, account, sum(amount_paise) AS claimed_paise FROM refined JOIN claim_of USING (cause) GROUP BY ALL) c
  ON c.merchant_id = w.merchant_id AND c.window_id = w.window_id AND c.account = a.account
LEFT JOIN moved m ON m.merchant_id = w.merchant_id AND m.window_id = w.window_id AND m.account = a.account"""
CTES["exceptions"] = """
SELECT w.merchant_id, w.window_id, l.bank_txn_id, e.amount_paise, e.occurred_at, l.rule
FROM links l JOIN ev e ON e.merchant_id = l.merchant_id AND e.entity_id = l.bank_txn_id AND e.type = 'bank_credit_received'
JOIN windows w ON w.merchant_id = e.merchant_id AND e.occurred_at BETWEEN window_start AND window_end
WHERE l.settlement_id IS NULL"""
CTES["variance"] = """
SELECT w.merchant_id, w.window_id, w.window_start, w.window_end,
       CAST(coalesce(sum(-amount_paise) FILTER (WHERE account = 'revenue' AND event_type = 'payment_captured'), 0) AS BIGINT) AS gross_paise,
       CAST(coalesce(sum(amount_paise) FILTER (WHERE account = 'bank' AND event_type = 'bank_credit_received'), 0) AS BIGINT) AS credits_paise,
       CAST(coalesce(sum(amount_paise) FILTER (WHERE account = 'bank'), 0) AS BIGINT) AS landed_paise,
       CAST(coalesce(sum(amount_paise) FILTER (WHERE account NOT IN ('revenue', 'bank') OR (account = 'revenue' AND event_type = 'route_transfer')), 0) AS BIGINT) AS explained_paise
FROM windows w LEFT JOIN moves m ON m.merchant_id = w.merchant_id AND m.window_id = w.window_id GROUP BY ALL"""
CTES["summary"] = """
SELECT v.merchant_id, v.window_id, v.window_start, v.window_end, gross_paise, credits_paise, landed_paise,
       gross_paise - landed_paise AS gap_paise, CAST(coalesce(f.s, 0) AS BIGINT) AS explained_paise, coalesce(f.n, 0) AS findings,
       coalesce(f.al, 0) AS alarms, CAST(coalesce(f.pm, 0) AS BIGINT) AS permanent_paise, coalesce(x.n, 0) AS exceptions,
       CAST(coalesce(x.s, 0) AS BIGINT) AS unresolved_paise,
       CAST(gross_paise - landed_paise - coalesce(f.s, 0) AS BIGINT) AS remainder_paise, gross_paise - landed_paise = coalesce(f.s, 0) AS closes,
       round(CASE WHEN gross_paise = landed_paise THEN 1.0 ELSE 1 - abs(gross_paise - landed_paise - coalesce(f.s, 0)) / abs(gross_paise - landed_paise) END, 6) AS explained_fraction,
       g.open_n = 0 AS fully_covered, 17 AS checked
FROM variance v
LEFT JOIN (SELECT merchant_id, window_id, sum(amount_paise) AS s, count(*) AS n, count(*) FILTER (WHERE alarming) AS al,
           sum(amount_paise) FILTER (WHERE permanent) AS pm FROM findings GROUP BY ALL) f ON f.merchant_id = v.merchant_id AND f.window_id = v.window_id
LEFT JOIN (SELECT merchant_id, window_id, count(*) AS n, sum(amount_paise) AS s FROM exceptions GROUP BY ALL) x ON x.merchant_id = v.merchant_id AND x.window_id = v.window_id
LEFT JOIN (SELECT merchant_id, window_id, count(*) FILTER (WHERE claimed_paise <> actual_paise) AS open_n FROM coverage GROUP BY ALL) g
  ON g.merchant_id = v.merchant_id AND g.window_id = v.window_id"""


def link_ctes(prefix: str, keys: str) -> dict[str, str]:
    """Linkage once per key: reads {prefix}cr and {prefix}pa, ends in {prefix}links and {prefix}missing."""
    names = [k.strip() for k in keys.split(",")]

    def on(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)

    p = prefix
    fold = "c.folded"
    return {
        f"{p}pairs": f"""
SELECT {", ".join("c." + k for k in names)}, c.bank_txn_id, c.occurred_at AS cday, c.amount_paise AS camt, p.settlement_id, p.utr,
       p.occurred_at AS pday, p.amount_paise AS pamt, contains(c.narration, p.utr) AS ex, contains({fold}, p.utr) AS nm,
       c.amount_paise = p.amount_paise AND contains({fold}, left(p.utr, 8)) AS st
FROM (SELECT *, regexp_replace(upper(narration), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS folded, unnest(generate_series(occurred_at - 6, occurred_at + 1, INTERVAL 1 DAY))::DATE AS pday FROM {p}cr) c
JOIN {p}pa p ON {on("c", "p")} AND p.occurred_at = c.pday""",
        f"{p}by_ref": f"""
SELECT {keys}, bank_txn_id, CASE WHEN en = 1 THEN eid WHEN nn = 1 THEN nid WHEN sn = 1 THEN sid END AS settlement_id
FROM (SELECT {keys}, bank_txn_id, count(*) FILTER (WHERE ex) AS en, min(settlement_id) FILTER (WHERE ex) AS eid,
             count(*) FILTER (WHERE nm) AS nn, min(settlement_id) FILTER (WHERE nm) AS nid,
             count(*) FILTER (WHERE st) AS sn, min(settlement_id) FILTER (WHERE st) AS sid FROM {p}pairs GROUP BY ALL)
WHERE en = 1 OR nn = 1 OR sn = 1""",
        f"{p}by_amount": f"""
SELECT *, count(*) OVER (PARTITION BY {keys}, bank_txn_id) AS exact_n
FROM (SELECT x.* FROM {p}pairs x ANTI JOIN {p}by_ref r ON {on("x", "r")} AND x.bank_txn_id = r.bank_txn_id WHERE camt = pamt) y
ANTI JOIN {p}by_ref r ON {on("y", "r")} AND y.settlement_id = r.settlement_id""",
        f"{p}sharing": f"""
SELECT {", ".join("a." + k for k in names)}, a.bank_txn_id, count(DISTINCT b.bank_txn_id) AS sharing
FROM {p}by_amount a JOIN {p}by_amount b ON {on("a", "b")} AND a.settlement_id = b.settlement_id GROUP BY ALL""",
        f"{p}linked": f"""
SELECT {keys}, bank_txn_id, settlement_id FROM {p}by_ref
UNION ALL SELECT {", ".join("a." + k for k in names)}, a.bank_txn_id, a.settlement_id FROM {p}by_amount a
JOIN {p}sharing s ON {on("a", "s")} AND a.bank_txn_id = s.bank_txn_id WHERE a.exact_n = 1 AND s.sharing = 1""",
        f"{p}loose": f"SELECT c.* FROM {p}cr c ANTI JOIN {p}linked l ON {on('c', 'l')} AND c.bank_txn_id = l.bank_txn_id",
        f"{p}unlinked": f"SELECT p.* FROM {p}pa p ANTI JOIN {p}linked l ON {on('p', 'l')} AND p.settlement_id = l.settlement_id",
        f"{p}missing": f"""
SELECT u.* FROM {p}unlinked u ANTI JOIN {p}loose b ON {on("u", "b")} AND b.amount_paise = u.amount_paise
AND b.occurred_at BETWEEN u.occurred_at - 6 AND u.occurred_at + 6""",
    }


CTES["wcr"] = """
SELECT w.merchant_id, w.window_id, entity_id AS bank_txn_id, amount_paise, occurred_at, narration FROM ev JOIN windows w
ON w.merchant_id = ev.merchant_id AND occurred_at <= window_end AND recorded_at <= window_end WHERE type = 'bank_credit_received'"""
CTES["wpa"] = """
SELECT w.merchant_id, w.window_id, entity_id AS settlement_id, utr, amount_paise, occurred_at, window_start, window_end FROM ev JOIN windows w
ON w.merchant_id = ev.merchant_id AND occurred_at <= window_end AND recorded_at <= window_end WHERE type = 'settlement_executed'"""
CTES.update(link_ctes("w", "merchant_id, window_id"))
CTES["dpa"] = """
SELECT merchant_id, 'set_' || k AS settlement_id, lpad(CAST((k * 7919 + 13) % 100000000 AS VARCHAR), 8, '0') || lpad(CAST(k AS VARCHAR), 8, '0') AS utr, gross AS amount_paise,
       CAST(DATE '2000-01-03' + CAST(k % 12 AS INT) AS DATE) AS occurred_at, k FROM facts"""
CTES["dcr"] = """
SELECT merchant_id, 'cr_' || k AS bank_txn_id, amount_paise, CAST(occurred_at + CAST(k % 4 AS INT) AS DATE) AS occurred_at,
       CASE k % 5 WHEN 0 THEN 'NEFT ' || utr WHEN 1 THEN 'UPI/' || left(utr, 8) || '-' || substr(utr, 9, 8) WHEN 2 THEN 'IMPS ' || left(utr, 11) ELSE 'FUND TRANSFER' END AS narration
FROM dpa WHERE k % 10 <> 7"""
CTES.update(link_ctes("d", "merchant_id"))
CTES["moves_then"] = """
SELECT p.merchant_id, w.window_id, account, event_type, CAST(sum(amount_paise) AS BIGINT) AS amount_paise
FROM postings p JOIN windows w ON w.merchant_id = p.merchant_id AND p.occurred_at BETWEEN window_start AND window_end
AND p.recorded_at <= window_end GROUP BY ALL"""
CTES["measured_then"] = "SELECT * FROM (" + " UNION ALL ".join(
    [
        f"SELECT merchant_id, window_id, '{cause}' AS cause, CAST(sum(amount_paise) AS BIGINT) AS raw_paise FROM moves_then "
        f"WHERE account = '{account}'" + (f" AND event_type = '{kind}'" if kind else "") + " GROUP BY ALL"
        for cause, account, kind in _SLICES
    ]
    + [
        # captures and splits are recorded when they occur, so these three do not differ
        "SELECT * FROM measured WHERE cause IN ('normal_fee', 'fee_rate_increase', 'bank_holiday_delay')",
        "SELECT merchant_id, window_id, 'settlement_never_arrived', CAST(sum(amount_paise) AS BIGINT) FROM wmissing "
        "WHERE occurred_at BETWEEN window_start AND window_end - 3 GROUP BY ALL",
    ]
) + ") WHERE raw_paise <> 0"
CTES["findings_then"] = """
SELECT * FROM (SELECT merchant_id, window_id, cause, CAST(sum(r) AS BIGINT) AS raw_paise, CAST(sum(a) AS BIGINT) AS amount_paise FROM (
  SELECT merchant_id, window_id, cause, raw_paise AS r, raw_paise AS a FROM measured_then
  UNION ALL SELECT merchant_id, window_id, 'captured_not_yet_settled', 0, -raw_paise FROM measured_then WHERE cause = 'bank_holiday_delay'
  UNION ALL SELECT merchant_id, window_id, 'settlement_in_flight', 0, -raw_paise FROM measured_then WHERE cause = 'settlement_never_arrived')
GROUP BY ALL) WHERE amount_paise <> 0 AND raw_paise <> 0"""
CTES["restated"] = """
SELECT * FROM (SELECT coalesce(n.merchant_id, t.merchant_id) AS merchant_id, coalesce(n.window_id, t.window_id) AS window_id,
       coalesce(n.cause, t.cause) AS cause, coalesce(n.amount_paise, 0) AS now_paise, coalesce(t.amount_paise, 0) AS then_paise,
       coalesce(n.amount_paise, 0) - coalesce(t.amount_paise, 0) AS delta_paise,
       coalesce(t.amount_paise, 0) = 0 AND coalesce(n.amount_paise, 0) <> 0 AS appeared
FROM findings n FULL JOIN findings_then t ON n.merchant_id = t.merchant_id AND n.window_id = t.window_id AND n.cause = t.cause) WHERE delta_paise <> 0"""
_T = {
    "payment_captured": [("normal_fee", "(amount_paise * 400 + 10000) // 20000"),
                         ("fee_rate_increase", "fee_paise - (amount_paise * 400 + 10000) // 20000"),
                         ("gst_on_fee", "tax_paise"), ("tds_194o", "tds_paise")],
    "refund_issued": [("refunds_issued", "amount_paise")],
    "dispute_opened": [("dispute_reserve_held", "amount_paise")],
    "dispute_resolved": [("dispute_reserve_held", "-amount_paise"), ("chargeback_lost", "CASE WHEN won THEN 0 ELSE amount_paise END")],
    "risk_hold_applied": [("risk_hold", "amount_paise")], "risk_hold_released": [("risk_hold", "-amount_paise")],
    "route_transfer": [("route_split", "amount_paise")], "gateway_adjustment": [("gateway_adjustment", "amount_paise")],
    "bank_charge_applied": [("bank_charges", "amount_paise")], "bank_debit": [("other_bank_outflow", "amount_paise")],
    "settlement_executed": [("instant_settlement_fee", "fee_paise")],
}
CTES["truth"] = " UNION ALL ".join(
    f"SELECT merchant_id, occurred_at, '{c}' AS cause, CAST({a} AS BIGINT) AS amount_paise FROM ev WHERE type = '{t}'"
    for t, pairs in _T.items() for c, a in pairs
) + " UNION ALL SELECT merchant_id, day, 'settlement_never_arrived', net FROM payouts WHERE suffix = '' AND n % 37 = 0"
CTES["truth_win"] = """
SELECT * FROM (
SELECT t.merchant_id, window_id, cause, CAST(sum(amount_paise) AS BIGINT) AS actual_paise FROM truth t JOIN windows w
  ON w.merchant_id = t.merchant_id AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL
UNION ALL
SELECT f.merchant_id, window_id, 'bank_holiday_delay', CAST(sum(gross - fee - tax - tds - CASE WHEN k % 60 = 17 THEN gross // 5 ELSE 0 END) AS BIGINT)
FROM facts f JOIN windows w ON w.merchant_id = f.merchant_id AND f.d BETWEEN window_start AND window_end
JOIN calendar c ON c.d = f.d WHERE captured AND t2_naive <= window_end AND t2_actual > window_end GROUP BY ALL) WHERE actual_paise <> 0"""
CTES["scored"] = """
SELECT coalesce(f.merchant_id, t.merchant_id) AS merchant_id, coalesce(f.window_id, t.window_id) AS window_id, coalesce(f.cause, t.cause) AS cause,
       CASE WHEN f.cause IS NULL THEN 'missed' WHEN f.cause IN ('captured_not_yet_settled', 'settlement_in_flight') THEN 'structural'
            WHEN t.cause IS NULL THEN 'hallucinated' ELSE 'matched' END AS verdict,
       coalesce(f.amount_paise, 0) AS reported_paise, coalesce(t.actual_paise, 0) AS actual_paise,
       coalesce(f.amount_paise, 0) - coalesce(t.actual_paise, 0) AS error_paise
FROM findings f FULL JOIN truth_win t ON f.merchant_id = t.merchant_id AND f.window_id = t.window_id AND f.cause = t.cause"""
CTES["truth_links"] = """
SELECT merchant_id, 'btx_' || merchant_id || '_' || n || suffix AS bank_txn_id, settlement_id FROM payouts WHERE n % 37 <> 0 OR suffix = 'b'"""
CTES["bucketed"] = """
SELECT *, CASE WHEN cause IN ('settlement_never_arrived', 'fee_rate_increase', 'risk_hold', 'dispute_reserve_held')
               THEN CASE WHEN amount_paise > 0 THEN 'chase' ELSE 'timing' END
               WHEN cause IN ('gst_on_fee', 'tds_194o') THEN 'tax'
               WHEN cause IN ('captured_not_yet_settled', 'settlement_in_flight', 'bank_holiday_delay') THEN 'timing'
               WHEN cause = 'chargeback_lost' THEN 'lost' ELSE 'cost' END AS bucket FROM findings"""
_BUCKETS = ", ".join(
    f"CAST(coalesce(sum(amount_paise) FILTER (WHERE bucket = '{b}'), 0) AS BIGINT) AS {b}_paise"
    for b in ("chase", "tax", "timing", "cost", "lost")
) + ", CAST(coalesce(sum(amount_paise) FILTER (WHERE bucket IN ('chase', 'tax') AND amount_paise > 0), 0) AS BIGINT) AS recoverable_paise"
CTES["buckets"] = f"SELECT merchant_id, window_id, {_BUCKETS} FROM bucketed GROUP BY ALL"
CTES["weekly"] = """
SELECT v.merchant_id, v.window_id, v.window_start, v.window_end, gross_paise, gross_paise - landed_paise AS gap_paise,
       coalesce(chase_paise, 0) AS chase_paise, coalesce(tax_paise, 0) AS tax_paise, coalesce(timing_paise, 0) AS timing_paise,
       coalesce(cost_paise, 0) AS cost_paise, coalesce(lost_paise, 0) AS lost_paise, coalesce(recoverable_paise, 0) AS recoverable_paise,
       CAST(coalesce(o, 0) AS BIGINT) AS overcharge_paise, coalesce(fl, 0) AS flagged,
       CASE WHEN gross_paise <> 0 THEN round(coalesce(fee, 0) / gross_paise, 6) ELSE 0 END AS fee_rate,
       CASE WHEN gross_paise <> 0 THEN round((coalesce(fee, 0) - coalesce(o, 0)) / gross_paise, 6) ELSE 0 END AS contract_rate
FROM variance v LEFT JOIN buckets b ON b.merchant_id = v.merchant_id AND b.window_id = v.window_id
LEFT JOIN (SELECT merchant_id, window_id, sum(amount_paise) FILTER (WHERE cause IN ('normal_fee', 'fee_rate_increase')) AS fee,
           sum(amount_paise) FILTER (WHERE cause = 'fee_rate_increase') AS o, count(*) FILTER (WHERE alarming) AS fl
           FROM findings GROUP BY ALL) f ON f.merchant_id = v.merchant_id AND f.window_id = v.window_id"""
CTES["hike"] = """
SELECT merchant_id, hike_started, since_paise,
       CAST(round_even(CAST(since_paise AS DECIMAL(20,0)) * 365 / greatest(CAST(last_day - hike_started AS INT) + 1, 1), 0) AS BIGINT) AS per_year_paise
FROM (SELECT w.merchant_id, hike_started, last_day, CAST(sum(overcharge_paise) AS BIGINT) AS since_paise FROM weekly w
      JOIN (SELECT merchant_id, min(window_start) FILTER (WHERE overcharge_paise > 0) AS hike_started, max(window_end) AS last_day FROM weekly GROUP BY ALL) h
      ON h.merchant_id = w.merchant_id WHERE window_start >= hike_started GROUP BY ALL)"""


# --- statements, tax, text, forecasts ------------------------------------------------------

CTES["st0"] = """
SELECT merchant_id || '-' || strftime(occurred_at, '%Y%m') AS file, occurred_at AS txn_date, narration, entity_id,
       CASE WHEN type = 'bank_credit_received' THEN 0 ELSE amount_paise END AS debit_paise,
       CASE WHEN type = 'bank_credit_received' THEN amount_paise ELSE 0 END AS credit_paise
FROM ev WHERE type IN ('bank_credit_received', 'bank_charge_applied', 'bank_debit')"""
CTES["st1"] = """
SELECT *, 1 + row_number() OVER (PARTITION BY file ORDER BY txn_date, entity_id) AS line,
       100000000 + sum(credit_paise - debit_paise) OVER (PARTITION BY file ORDER BY txn_date, entity_id ROWS UNBOUNDED PRECEDING) AS running FROM st0"""
CTES["st"] = """
SELECT file, line, txn_date, narration, debit_paise, credit_paise, false AS opening,
       CASE WHEN line % 7 <> 3 THEN running + CASE WHEN line % 13 = 5 THEN 100 ELSE 0 END END AS balance_paise FROM st1
UNION ALL SELECT DISTINCT file, 1, NULL, NULL, NULL, NULL, true, 100000000 FROM st0"""
CTES["st_checked"] = """
SELECT file, line, opening, lag(line) OVER (PARTITION BY file ORDER BY line) IS NOT NULL AND NOT opening AS checked,
       coalesce(balance_paise - lag(balance_paise) OVER (PARTITION BY file ORDER BY line) <> cum - lag(cum) OVER (PARTITION BY file ORDER BY line), false) AS broken
FROM (SELECT *, sum(coalesce(credit_paise, 0) - coalesce(debit_paise, 0)) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS cum FROM st)
WHERE balance_paise IS NOT NULL"""
CTES["wfees"] = """
SELECT p.merchant_id, window_id, CAST(sum(fee_paise) AS BIGINT) AS fee, CAST(sum(tax_paise) AS BIGINT) AS tax, CAST(sum(tds_paise) AS BIGINT) AS tds,
       CAST(sum(contract_paise) AS BIGINT) AS contract
FROM priced p JOIN windows w ON w.merchant_id = p.merchant_id AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL"""
CTES["invoices"] = """
SELECT merchant_id, window_id, '29ABCDE1234F1Z5' AS supplier_gstin, tax - CASE WHEN window_id % 7 = 3 THEN 1000 ELSE 0 END AS tax_paise,
       window_id % 2 = 1 AS valid FROM wfees WHERE window_id % 5 <> 0
UNION ALL SELECT merchant_id, window_id, '29XXXXX9999X9X9', 18000 + window_id, false FROM wfees WHERE window_id % 6 = 1"""
CTES["f26"] = "SELECT merchant_id, window_id, tds - CASE WHEN window_id % 3 = 0 THEN 500 ELSE 0 END AS amount_paise FROM wfees WHERE window_id % 4 <> 2"
CTES["tax_gst"] = """
SELECT f.merchant_id, f.window_id, greatest(tax - coalesce(t, 0), 0) AS amount_paise, tax AS paid_paise, CAST(coalesce(t, 0) AS BIGINT) AS shown_paise
FROM wfees f LEFT JOIN (SELECT merchant_id, window_id, sum(tax_paise) AS t FROM invoices WHERE supplier_gstin = '29ABCDE1234F1Z5' GROUP BY ALL) i
ON i.merchant_id = f.merchant_id AND i.window_id = f.window_id WHERE tax <> 0"""
CTES["tax_bad"] = """
SELECT merchant_id, window_id, count(*) AS invoices, CAST(sum(tax_paise) AS BIGINT) AS amount_paise FROM invoices WHERE NOT valid GROUP BY ALL"""
CTES["tax_tds"] = """
SELECT f.merchant_id, f.window_id, greatest(tds - coalesce(x.amount_paise, 0), 0) AS amount_paise, tds AS paid_paise, x.amount_paise AS shown_paise
FROM wfees f LEFT JOIN f26 x ON x.merchant_id = f.merchant_id AND x.window_id = f.window_id WHERE tds <> 0"""

CTES["origins"] = """
SELECT merchant_id, CAST(unnest(generate_series(lo + INTERVAL 60 DAY, hi - INTERVAL 14 DAY, INTERVAL 28 DAY)) AS DATE) AS as_of
FROM (SELECT merchant_id, min(occurred_at) AS lo, max(occurred_at) AS hi FROM ev GROUP BY merchant_id)"""
CTES["known_ev"] = """
SELECT o.as_of, e.* FROM origins o JOIN ev e ON e.merchant_id = o.merchant_id AND e.occurred_at <= o.as_of AND e.recorded_at <= o.as_of"""
CTES["lookback"] = "SELECT * FROM known_ev WHERE occurred_at >= as_of - 45"
CTES["rates"] = """
SELECT *, gross - fees - deductions AS implied FROM (SELECT o.merchant_id, o.as_of,
  CAST(coalesce(sum(amount_paise) FILTER (WHERE type = 'payment_captured'), 0) AS BIGINT) AS gross,
  CAST(coalesce(sum(fee_paise + tax_paise + tds_paise) FILTER (WHERE type = 'payment_captured'), 0) AS BIGINT) AS fees,
  CAST(coalesce(sum(amount_paise) FILTER (WHERE type IN ('refund_issued', 'dispute_opened')), 0) AS BIGINT) AS deductions,
  CAST(coalesce(sum(amount_paise) FILTER (WHERE type = 'bank_credit_received'), 0) AS BIGINT) AS landed
FROM origins o LEFT JOIN lookback l ON l.merchant_id = o.merchant_id AND l.as_of = o.as_of GROUP BY ALL)"""
CTES["weekdays"] = """
SELECT merchant_id, as_of, CAST(isodow(occurred_at) - 1 AS INT) AS weekday, CAST(floor(sum(w * g) / sum(w) + 0.5) AS BIGINT) AS typical
FROM (SELECT merchant_id, as_of, occurred_at, CAST(sum(amount_paise) AS DOUBLE) AS g, pow(0.5, CAST(as_of - occurred_at AS INT) / 45.0) AS w
      FROM lookback WHERE type = 'payment_captured' GROUP BY ALL) GROUP BY ALL"""
CTES["waiting"] = """
SELECT k.merchant_id, k.as_of, k.amount_paise - k.fee_paise - k.tax_paise - k.tds_paise AS net, c.t2_actual AS lands
FROM known_ev k JOIN calendar c ON c.d = k.occurred_at
WHERE k.type = 'payment_captured' AND NOT EXISTS (SELECT 1 FROM covers v WHERE v.merchant_id = k.merchant_id AND v.payment_id = k.entity_id AND v.settled_on <= k.as_of)"""
CTES["ocr"] = "SELECT merchant_id, as_of, entity_id AS bank_txn_id, amount_paise, occurred_at, narration FROM known_ev WHERE type = 'bank_credit_received'"
CTES["opa"] = "SELECT merchant_id, as_of, entity_id AS settlement_id, utr, amount_paise, occurred_at FROM known_ev WHERE type = 'settlement_executed'"
CTES.update(link_ctes("o", "merchant_id, as_of"))
CTES["overdue"] = """
SELECT o.merchant_id, o.as_of, CAST(coalesce(sum(net) FILTER (WHERE lands <= o.as_of), 0) AS BIGINT) AS overdue_paise
FROM origins o LEFT JOIN waiting w ON w.merchant_id = o.merchant_id AND w.as_of = o.as_of GROUP BY ALL"""
CTES["written_off"] = """
SELECT o.merchant_id, o.as_of, CAST(coalesce(sum(amount_paise) FILTER (WHERE u.occurred_at < o.as_of - 3), 0) AS BIGINT) AS written_off_paise
FROM origins o LEFT JOIN ounlinked u ON u.merchant_id = o.merchant_id AND u.as_of = o.as_of GROUP BY ALL"""
CTES["pending"] = """
SELECT merchant_id, as_of, day, CAST(sum(net) AS BIGINT) AS net FROM (
  SELECT merchant_id, as_of, lands AS day, net FROM waiting WHERE lands > as_of
  UNION ALL SELECT merchant_id, as_of, next_open, amount_paise FROM ounlinked JOIN calendar ON d = as_of + 1 WHERE occurred_at >= as_of - 3) GROUP BY ALL"""


def _rh(x: str, n: str, d: str) -> str:
    up = f"(2 * CAST(abs({x}) AS HUGEINT) * {n} + {d}) // (2 * CAST({d} AS HUGEINT))"
    return f"CASE WHEN {d} = 0 THEN 0 WHEN {x} < 0 THEN -({up}) ELSE {up} END"


def _real(x: str) -> str:
    return f"CASE WHEN implied > 0 AND landed < implied THEN {_rh(x, 'landed', 'implied')} ELSE {x} END"


CTES["committed"] = f"""
SELECT merchant_id, as_of, day, CAST({_real("a")} AS BIGINT) AS committed_paise FROM (
  SELECT p.merchant_id, p.as_of, day, implied, landed, net - {_rh("net", "deductions", "gross")} AS a
  FROM pending p JOIN rates r ON r.merchant_id = p.merchant_id AND r.as_of = p.as_of)"""
CTES["ahead"] = "SELECT merchant_id, as_of, CAST(as_of + CAST(unnest(range(1, 15)) AS INT) AS DATE) AS day FROM origins"
CTES["projected"] = f"""
SELECT merchant_id, as_of, t2_actual AS day, CAST(sum({_real("b")}) AS BIGINT) AS projected_paise FROM (
  SELECT *, a - {_rh("a", "deductions", "gross")} AS b FROM (
    SELECT h.merchant_id, h.as_of, c.t2_actual, gross, fees, deductions, landed, implied, typical - {_rh("typical", "fees", "gross")} AS a
    FROM ahead h JOIN calendar c ON c.d = h.day JOIN weekdays w ON w.merchant_id = h.merchant_id AND w.as_of = h.as_of AND w.weekday = isodow(h.day) - 1
    JOIN rates r ON r.merchant_id = h.merchant_id AND r.as_of = h.as_of)) GROUP BY ALL"""
CTES["fdays"] = """
SELECT merchant_id, as_of, day, committed_paise, projected_paise, committed_paise + projected_paise AS expected_paise FROM (
  SELECT h.merchant_id, h.as_of, h.day, CASE WHEN c.is_bank_day THEN coalesce(committed_paise, 0) ELSE 0 END AS committed_paise,
         CASE WHEN c.is_bank_day THEN coalesce(projected_paise, 0) ELSE 0 END AS projected_paise
  FROM ahead h JOIN calendar c ON c.d = h.day
  LEFT JOIN committed m ON m.merchant_id = h.merchant_id AND m.as_of = h.as_of AND m.day = h.day
  LEFT JOIN projected p ON p.merchant_id = h.merchant_id AND p.as_of = h.as_of AND p.day = h.day)"""
CTES["outcomes"] = """
SELECT f.merchant_id, f.as_of, f.forecast_paise, a.actual_paise, a.actual_paise - f.forecast_paise AS error_paise
FROM (SELECT merchant_id, as_of, CAST(sum(expected_paise) AS BIGINT) AS forecast_paise FROM fdays GROUP BY ALL) f
JOIN (SELECT o.merchant_id, o.as_of, CAST(coalesce(sum(amount_paise), 0) AS BIGINT) AS actual_paise FROM origins o LEFT JOIN ev e
      ON e.merchant_id = o.merchant_id AND e.type = 'bank_credit_received' AND e.occurred_at > o.as_of AND e.occurred_at <= o.as_of + 14 GROUP BY ALL) a
ON a.merchant_id = f.merchant_id AND a.as_of = f.as_of"""
CTES["floors"] = """
SELECT merchant_id, as_of, forecast_paise, actual_paise, CAST(n AS INT) AS calibrated_on,
       greatest(0, CAST(trunc(forecast_paise * (1 - q)) AS BIGINT)) AS floor_paise, n >= 9 AS certified
FROM (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE past[CAST(least(ceil((n + 1) * (1 - CAST(0.1 AS DOUBLE))), n) AS INT)] END AS q
      FROM (SELECT *, len(past) AS n FROM (SELECT *, list_sort(coalesce(list(score) OVER (PARTITION BY merchant_id ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS past
            FROM (SELECT *, CASE WHEN forecast_paise <= 0 THEN 0.0 ELSE CAST(forecast_paise - actual_paise AS DOUBLE) / CAST(forecast_paise AS DOUBLE) END AS score
                  FROM outcomes WHERE forecast_paise <> 0))))"""

# --- search and grounding -------------------------------------------------------------------

CTES["hold"] = """
SELECT f.merchant_id, f.window_id, f.cause, f.amount_paise,
       CAST(s.remainder_paise + f.amount_paise - CASE WHEN p.raw_paise IS NOT NULL AND p.raw_paise <> 0 THEN r.raw_paise ELSE 0 END AS BIGINT) AS remainder_paise,
       f.cause IN ('captured_not_yet_settled', 'settlement_in_flight') AS refined_by_other
FROM findings f JOIN refined r ON r.merchant_id = f.merchant_id AND r.window_id = f.window_id AND r.cause = f.cause
JOIN summary s ON s.merchant_id = f.merchant_id AND s.window_id = f.window_id
LEFT JOIN refined p ON p.merchant_id = f.merchant_id AND p.window_id = f.window_id
  AND p.cause = CASE f.cause WHEN 'bank_holiday_delay' THEN 'captured_not_yet_settled' WHEN 'settlement_never_arrived' THEN 'settlement_in_flight' END"""
CTES["slices"] = """
SELECT merchant_id, window_id, account || '|' || event_type AS slice, account, amount_paise FROM moves
UNION ALL SELECT merchant_id, window_id, account, account, CAST(sum(amount_paise) AS BIGINT) FROM moves GROUP BY ALL
UNION ALL SELECT merchant_id, window_id, 'fee_at_contracted_rate', 'fee_expense', contract FROM wfees
UNION ALL SELECT merchant_id, window_id, 'fee_as_billed', 'fee_expense', fee FROM wfees
UNION ALL SELECT merchant_id, window_id, 'fee_billed_above_contract', 'fee_expense', fee - contract FROM wfees"""
CTES["cases"] = "SELECT * FROM hold WHERE remainder_paise <> 0 AND NOT refined_by_other"
CTES["proposed"] = """
SELECT * FROM (SELECT c.merchant_id, c.window_id, c.cause, min(s.account) AS account, count(DISTINCT s.account) AS accounts,
  arg_min(slice, CAST(CASE WHEN contains(slice, '|') THEN 0 ELSE 1 END AS VARCHAR) || lpad(CAST(length(slice) AS VARCHAR), 4, '0') || slice) AS slice
FROM cases c JOIN slices s ON s.merchant_id = c.merchant_id AND s.window_id = c.window_id AND s.amount_paise = c.remainder_paise GROUP BY ALL) WHERE accounts = 1"""
CTES["judged"] = """
SELECT c.merchant_id, c.window_id, c.cause, p.slice, p.account, bool_and(
  v.claimed_paise - CASE WHEN h.account = v.account THEN c.amount_paise ELSE 0 END + CASE WHEN p.account = v.account THEN c.remainder_paise ELSE 0 END = v.actual_paise) AS accepted
FROM cases c JOIN proposed p ON p.merchant_id = c.merchant_id AND p.window_id = c.window_id AND p.cause = c.cause
JOIN claim_of h ON h.cause = c.cause JOIN coverage v ON v.merchant_id = c.merchant_id AND v.window_id = c.window_id GROUP BY ALL"""
CTES["swept"] = """
SELECT c.merchant_id, c.window_id, c.cause, c.amount_paise, c.remainder_paise, j.slice, j.account, coalesce(j.accepted, false) AS accepted
FROM cases c LEFT JOIN judged j ON j.merchant_id = c.merchant_id AND j.window_id = c.window_id AND j.cause = c.cause"""
CTES["largest"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, window_id ORDER BY abs(amount_paise) DESC, account) AS rn FROM (
  SELECT merchant_id, window_id, account, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM moves WHERE account <> 'bank' GROUP BY ALL)) WHERE rn = 1"""
CTES["permitted"] = """
SELECT DISTINCT merchant_id, window_id, amount_paise FROM (
  SELECT merchant_id, window_id, unnest([raw_paise, amount_paise]) AS amount_paise FROM refined WHERE raw_paise <> 0
  UNION ALL SELECT merchant_id, window_id, amount_paise FROM exceptions
  UNION ALL SELECT merchant_id, window_id, unnest([gross_paise, landed_paise, gap_paise, explained_paise, remainder_paise, unresolved_paise]) FROM summary)"""
CTES["cited"] = """
SELECT s.merchant_id, s.window_id, unnest(CASE WHEN s.window_id % 9 = 4 THEN [landed_paise, gross_paise, gap_paise + 12345]
       WHEN f.amount_paise IS NULL THEN [landed_paise, gross_paise, gap_paise] ELSE [landed_paise, gross_paise, gap_paise, f.amount_paise] END) AS paise
FROM summary s LEFT JOIN findings f ON f.merchant_id = s.merchant_id AND f.window_id = s.window_id AND f.position = 1"""
CTES["grounded"] = """
SELECT c.merchant_id, c.window_id, paise, EXISTS (SELECT 1 FROM permitted p WHERE p.merchant_id = c.merchant_id AND p.window_id = c.window_id
       AND abs(p.amount_paise) = abs(c.paise)) AS grounded FROM cited c"""
