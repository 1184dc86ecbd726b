"""What DuckDB should answer for each registered query."""

from __future__ import annotations

from oracle.ledger_sql import _SLICES, CTES, query

SQL: dict[str, str] = {}


def _add(name: str, body: str, **local: str) -> None:
    SQL[name] = query(body, **local)


_add("s12_events", "SELECT merchant_id, event_id, type, occurred_at, recorded_at, entity_id, counterparty, method, amount_paise, "
     "fee_paise, tax_paise, tds_paise, utr, narration, detail, currency, won, value_date FROM ev")
_add("s12_covers", "SELECT merchant_id, settlement_id, utr, payment_id, settled_on FROM covers")
_add("s12_calendar", "SELECT d, is_bank_day, open_ordinal, next_open, t2_naive, t2_actual, slipped_days FROM calendar")
_add("p1_postings", "SELECT * FROM postings")
_KIND = {
    "captures": "payment_captured", "settlements": "settlement_executed", "credits": "bank_credit_received",
    "refunds": "refund_issued", "disputes": "dispute_opened", "resolutions": "dispute_resolved", "holds": "risk_hold_applied",
    "releases": "risk_hold_released", "transfers": "route_transfer", "adjustments": "gateway_adjustment",
}
_add("p2_selectors", " UNION ALL ".join(
    [f"SELECT '{n}' AS selector, merchant_id, entity_id, occurred_at, amount_paise FROM ev WHERE type = '{t}'" for n, t in _KIND.items()]
    + ["SELECT 'bank_outflows', merchant_id, entity_id, occurred_at, amount_paise FROM ev WHERE type IN ('bank_charge_applied', 'bank_debit')"]))
_add("p3_as_of", "SELECT merchant_id, account, CAST(sum(amount_paise) AS BIGINT) AS balance_paise FROM postings "
     "WHERE occurred_at <= DATE '1998-06-30' AND recorded_at <= DATE '1998-06-30' GROUP BY ALL")
_add("p4_known_by_window", "SELECT merchant_id, window_id, account, event_type, amount_paise FROM moves_then")
_add("p5_w11_windows", "SELECT * FROM windows")
_add("p8_refund_gate", "SELECT merchant_id, entity_id AS payment_id FROM ev c WHERE type = 'payment_captured' AND CAST(substr(entity_id, 5) AS BIGINT) % 9 = 0 "
     "AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.type = 'refund_issued' AND r.merchant_id = c.merchant_id AND r.counterparty = c.entity_id)")
_add("p11_bank_charges", "SELECT merchant_id, entity_id, regexp_matches(lower(narration), 'chrg|charge|chg|comm|amc|maint|sms alert|annual fee|service fee|penalty|gst on') AS charge "
     "FROM ev WHERE narration IS NOT NULL")
_SHAPES = (r"ignore\s+(all\s+)?(previous|prior|above)|disregard\s+(the\s+)?(above|previous)|new\s+instructions?|system\s*(prompt|message)"
           r"|you\s+are\s+now|act\s+as|do\s+not\s+(escalate|report|flag)|report\s+.{0,20}\s*as\s+zero"
           r"|</?(system|assistant|user|instructions?)>|\[/?INST\]|```")
_add("p12_instruction_shapes", f"SELECT 'documents' AS source, doc_id AS id, regexp_matches(text, '{_SHAPES}', 'i') AS flagged FROM documents "
     f"UNION ALL SELECT 'conversations', conv_id * 100000 + turn, regexp_matches(text, '{_SHAPES}', 'i') FROM conversations "
     f"UNION ALL SELECT 'pages', page_id, regexp_matches(html, '{_SHAPES}', 'i') FROM pages")
_add("p13_gateway_credits", "SELECT merchant_id, count(*) AS credits, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM ev "
     "WHERE type = 'bank_credit_received' AND contains(lower(narration), 'gateway') GROUP BY ALL")

_add("f5_amounts", "SELECT k, CASE WHEN k % 9 IN (0, 1, 4, 6) THEN gross WHEN k % 9 IN (2, 3, 5) THEN -gross END AS paise FROM facts")
_add("f21_return_amounts", "SELECT k, CASE WHEN k % 5 < 2 THEN gross ELSE 0 END AS paise FROM facts")
_add("f6_dates", "SELECT k, CASE WHEN k % 10 < 9 THEN d END AS day FROM facts")
_add("f7_header_keys", "SELECT doc_id, len(h) AS n, md5(h) AS key_md5 FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS h FROM documents)")
_PAIRS = "regexp_replace(reverse(regexp_replace(reverse(left(w, greatest(len(w) - 3, 0))), '(..)', '\\1,', 'g')), '^,', '')"
_add("f19_money_columns", f"SELECT merchant_id, account, CASE WHEN v < 0 THEN '-' ELSE '' END || 'INR ' || CASE WHEN len(w) > 3 THEN {_PAIRS} || ',' || right(w, 3) ELSE w END "
     "|| '.' || lpad(CAST(abs(v) % 100 AS VARCHAR), 2, '0') AS balance_paise FROM (SELECT merchant_id, account, v, CAST(abs(v) // 100 AS VARCHAR) AS w FROM ("
     "SELECT merchant_id, account, CAST(sum(amount_paise) AS BIGINT) AS v FROM postings GROUP BY ALL))")
_add("p9_invalid_contracts", "SELECT k, reason FROM (SELECT k, CASE WHEN k % 11 IN (3, 5) THEN 'unknown method' WHEN k % 7 IN (1, 5) THEN 'rate is not a number' "
     "WHEN k % 7 IN (2, 3) THEN 'rate outside 0 to 10 percent' END AS reason FROM facts) WHERE reason IS NOT NULL")
_add("w13_bank_days", "SELECT f.d, n, CASE WHEN n = 0 THEN f.d ELSE o.d END AS landed FROM (SELECT DISTINCT d, unnest(range(4))::INT AS n FROM facts) f JOIN cal1 c ON c.d = f.d "
     "LEFT JOIN cal1 o ON o.is_bank_day AND o.open_ordinal = c.open_ordinal + n")
_add("j1_links", "SELECT l.merchant_id, bank_txn_id, settlement_id, rule, candidates FROM links l")
_add("j1_busy_days", "SELECT merchant_id, bank_txn_id, settlement_id FROM dlinked")
_add("j1_tiers", "SELECT merchant_id, rule, count(*) AS credits, count(settlement_id) AS linked FROM links GROUP BY ALL")
_add("j1a_candidates", "SELECT merchant_id, cday AS occurred_at, count(DISTINCT bank_txn_id) AS credits, count(DISTINCT settlement_id) AS in_reach FROM pairs GROUP BY ALL")
_add("j1e_open_credits", "SELECT merchant_id, bank_txn_id, rule, reason FROM (SELECT l.*, CASE "
     "WHEN rule = 'abstain_ambiguous' THEN (SELECT max(exact_n) FROM by_amount a WHERE a.merchant_id = l.merchant_id AND a.bank_txn_id = l.bank_txn_id) "
     "|| ' payout(s) and ' || (SELECT sharing FROM sharing s WHERE s.merchant_id = l.merchant_id AND s.bank_txn_id = l.bank_txn_id) "
     "|| ' credit(s) share this amount and window' END AS reason FROM links l) WHERE rule = 'abstain_ambiguous'")
_add("j2_naive_missing", "SELECT p.merchant_id, p.entity_id AS settlement_id FROM ev p WHERE p.type = 'settlement_executed' AND NOT EXISTS "
     "(SELECT 1 FROM ev c WHERE c.type = 'bank_credit_received' AND c.merchant_id = p.merchant_id AND contains(c.narration, p.utr))")
_add("j3_unlinked_payouts", "SELECT merchant_id, entity_id AS settlement_id, utr, occurred_at, amount_paise FROM ev p WHERE type = 'settlement_executed' "
     "AND NOT EXISTS (SELECT 1 FROM links l WHERE l.merchant_id = p.merchant_id AND l.settlement_id = p.entity_id)")
_add("j4_missing_payouts", "SELECT merchant_id, entity_id AS settlement_id, utr, occurred_at, amount_paise FROM missing")
_add("j5_slipped_receivable", "SELECT p.merchant_id, p.occurred_at, t2_actual, slipped_days, CAST(sum(amount_paise) AS BIGINT) AS amount_paise "
     "FROM postings p JOIN calendar c ON c.d = p.occurred_at WHERE account = 'gateway_receivable' AND event_type = 'payment_captured' AND slipped_days > 0 GROUP BY ALL")
_add("j6_splits_of_delayed", "SELECT DISTINCT d.merchant_id, d.window_id, t.event_id AS split_id, t.amount_paise FROM delayed d JOIN ev t "
     "ON t.merchant_id = d.merchant_id AND t.type = 'route_transfer' AND t.counterparty = d.payment_id")
_add("j7_exceptions", "SELECT merchant_id, window_id, bank_txn_id, amount_paise, occurred_at, rule FROM exceptions")
_add("j8_priced_captures", "SELECT merchant_id, payment_id, method, amount_paise, fee_paise, contract_paise FROM priced")
_add("j9_unsettled", "SELECT merchant_id, entity_id AS payment_id, occurred_at, amount_paise FROM ev e WHERE type = 'payment_captured' "
     "AND NOT EXISTS (SELECT 1 FROM covers c WHERE c.merchant_id = e.merchant_id AND c.payment_id = e.entity_id)")
_add("j10_restated_causes", "SELECT merchant_id, window_id, cause, now_paise, then_paise, delta_paise, appeared FROM restated")
_add("j11_scored", "SELECT * FROM scored")
_add("j13_coverage", "SELECT *, claimed_paise - actual_paise AS drift_paise, claimed_paise = actual_paise AS ok FROM coverage")

_add("a1_balances", "SELECT merchant_id, account, CAST(sum(amount_paise) AS BIGINT) AS balance_paise FROM postings GROUP BY ALL")
_add("a2_balance_delta", "SELECT * FROM (SELECT merchant_id, account, CAST(sum(amount_paise) FILTER (WHERE occurred_at > DATE '1998-06-30') AS BIGINT) AS delta_paise "
     "FROM postings GROUP BY ALL) WHERE delta_paise <> 0")


def _bal(account: str) -> str:
    return f"CAST(coalesce(sum(amount_paise) FILTER (WHERE account = '{account}'), 0) AS BIGINT)"


_add("a3_cash_position", f"SELECT *, in_transit_paise + receivable_paise AS expected_soon_paise, on_hold_paise + dispute_reserve_paise AS blocked_paise FROM ("
     f"SELECT merchant_id, {_bal('bank')} AS available_paise, {_bal('settlement_in_transit')} AS in_transit_paise, {_bal('gateway_receivable')} AS receivable_paise, "
     f"{_bal('on_hold')} AS on_hold_paise, {_bal('dispute_reserve')} AS dispute_reserve_paise FROM postings GROUP BY merchant_id)")
_VAR = ("SELECT merchant_id, window_id, window_start, window_end, gross_paise, credits_paise, landed_paise, explained_paise, gross_paise - landed_paise AS gap_paise, "
        "gross_paise - landed_paise - explained_paise AS remainder_paise, gross_paise - landed_paise = explained_paise AS closes FROM variance")
_add("a4_variance_weekly", _VAR)
_add("a4_movements", "SELECT merchant_id, window_id, account, actual_paise AS amount_paise FROM moved WHERE actual_paise <> 0")
_add("a5_movement_slices", "SELECT merchant_id, window_id, account, event_type, amount_paise FROM moves UNION ALL "
     "SELECT merchant_id, window_id, account, NULL, CAST(sum(amount_paise) AS BIGINT) FROM moves GROUP BY ALL")
_add("a6_types_touching", "SELECT merchant_id, account, event_type, CAST(sum(amount_paise) AS BIGINT) AS amount_paise, count(*) AS n FROM postings GROUP BY ALL")
_CITES = {"refunds": "refunds_issued", "dispute_reserve": "dispute_reserve_held", "chargeback_loss": "chargeback_lost",
          "gateway_adjustments": "gateway_adjustment", "other_outflow": "other_bank_outflow", "on_hold": "risk_hold"}
_CASE = "CASE account " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in _CITES.items()) + " END"
_add("a7_evidence_refs", f"SELECT merchant_id, window_id, cause, ref FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, window_id, cause ORDER BY ref) AS rn FROM ("
     f"SELECT DISTINCT p.merchant_id, window_id, {_CASE} AS cause, ref FROM postings p JOIN windows w ON w.merchant_id = p.merchant_id "
     f"AND occurred_at BETWEEN window_start AND window_end WHERE {_CASE} IS NOT NULL AND ref <> ''))  "
     "UNION ALL SELECT p.merchant_id, window_id, 'fee_rate_increase', method FROM priced p JOIN windows w ON w.merchant_id = p.merchant_id "
     "AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL HAVING sum(fee_paise) <> sum(contract_paise) "
     "UNION ALL SELECT DISTINCT merchant_id, window_id, 'bank_holiday_delay', CAST(t2_naive AS VARCHAR) FROM windows JOIN calendar ON d BETWEEN window_start AND window_end "
     "WHERE t2_naive <= window_end AND t2_actual > window_end "
     "UNION ALL SELECT m.merchant_id, window_id, 'settlement_never_arrived', utr FROM missing m JOIN windows w ON w.merchant_id = m.merchant_id "
     "AND occurred_at BETWEEN window_start AND window_end AND occurred_at <= window_end - 3")
_add("a7_shown_refs", f"SELECT merchant_id, window_id, cause, ref FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, window_id, cause ORDER BY ref) AS rn FROM ("
     f"SELECT DISTINCT p.merchant_id, window_id, {_CASE} AS cause, ref FROM postings p JOIN windows w ON w.merchant_id = p.merchant_id "
     f"AND occurred_at BETWEEN window_start AND window_end WHERE {_CASE} IS NOT NULL AND ref <> '')) WHERE rn <= 25 "
     "UNION ALL SELECT p.merchant_id, window_id, 'fee_rate_increase', method FROM priced p JOIN windows w ON w.merchant_id = p.merchant_id "
     "AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL HAVING sum(fee_paise) <> sum(contract_paise) "
     "UNION ALL SELECT DISTINCT merchant_id, window_id, 'bank_holiday_delay', CAST(t2_naive AS VARCHAR) FROM windows JOIN calendar ON d BETWEEN window_start AND window_end "
     "WHERE t2_naive <= window_end AND t2_actual > window_end "
     "UNION ALL SELECT m.merchant_id, window_id, 'settlement_never_arrived', utr FROM missing m JOIN windows w ON w.merchant_id = m.merchant_id "
     "AND occurred_at BETWEEN window_start AND window_end AND occurred_at <= window_end - 3")
_add("a8_fees_by_method", "SELECT p.merchant_id, window_id, method, count(*) AS captures, CAST(sum(amount_paise) AS BIGINT) AS gross_paise, CAST(sum(fee_paise) AS BIGINT) AS fee_paise, "
     "CAST(sum(contract_paise) AS BIGINT) AS contract_paise, CAST(sum(fee_paise - contract_paise) AS BIGINT) AS excess_paise FROM priced p JOIN windows w "
     "ON w.merchant_id = p.merchant_id AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL HAVING sum(fee_paise - contract_paise) <> 0")
_add("a9_payout_rebuild", "SELECT merchant_id, 'rep_' || strftime(t2_actual, '%Y%m%d') AS settlement_id, CAST(sum(amount_paise) AS BIGINT) AS net_paise, count(*) AS covers, "
     "strftime(t2_actual, '%Y%m%d') || merchant_id AS utr FROM order_postings JOIN calendar ON d = occurred_at WHERE account = 'gateway_receivable' "
     "GROUP BY merchant_id, t2_actual HAVING sum(amount_paise) > 0")
_add("a10_missing_utrs", "SELECT m.merchant_id, window_id, string_agg(utr, ',' ORDER BY utr) AS utrs, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM missing m JOIN windows w "
     "ON w.merchant_id = m.merchant_id AND occurred_at BETWEEN window_start AND window_end AND occurred_at <= window_end - 3 GROUP BY ALL")
_add("a16_evaluation", "SELECT windows, closed, matched, hallucinated, missed, CAST(error_paise AS BIGINT) AS error_paise, round(closed / windows, 6) AS close_rate, "
     "round(hallucinated / (matched + hallucinated), 6) AS hallucinated_rate, round(matched / (matched + hallucinated), 6) AS precision, "
     "round(matched / (matched + missed), 6) AS recall, round(exact / matched, 6) AS exact_rate FROM ("
     "SELECT count(*) FILTER (WHERE verdict = 'matched') AS matched, count(*) FILTER (WHERE verdict = 'hallucinated') AS hallucinated, "
     "count(*) FILTER (WHERE verdict = 'missed') AS missed, count(*) FILTER (WHERE verdict = 'matched' AND error_paise = 0) AS exact, "
     "coalesce(sum(abs(error_paise)) FILTER (WHERE verdict = 'matched'), 0) AS error_paise FROM scored), "
     "(SELECT count(*) AS windows, count(*) FILTER (WHERE closes) AS closed FROM summary)")
_add("a16_blind_spots", "SELECT cause, count(*) AS windows FROM scored WHERE verdict = 'missed' GROUP BY ALL")
_M = ("card", "upi", "netbanking", "wallet", "emi")
_add("a18_merchant_profile", "SELECT *, round(fee_paise / gross_paise, 6) AS fee_rate, round(tax_paise / fee_paise, 6) AS tax_on_fee, "
     "round(disputes / (card_captures + emi_captures), 6) AS chargebacks_per_card, round(upi_captures / captures, 6) AS upi_share, round(refunded_paise / gross_paise, 6) AS refund_rate FROM ("
     "SELECT merchant_id, count(*) FILTER (WHERE type = 'payment_captured') AS captures, "
     + ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE type = '{t}'), 0) AS BIGINT) AS {n}" for c, t, n in (
         ("amount_paise", "payment_captured", "gross_paise"), ("fee_paise", "payment_captured", "fee_paise"),
         ("tax_paise", "payment_captured", "tax_paise"), ("amount_paise", "refund_issued", "refunded_paise")))
     + ", count(*) FILTER (WHERE type = 'dispute_opened') AS disputes, "
     + ", ".join(f"count(*) FILTER (WHERE type = 'payment_captured' AND method = '{m}') AS {m}_captures" for m in _M)
     + " FROM ev GROUP BY merchant_id)")
_add("a19_insights", "SELECT * FROM buckets")
_add("a20_weeks", "SELECT * FROM weekly")
_add("a20_overcharge_start", "SELECT * FROM hike")
_add("a21_close_summary", "SELECT * FROM summary")
_add("a22_slices", "SELECT DISTINCT merchant_id, account, event_type FROM postings")
_add("a25_events_by_type", "SELECT merchant_id, type, count(*) AS events, CAST(max(recorded_at - occurred_at) AS INT) AS longest_lag FROM ev GROUP BY ALL")

for _cause in ("normal_fee", "fee_rate_increase", "gst_on_fee", "tds_194o", "instant_settlement_fee", "bank_charges", "refunds_issued",
               "dispute_reserve_held", "chargeback_lost", "gateway_adjustment", "other_bank_outflow", "route_split", "risk_hold",
               "captured_not_yet_settled", "settlement_in_flight", "bank_holiday_delay", "settlement_never_arrived"):
    _add(f"cause_{_cause}", f"SELECT merchant_id, window_id, raw_paise AS amount_paise FROM measured WHERE cause = '{_cause}'")
_add("c18_findings", "SELECT merchant_id, window_id, cause, amount_paise, alarming, permanent, position FROM findings")
_add("c21_restatement", "SELECT a.merchant_id, a.window_id, causes_moved, late_arrivals, reclassified_paise, gap_delta_paise, gap_delta_paise - net AS drift_paise FROM ("
     "SELECT merchant_id, window_id, count(*) AS causes_moved, count(*) FILTER (WHERE appeared) AS late_arrivals, CAST((sum(abs(delta_paise)) + 1) // 2 AS BIGINT) AS reclassified_paise, "
     "CAST(sum(delta_paise) AS BIGINT) AS net FROM restated GROUP BY ALL) a JOIN (SELECT v.merchant_id, v.window_id, CAST((gross_paise - landed_paise) - coalesce(g.gap, 0) AS BIGINT) AS gap_delta_paise "
     "FROM variance v LEFT JOIN (SELECT merchant_id, window_id, coalesce(sum(-amount_paise) FILTER (WHERE account = 'revenue' AND event_type = 'payment_captured'), 0) "
     "- coalesce(sum(amount_paise) FILTER (WHERE account = 'bank'), 0) AS gap FROM moves_then GROUP BY ALL) g ON g.merchant_id = v.merchant_id AND g.window_id = v.window_id) b "
     "ON a.merchant_id = b.merchant_id AND a.window_id = b.window_id")
_add("c27_actions", """
SELECT merchant_id, window_id, cause, amount_paise, urgency, deadline, CASE WHEN cause = 'fee_rate_increase' THEN yearly END AS per_year_paise,
 CAST(CASE WHEN cause = 'fee_rate_increase' THEN (yearly + amount_paise) * 3 WHEN cause = 'chargeback_lost' THEN amount_paise // 10
      ELSE amount_paise * CASE urgency WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END END AS BIGINT) AS score
FROM (SELECT f.merchant_id, f.window_id, cause, amount_paise,
  CASE WHEN cause IN ('settlement_never_arrived', 'fee_rate_increase') THEN 'high' WHEN cause IN ('risk_hold', 'dispute_reserve_held') THEN 'medium' ELSE 'low' END AS urgency,
  CASE WHEN cause = 'gst_on_fee' THEN make_date(year(window_start) + CASE WHEN month(window_start) >= 4 THEN 1 ELSE 0 END, 11, 30) END AS deadline,
  CAST(round_even(CAST(amount_paise AS DECIMAL(20,0)) * 365 / greatest(CAST(window_end - window_start AS INT) + 1, 1), 0) AS BIGINT) AS yearly
  FROM findings f JOIN windows w ON w.merchant_id = f.merchant_id AND w.window_id = f.window_id
  WHERE amount_paise > 0 AND cause IN ('settlement_never_arrived', 'fee_rate_increase', 'risk_hold', 'dispute_reserve_held', 'gst_on_fee', 'tds_194o', 'chargeback_lost'))""")

_add("n1_largest_payouts", "SELECT merchant_id, entity_id AS settlement_id, utr, occurred_at, amount_paise FROM ev WHERE type = 'settlement_executed' "
     "ORDER BY amount_paise DESC, merchant_id, entity_id LIMIT 10")
SQL["n2_payouts_without_credit"] = SQL["j3_unlinked_payouts"]
_add("n3_failed_by_method", "SELECT merchant_id, method, count(*) AS failed, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM ev WHERE type = 'payment_failed' GROUP BY ALL")
_add("n4_fees_by_method", "SELECT merchant_id, method, count(*) AS captures, CAST(sum(fee_paise) AS BIGINT) AS fee_paise, CAST(sum(tax_paise) AS BIGINT) AS gst_paise FROM ev WHERE type = 'payment_captured' GROUP BY ALL")
_add("n5_refunds", "SELECT merchant_id, occurred_at, entity_id AS refund_id, counterparty AS payment_id, amount_paise FROM ev WHERE type = 'refund_issued'")
_add("n6_disputes", "SELECT merchant_id, occurred_at, type, entity_id AS dispute_id, counterparty AS payment_id, amount_paise, detail AS reason FROM ev WHERE type IN ('dispute_opened', 'dispute_resolved')")
_add("n7_unattributed_credits", "SELECT e.merchant_id, l.bank_txn_id, e.amount_paise, e.occurred_at, l.rule FROM links l JOIN ev e ON e.merchant_id = l.merchant_id AND e.entity_id = l.bank_txn_id AND e.type = 'bank_credit_received' WHERE l.settlement_id IS NULL")
_add("n8_slipped_days", "SELECT d, t2_naive, t2_actual, slipped_days FROM calendar WHERE slipped_days > 0")
SQL["n9_account_balances"] = SQL["a1_balances"]
_add("n10_view_query", "SELECT account, event_type, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM postings GROUP BY ALL")

_add("q1_unbalanced_entries", "SELECT merchant_id, event_id, CAST(sum(amount_paise) AS BIGINT) AS off_paise, count(*) AS rows FROM postings GROUP BY ALL HAVING sum(amount_paise) <> 0")
_add("q2_currency_totals", "SELECT merchant_id, 'INR' AS currency, CAST(sum(amount_paise) AS BIGINT) AS off_paise FROM postings GROUP BY ALL")
_add("q3_wrong_side", "SELECT * FROM (SELECT merchant_id, account, CAST(sum(amount_paise) AS BIGINT) AS balance_paise FROM postings GROUP BY ALL) "
     "WHERE account IN ('dispute_reserve', 'on_hold', 'gateway_receivable') AND balance_paise < 0")
_add("q5_identity", _VAR + " WHERE gross_paise - landed_paise <> explained_paise")
_add("q6_unclaimed", "SELECT * FROM (SELECT *, claimed_paise - actual_paise AS drift_paise, claimed_paise = actual_paise AS ok FROM coverage) WHERE drift_paise <> 0")
_add("q1_lost_legs", "SELECT p.merchant_id, p.event_id, -l.amount_paise AS off_paise, count(*) AS rows FROM postings l JOIN postings p ON p.merchant_id = l.merchant_id AND p.event_id = l.event_id "
     "AND p.account <> 'refunds' WHERE l.account = 'refunds' AND l.amount_paise % 7 = 3 GROUP BY ALL")
_add("q5_lost_legs", "SELECT p.merchant_id, window_id, CAST(sum(amount_paise) AS BIGINT) AS remainder_paise FROM postings p JOIN windows w ON w.merchant_id = p.merchant_id "
     "AND occurred_at BETWEEN window_start AND window_end WHERE account = 'refunds' AND amount_paise % 7 = 3 GROUP BY ALL")
_add("q8_linkage_work", "SELECT merchant_id, count(DISTINCT bank_txn_id) AS credits, count(*) AS candidates, round(count(*) / count(DISTINCT bank_txn_id), 6) AS per_credit FROM pairs GROUP BY ALL")

_add("k2_ranked_findings", "SELECT merchant_id, window_id, cause, position FROM findings")
_add("k3_largest_account", "SELECT merchant_id, window_id, account, amount_paise FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, window_id ORDER BY abs(amount_paise) DESC, account) AS rn FROM ("
     "SELECT merchant_id, window_id, account, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM moves WHERE account <> 'bank' GROUP BY ALL)) WHERE rn = 1")
_add("u4_accounts_touched", "SELECT DISTINCT merchant_id, window_id, account FROM (SELECT merchant_id, window_id, account FROM refined JOIN claim_of USING (cause) "
     "UNION ALL SELECT merchant_id, window_id, account FROM moved WHERE actual_paise <> 0)")
SQL["x9_score_run"] = SQL["a16_evaluation"]
_add("x10_truth_by_window", "SELECT merchant_id, window_id, cause, actual_paise FROM truth_win")
_add("x11_linkage_against_naive", "SELECT coalesce(a.merchant_id, b.merchant_id) AS merchant_id, coalesce(ours, 0) AS ours, coalesce(naive, 0) AS naive FROM "
     "(SELECT m.merchant_id, count(DISTINCT entity_id) AS ours FROM missing m JOIN windows w ON w.merchant_id = m.merchant_id AND occurred_at BETWEEN window_start AND window_end "
     "AND occurred_at <= window_end - 3 GROUP BY ALL) a FULL JOIN (SELECT p.merchant_id, count(*) AS naive FROM ev p WHERE p.type = 'settlement_executed' AND NOT EXISTS "
     "(SELECT 1 FROM ev c WHERE c.type = 'bank_credit_received' AND c.merchant_id = p.merchant_id AND contains(c.narration, p.utr)) GROUP BY ALL) b ON a.merchant_id = b.merchant_id")
_add("x15_fee_audit", "SELECT merchant_id, payment_id, occurred_at, method, amount_paise, fee_paise, contract_paise, fee_paise - contract_paise AS excess_paise, "
     "CAST(fee_paise * 1000000 // amount_paise AS BIGINT) AS billed_ppm FROM priced WHERE fee_paise <> contract_paise")
_add("x13_closed_weeks", "SELECT merchant_id, count(*) AS windows, count(*) FILTER (WHERE closes) AS closed, count(*) FILTER (WHERE fully_covered) AS covered FROM summary GROUP BY ALL")
_add("x13_weekly_check", "SELECT merchant_id, count(*) AS windows, count(*) FILTER (WHERE closes) AS closed, count(*) FILTER (WHERE fully_covered) AS covered, "
     "any_value(coalesce(n, 0)) AS log_faults, any_value(coalesce(n, 0)) = 0 AS log_holds FROM summary LEFT JOIN (SELECT merchant_id, count(DISTINCT recorded_at) AS n FROM ("
     "SELECT merchant_id, recorded_at, row_number() OVER (PARTITION BY merchant_id ORDER BY recorded_at, occurred_at, event_id) AS seq FROM ev) "
     "WHERE merchant_id = 'm2' AND seq % 17 = 5 GROUP BY merchant_id) USING (merchant_id) GROUP BY merchant_id")
_add("x17_findings_rows", "SELECT f.merchant_id, f.window_id, f.cause, p.event_id, p.account, p.occurred_at, p.amount_paise, p.ref FROM findings f JOIN (VALUES "
     + ", ".join(f"('{c}', '{a}', " + (f"'{k}'" if k else "NULL") + ")" for c, a, k in _SLICES) + ") s(cause, account, kind) ON s.cause = f.cause "
     "JOIN windows w ON w.merchant_id = f.merchant_id AND w.window_id = f.window_id JOIN postings p ON p.merchant_id = w.merchant_id "
     "AND p.occurred_at BETWEEN window_start AND window_end AND p.account = s.account AND (kind IS NULL OR kind = p.event_type)")
_add("x20_evidence_grid", "SELECT w.merchant_id, w.window_id, c.cause, coalesce(r.raw_paise, 0) AS raw_paise, coalesce(r.amount_paise, 0) AS amount_paise, "
     "coalesce(r.raw_paise, 0) <> 0 AS supported FROM windows w CROSS JOIN claim_of c LEFT JOIN refined r ON r.merchant_id = w.merchant_id AND r.window_id = w.window_id AND r.cause = c.cause")

# --- log, statements, tax -------------------------------------------------------------------
_FIELDS = ("amount_paise", "counterparty", "currency", "detail", "entity_id", "event_id", "fee_paise", "merchant_id", "method", "narration",
           "occurred_at", "recorded_at", "tax_paise", "tds_paise", "type", "utr", "value_date", "won")
_JSON = "{" + ", ".join(f"'{f}': {f}" for f in _FIELDS) + "}"
_add("f14_digests", f"SELECT merchant_id, event_id, sha256(CAST(to_json({_JSON}) AS VARCHAR)) AS digest FROM ev")
_add("u1_union_of_sources", "SELECT merchant_id, event_id, occurred_at FROM ev")
_add("u2_distinct_facts", "SELECT DISTINCT merchant_id, event_id FROM ev")
_add("u2_ingestion", "SELECT merchant_id, count(*) + count(*) FILTER (WHERE type IN ('payment_captured', 'settlement_executed')) AS delivered, "
     "count(*) AS recorded, count(*) FILTER (WHERE type IN ('payment_captured', 'settlement_executed')) AS skipped FROM ev GROUP BY ALL")
_add("u3_missing_facts", f"SELECT merchant_id, sha256(CAST(to_json({_JSON}) AS VARCHAR)) AS digest, 'left' AS only_in FROM ev WHERE type = 'bank_debit'")
_add("q4_refolded_balances", "SELECT merchant_id, account, balance_paise FROM (SELECT * FROM ((SELECT * FROM whole_bal EXCEPT ALL SELECT * FROM part_bal) UNION ALL (SELECT * FROM part_bal EXCEPT ALL SELECT * FROM whole_bal)))",
     whole_bal="SELECT merchant_id, account, CAST(sum(amount_paise) AS BIGINT) AS balance_paise FROM postings GROUP BY ALL",
     part_bal="SELECT merchant_id, account, CAST(sum(amount_paise) AS BIGINT) AS balance_paise FROM postings WHERE event_type <> 'bank_charge_applied' GROUP BY ALL")
_add("q7_repeated_facts", "SELECT merchant_id, count(*) AS facts, 2 * count(*) AS copies FROM ev WHERE type IN ('payment_captured', 'settlement_executed') GROUP BY ALL")
_add("w2_broken_links", "SELECT merchant_id, batch, CASE batch % 9 WHEN 4 THEN 'content was altered' ELSE 'does not follow its predecessor' END AS reason "
     "FROM (SELECT merchant_id, recorded_at, row_number() OVER (PARTITION BY merchant_id ORDER BY recorded_at) AS batch FROM (SELECT DISTINCT merchant_id, recorded_at FROM ev)) WHERE batch % 9 IN (4, 7)")
_add("w4_sequence", "SELECT merchant_id, min(seq) AS first, max(seq) AS last, count(*) AS rows, count(DISTINCT seq) AS different FROM ("
     "SELECT merchant_id, row_number() OVER (PARTITION BY merchant_id ORDER BY recorded_at, occurred_at, event_id) AS seq FROM ev) WHERE seq % 50 <> 17 "
     "GROUP BY merchant_id HAVING min(seq) <> 1 OR max(seq) <> count(*)")
_add("w5_sequence", "SELECT merchant_id, event_id, row_number() OVER (PARTITION BY merchant_id ORDER BY recorded_at, occurred_at, event_id) AS seq FROM ev")
_add("x12_pack_verify", "SELECT merchant_id, window_id, CASE window_id % 11 WHEN 3 THEN 'contents do not match the digest' WHEN 5 THEN 'lines do not match the digest' "
     "ELSE 'not reproducible' END AS reason FROM summary WHERE window_id % 11 IN (3, 5, 7)")
_add("w1_balance_check", "SELECT file, line, checked, broken FROM st_checked")
_add("w1_statement_report", "SELECT s.file, count(*) FILTER (WHERE NOT opening) AS rows, CAST(coalesce(sum(debit_paise), 0) AS BIGINT) AS debits_paise, "
     "CAST(coalesce(sum(credit_paise), 0) AS BIGINT) AS credits_paise, any_value(balances_seen) AS balances_seen, any_value(checked) AS checked, any_value(broken) AS broken, "
     "any_value(checked) > 0 AND any_value(broken) = 0 AS reconciles FROM st s JOIN (SELECT file, count(*) AS balances_seen, count(*) FILTER (WHERE checked) AS checked, "
     "count(*) FILTER (WHERE broken) AS broken FROM st_checked GROUP BY file) c ON c.file = s.file GROUP BY s.file")
_add("s8_statement_events", "SELECT split_part(file, '-', 1) AS merchant_id, CASE WHEN credit_paise <> 0 THEN 'stmt-cr-' ELSE 'stmt-dr-' END || ident AS event_id, "
     "CASE WHEN credit_paise <> 0 THEN 'bank_credit_received' WHEN regexp_matches(lower(narration), 'chrg|charge|chg|comm|amc|maint|sms alert|annual fee|service fee|penalty|gst on') "
     "THEN 'bank_charge_applied' ELSE 'bank_debit' END AS type, txn_date AS occurred_at, ident AS entity_id, CASE WHEN credit_paise <> 0 THEN credit_paise ELSE debit_paise END AS amount_paise, narration "
     "FROM (SELECT *, 'bank-' || strftime(txn_date, '%Y%m%d') || '-' || line AS ident FROM st WHERE NOT opening)")
_add("a11_supplier_credit", "SELECT merchant_id, supplier_gstin, count(*) AS invoices, CAST(sum(tax_paise) AS BIGINT) AS credit_paise FROM invoices GROUP BY ALL")
_add("a23_statement_totals", "SELECT file, CAST(sum(debit_paise) AS BIGINT) AS debits_paise, CAST(sum(credit_paise) AS BIGINT) AS credits_paise FROM st0 GROUP BY file")
_add("c23_gst_shortfall", "SELECT * FROM tax_gst")
_add("c24_malformed_gstins", "SELECT * FROM tax_bad")
_add("c25_tds_gap", "SELECT * FROM tax_tds")
_add("c26_tax_risks", "SELECT *, CAST(row_number() OVER (PARTITION BY merchant_id, window_id ORDER BY abs(amount_paise) DESC, kind) AS INT) AS position FROM ("
     "SELECT merchant_id, window_id, 'tds_194o' AS kind, amount_paise FROM tax_tds UNION ALL SELECT merchant_id, window_id, 'gst_input_credit', amount_paise FROM tax_gst "
     "UNION ALL SELECT merchant_id, window_id, 'malformed_gstin', amount_paise FROM tax_bad)")
_add("j12_paid_against_available", "SELECT merchant_id, CAST(sum(paid_paise) AS BIGINT) AS paid_paise, CAST(sum(shown_paise) AS BIGINT) AS shown_paise FROM tax_gst GROUP BY ALL")
_add("f4_apportion", "SELECT k, line, CAST(share + CASE WHEN turn <= total_paise - given THEN 1 ELSE 0 END AS BIGINT) AS share_paise FROM ("
     "SELECT *, sum(share) OVER (PARTITION BY k) AS given, row_number() OVER (PARTITION BY k ORDER BY rest DESC, line DESC) AS turn FROM ("
     "SELECT *, CAST(total_paise AS HUGEINT) * weight // every AS share, CAST(total_paise AS HUGEINT) * weight % every AS rest FROM ("
     "SELECT l_orderkey AS k, l_linenumber AS line, CAST(sum(CAST(l_quantity AS BIGINT)) AS HUGEINT) AS weight, sum(sum(CAST(l_quantity AS BIGINT))) OVER (PARTITION BY l_orderkey) AS every, "
     "any_value(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS total_paise FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber)))")
_add("f9_narration_styles", r"""SELECT c.merchant_id, CASE WHEN contains(narration, p.utr) THEN CASE WHEN regexp_matches(substr(narration, strpos(narration, p.utr) + length(p.utr), 1), '[0-9]') THEN 'noisy' ELSE 'clean' END
 WHEN contains(regexp_replace(upper(narration), '[^\p{L}\p{N}]', '', 'g'), p.utr) THEN 'cased'
 WHEN contains(regexp_replace(upper(narration), '[^\p{L}\p{N}]', '', 'g'), left(p.utr, 6)) THEN 'truncated' ELSE 'absent' END AS style, count(*) AS credits
 FROM ev c JOIN truth_links t ON t.merchant_id = c.merchant_id AND t.bank_txn_id = c.entity_id JOIN payouts p ON p.merchant_id = t.merchant_id AND p.settlement_id = t.settlement_id
 WHERE c.type = 'bank_credit_received' GROUP BY ALL""")
_add("x8_checked_figures", "SELECT merchant_id, window_id, paise, grounded, CASE WHEN NOT grounded THEN (SELECT arg_min(a, abs(a - abs(paise)) * 2 + CASE WHEN a > abs(paise) THEN 1 ELSE 0 END) FROM "
     "(SELECT p.merchant_id AS m, p.window_id AS w, abs(amount_paise) AS a FROM permitted p) q WHERE q.m = g.merchant_id AND q.w = g.window_id) END AS nearest_paise FROM grounded g")
_add("x8_grounding_rate", "SELECT merchant_id, window_id, count(*) AS figures, count(*) FILTER (WHERE grounded) AS grounded, round(avg(CAST(grounded AS INT)), 6) AS rate FROM grounded GROUP BY ALL")
_add("x18_permitted_figures", "SELECT * FROM permitted")

# --- forecasts, search -------------------------------------------------------------------------
_add("a12_weekday_shape", "SELECT * FROM weekdays")
_add("a12_rates", "SELECT * FROM rates")
_add("a24_overdue_and_written_off", "SELECT o.merchant_id, o.as_of, overdue_paise, written_off_paise FROM overdue o JOIN written_off w ON w.merchant_id = o.merchant_id AND w.as_of = o.as_of")
_add("x1_forecast_days", "SELECT * FROM fdays")
_add("x1_forecast_totals", "SELECT f.*, overdue_paise, written_off_paise FROM (SELECT merchant_id, as_of, CAST(sum(committed_paise) AS BIGINT) AS committed_paise, CAST(sum(projected_paise) AS BIGINT) AS projected_paise, "
     "CAST(sum(expected_paise) AS BIGINT) AS expected_paise FROM fdays GROUP BY ALL) f JOIN overdue o ON o.merchant_id = f.merchant_id AND o.as_of = f.as_of JOIN written_off w ON w.merchant_id = f.merchant_id AND w.as_of = f.as_of")
_add("w14_through", "SELECT merchant_id, as_of, day, CAST(sum(expected_paise) OVER (PARTITION BY merchant_id, as_of ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through_paise FROM fdays")
_add("x3_outcomes", "SELECT * FROM outcomes")
_add("a13_backtest", "SELECT merchant_id, count(*) AS windows, round(coalesce(avg(CASE WHEN actual_paise <> 0 THEN abs(error_paise) / abs(actual_paise) END), 0), 6) AS mape, "
     "CAST(sum(error_paise) AS BIGINT) AS bias_paise, round(CASE WHEN sum(actual_paise) <> 0 THEN -sum(error_paise) / sum(actual_paise) ELSE 0 END, 6) AS optimism, "
     "count(*) FILTER (WHERE error_paise < 0) AS days_short FROM outcomes GROUP BY ALL")
_add("k4_worst_windows", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY abs(error_paise) DESC, as_of) AS INT) AS place FROM outcomes) WHERE place <= 3")
_add("w7_split_floors", "SELECT *, actual_paise >= floor_paise AS held FROM floors")
_COV = ("SELECT merchant_id, count(*) FILTER (WHERE actual_paise >= floor_paise) AS held, count(*) FILTER (WHERE actual_paise < floor_paise) AS breached, "
        "CAST(sum(floor_paise) AS BIGINT) AS floor_paise, CAST(sum(actual_paise) AS BIGINT) AS actual_paise FROM floors WHERE certified GROUP BY ALL")
_add("a14_coverage", f"SELECT *, held + breached AS independent, round(held / (held + breached), 6) AS empirical, round(CASE WHEN actual_paise = 0 THEN 0 ELSE floor_paise / actual_paise END, 6) AS tightness, "
     f"held / (held + breached) >= 0.9 AS meets_target, 'split' AS method FROM ({_COV})")
_add("x4_slices", "SELECT * FROM slices")
_add("x6_hold_out", "SELECT * FROM hold")
_add("x6_rediscover", "SELECT * FROM swept")
_add("x5_blame_largest", "SELECT c.merchant_id, c.window_id, c.cause, l.account, l.amount_paise AS claim_paise, l.amount_paise = any_value(c.remainder_paise) AND bool_and("
     "v.claimed_paise - CASE WHEN h.account = v.account THEN c.amount_paise ELSE 0 END + CASE WHEN l.account = v.account THEN l.amount_paise ELSE 0 END = v.actual_paise) AS accepted "
     "FROM cases c JOIN largest l ON l.merchant_id = c.merchant_id AND l.window_id = c.window_id JOIN claim_of h ON h.cause = c.cause "
     "JOIN coverage v ON v.merchant_id = c.merchant_id AND v.window_id = c.window_id GROUP BY c.merchant_id, c.window_id, c.cause, l.account, l.amount_paise")
_ALARMING = "('fee_rate_increase', 'chargeback_lost', 'gateway_adjustment', 'risk_hold', 'settlement_never_arrived')"
_add("x7_second_opinion", f"SELECT * EXCLUDE (rn) FROM (SELECT *, cause IN {_ALARMING} AS alarming, row_number() OVER (PARTITION BY merchant_id, window_id "
     f"ORDER BY cause IN {_ALARMING} DESC, abs(amount_paise) DESC, cause) AS rn FROM swept) WHERE rn = 1")
_add("x17_drill_down", "SELECT p.merchant_id, window_id, event_id, account, amount_paise, ref FROM postings p JOIN windows w ON w.merchant_id = p.merchant_id "
     "AND occurred_at BETWEEN window_start AND window_end WHERE account = 'chargeback_loss'")

# --- whole period, recurrences, sources, streams ----------------------------------------------
_WHOLE = ("SELECT merchant_id, 0 AS window_id, min(occurred_at) AS window_start, max(occurred_at) AS window_end FROM ev GROUP BY merchant_id")
_add("a17_sizing", "SELECT count(*) AS merchants, CAST(sum(gross_paise) // count(*) AS BIGINT) AS avg_captured_paise, "
     "CAST(sum(coalesce(recoverable_paise, 0)) // count(*) AS BIGINT) AS avg_recoverable_paise, CAST(sum(greatest(coalesce(chase_paise, 0), 0)) // count(*) AS BIGINT) AS avg_chase_paise, "
     "CAST(sum(greatest(coalesce(tax_paise, 0), 0)) // count(*) AS BIGINT) AS avg_tax_paise, round(sum(coalesce(recoverable_paise, 0)) / sum(gross_paise), 4) AS recoverable_share "
     "FROM variance v LEFT JOIN buckets b ON b.merchant_id = v.merchant_id", windows=_WHOLE)
_add("a20_quarter", "SELECT s.merchant_id, window_start, window_end, gross_paise, landed_paise, gap_paise, remainder_paise, chase_paise, tax_paise, timing_paise, cost_paise, lost_paise, "
     "recoverable_paise, weeks, hike_started, since_paise, per_year_paise FROM summary s LEFT JOIN buckets b ON b.merchant_id = s.merchant_id "
     "JOIN (SELECT merchant_id, count(*) AS weeks FROM wk GROUP BY ALL) k ON k.merchant_id = s.merchant_id LEFT JOIN hiked h ON h.merchant_id = s.merchant_id",
     windows=_WHOLE, wk=CTES["windows"],
     over="SELECT k.merchant_id, k.window_id, window_start, window_end, sum(fee_paise - contract_paise) AS o FROM wk k JOIN priced p ON p.merchant_id = k.merchant_id "
          "AND occurred_at BETWEEN window_start AND window_end GROUP BY ALL",
     hiked="SELECT merchant_id, hike_started, since_paise, CAST(round_even(CAST(since_paise AS DECIMAL(20,0)) * 365 / greatest(CAST(last_day - hike_started AS INT) + 1, 1), 0) AS BIGINT) AS per_year_paise "
           "FROM (SELECT w.merchant_id, hike_started, last_day, CAST(sum(o) AS BIGINT) AS since_paise FROM over w JOIN (SELECT o.merchant_id, min(o.window_start) FILTER (WHERE o > 0) AS hike_started, "
           "any_value(hi) AS last_day FROM over o JOIN (SELECT merchant_id, max(window_end) AS hi FROM wk GROUP BY ALL) z ON z.merchant_id = o.merchant_id GROUP BY ALL) h "
           "ON h.merchant_id = w.merchant_id WHERE w.window_start >= hike_started GROUP BY ALL)")
_X2 = f"""
SELECT o.merchant_id, o.as_of, coalesce(l.g, 0) AS g, coalesce(l.oc, 0) AS oc, coalesce(h.net, 0) AS held, coalesce(e.rf, 0) AS rf, coalesce(e.dp, 0) AS dp,
       coalesce(e.rel, 0) AS rel, r.deductions, r.gross
FROM origins o JOIN rates r ON r.merchant_id = o.merchant_id AND r.as_of = o.as_of
LEFT JOIN (SELECT o.merchant_id, o.as_of, CAST(sum(amount_paise) AS BIGINT) AS g, CAST(sum(fee_paise - contract_paise) AS BIGINT) AS oc FROM origins o JOIN priced p ON p.merchant_id = o.merchant_id
           JOIN calendar c ON c.d = p.occurred_at WHERE t2_actual BETWEEN o.as_of + 1 AND o.as_of + 14 GROUP BY ALL) l ON l.merchant_id = o.merchant_id AND l.as_of = o.as_of
LEFT JOIN (SELECT o.merchant_id, o.as_of, CAST(sum(amount_paise - fee_paise - tax_paise - tds_paise) AS BIGINT) AS net FROM origins o JOIN priced p ON p.merchant_id = o.merchant_id
           JOIN calendar c ON c.d = p.occurred_at WHERE t2_naive BETWEEN o.as_of + 1 AND o.as_of + 14 AND t2_actual > o.as_of + 14 GROUP BY ALL) h ON h.merchant_id = o.merchant_id AND h.as_of = o.as_of
LEFT JOIN (SELECT o.merchant_id, o.as_of, CAST(sum(amount_paise) FILTER (WHERE type = 'refund_issued') AS BIGINT) AS rf, CAST(sum(amount_paise) FILTER (WHERE type = 'dispute_opened') AS BIGINT) AS dp,
           CAST(coalesce(sum(amount_paise) FILTER (WHERE type = 'risk_hold_released'), 0) - coalesce(sum(amount_paise) FILTER (WHERE type = 'risk_hold_applied'), 0) AS BIGINT) AS rel
           FROM origins o JOIN ev e ON e.merchant_id = o.merchant_id AND e.occurred_at BETWEEN o.as_of + 1 AND o.as_of + 14 GROUP BY ALL) e ON e.merchant_id = o.merchant_id AND e.as_of = o.as_of"""
_SEEN = "(rf + dp)"
_add("x2_error_causes", f"""
SELECT merchant_id, as_of, cause, CAST(amount AS BIGINT) AS amount_paise FROM (
 SELECT merchant_id, as_of, 'fee_rate_increase' AS cause, -oc AS amount FROM xerr UNION ALL SELECT merchant_id, as_of, 'bank_holiday_delay', -held FROM xerr
 UNION ALL SELECT merchant_id, as_of, 'risk_hold', rel FROM xerr
 UNION ALL SELECT merchant_id, as_of, 'refunds_issued', -sg * (share_r + CASE WHEN rest_r > rest_d AND spare > 0 OR rf > 0 AND dp = 0 THEN spare ELSE 0 END) FROM split WHERE rf <> 0
 UNION ALL SELECT merchant_id, as_of, 'dispute_reserve_held', -sg * (share_d + CASE WHEN rest_r > rest_d AND rf > 0 THEN 0 ELSE spare END) FROM split WHERE dp <> 0) WHERE amount <> 0""",
     xerr=_X2,
     split=f"""SELECT *, m - share_r - share_d AS spare FROM (SELECT *, CAST(m AS HUGEINT) * rf // {_SEEN} AS share_r, CAST(m AS HUGEINT) * dp // {_SEEN} AS share_d,
               CAST(m AS HUGEINT) * rf % {_SEEN} AS rest_r, CAST(m AS HUGEINT) * dp % {_SEEN} AS rest_d FROM (
               SELECT *, abs(su) AS m, sign(su) AS sg FROM (SELECT *, rf + dp - CASE WHEN gross = 0 THEN 0 ELSE (2 * CAST(g AS HUGEINT) * deductions + gross) // (2 * gross) END AS su FROM xerr)
               WHERE su <> 0 AND rf + dp <> 0))""")
_CLIP = "least(greatest({0}, 0.0001), 0.999)"


def _q(scores: str, level: str) -> str:
    n = f"len({scores})"
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE list_sort({scores})[CAST(least(ceil(({n} + 1) * (1 - {_CLIP.format(level)})), {n}) AS INT)] END)"


_add("w8_adaptive_floors", f"""
SELECT merchant_id, as_of, forecast_paise, actual_paise, n AS calibrated_on, floor_paise, n >= 9 AS certified, actual_paise >= floor_paise AS held, round(level, 9) AS level,
       round({_q("scores", "level")}, 9) AS discount, n + 1 >= 12 AND ({_q("scores", "level")} > 0.25 OR list_sum(recent) / len(recent) > 0.2) AS in_distress
FROM (WITH RECURSIVE walk AS (
  SELECT merchant_id, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS scores, CAST(0.1 AS DOUBLE) AS level, CAST([] AS INT[]) AS recent, CAST(NULL AS DATE) AS as_of,
         CAST(0 AS BIGINT) AS forecast_paise, CAST(0 AS BIGINT) AS actual_paise, CAST(0 AS INT) AS n, CAST(0 AS BIGINT) AS floor_paise FROM (SELECT DISTINCT merchant_id FROM steps)
  UNION ALL
  SELECT merchant_id, i, list_append(scores, CASE WHEN forecast_paise <= 0 THEN 0.0 ELSE CAST(forecast_paise - actual_paise AS DOUBLE) / CAST(forecast_paise AS DOUBLE) END),
         least(greatest(level + CAST(0.02 AS DOUBLE) * (CAST(0.1 AS DOUBLE) - CASE WHEN actual_paise < floor_paise THEN 1 ELSE 0 END), 0.0001), 0.999),
         list_append(recent, CASE WHEN actual_paise < floor_paise THEN 1 ELSE 0 END)[-12:], as_of, forecast_paise, actual_paise, CAST(len(scores) AS INT), floor_paise
  FROM (SELECT w.merchant_id, s.i, w.scores, w.level, w.recent, s.as_of, s.forecast_paise, s.actual_paise,
               greatest(0, CAST(trunc(s.forecast_paise * (1 - {_q("w.scores", "w.level")})) AS BIGINT)) AS floor_paise
        FROM walk w JOIN steps s ON s.merchant_id = w.merchant_id AND s.i = w.i + 1)) SELECT * FROM walk) WHERE i > 0""",
     steps="SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY as_of) AS i FROM outcomes WHERE forecast_paise <> 0")


def _chain(delivery: str) -> dict[str, str]:
    """Batches of a log that was recorded in the given deliveries."""
    return {
        "numbered": f"""SELECT merchant_id, delivery, recorded_at, digest, row_number() OVER (PARTITION BY merchant_id ORDER BY delivery, recorded_at, occurred_at, event_id) AS seq
         FROM (SELECT merchant_id, recorded_at, occurred_at, event_id, CAST({delivery} AS BIGINT) AS delivery, sha256(CAST(to_json({_JSON}) AS VARCHAR)) AS digest FROM ev)""",
        "batches": """SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY delivery, recorded_at) AS batch FROM (
         SELECT merchant_id, delivery, recorded_at, sha256(string_agg(part, '' ORDER BY head)) AS root, CAST(sum(n) AS BIGINT) AS facts FROM (
           SELECT merchant_id, delivery, recorded_at, left(leaf, 4) AS head, sha256(string_agg(leaf, '' ORDER BY leaf)) AS part, count(*) AS n
           FROM (SELECT merchant_id, delivery, recorded_at, sha256(seq || ':' || digest) AS leaf FROM numbered) GROUP BY ALL) GROUP BY ALL)""",
    }


_CHAIN = """
SELECT merchant_id, recorded_at, delivery, batch, facts, root, prev_hash, hash FROM (WITH RECURSIVE walk AS (
  SELECT merchant_id, recorded_at, delivery, batch, facts, root, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || root) AS hash FROM batches WHERE batch = 1
  UNION ALL SELECT d.merchant_id, d.recorded_at, d.delivery, d.batch, d.facts, d.root, w.hash, sha256(w.hash || d.root)
  FROM walk w JOIN batches d ON d.merchant_id = w.merchant_id AND d.batch = w.batch + 1) SELECT * FROM walk)"""
_add("w3_chain", _CHAIN, **_chain("1"))
_add("s13_log_roundtrip", _CHAIN, **_chain("CASE WHEN recorded_at > DATE '1998-06-30' THEN 3 "
     "WHEN type IN ('bank_credit_received', 'bank_charge_applied', 'bank_debit') THEN 2 ELSE 1 END"))

_ITEMS = "('payment_captured', 'refund_issued', 'route_transfer', 'gateway_adjustment')"
_NETS = f"""SELECT merchant_id, 'rs_' || strftime(occurred_at, '%Y%m') AS settlement_id, strftime(occurred_at, '%Y%m') || merchant_id AS utr, max(last_day(occurred_at)) AS settled_on,
  CAST(sum(CASE WHEN type = 'payment_captured' THEN amount_paise - fee_paise - tax_paise ELSE -amount_paise END) AS BIGINT) AS net FROM ev WHERE type IN {_ITEMS} GROUP BY ALL"""
_add("s1_report_events", f"""
SELECT merchant_id, CASE type WHEN 'payment_captured' THEN 'cap-' WHEN 'refund_issued' THEN 'ref-' WHEN 'route_transfer' THEN 'trf-' ELSE 'adj-' END || entity_id AS event_id, type, occurred_at,
  DATE '2002-01-01' AS recorded_at, entity_id, counterparty, amount_paise, fee_paise, tax_paise, CAST(NULL AS VARCHAR) AS utr,
  CASE WHEN type = 'payment_captured' THEN NULL WHEN type = 'refund_issued' THEN 'normal' ELSE detail END AS detail FROM ev WHERE type IN {_ITEMS}
UNION ALL SELECT merchant_id, 'setl-' || settlement_id, 'settlement_executed', settled_on, DATE '2002-01-01', settlement_id, NULL, net, 0, NULL, utr, NULL FROM nets WHERE net > 0""", nets=_NETS)
_add("s1_report_covers", f"SELECT e.merchant_id, n.settlement_id, e.entity_id AS payment_id FROM ev e JOIN nets n ON n.merchant_id = e.merchant_id AND n.settlement_id = 'rs_' || strftime(occurred_at, '%Y%m') "
     f"WHERE e.type IN {_ITEMS} AND net > 0", nets=_NETS)
_add("s2_payment_events", "SELECT merchant_id, entity_id AS event_id, type, occurred_at, occurred_at AS recorded_at, entity_id, counterparty, amount_paise, fee_paise, tax_paise, "
     "CAST(NULL AS VARCHAR) AS utr, CAST(NULL AS VARCHAR) AS detail FROM ev WHERE type = 'payment_captured'")
_add("s3_refund_events", "SELECT merchant_id, entity_id AS event_id, type, occurred_at, occurred_at AS recorded_at, entity_id, counterparty, amount_paise, CAST(NULL AS BIGINT) AS fee_paise, "
     "CAST(NULL AS BIGINT) AS tax_paise, CAST(NULL AS VARCHAR) AS utr, detail FROM ev WHERE type = 'refund_issued' AND amount_paise % 10 <> 3")
_add("p6_report_rejects", f"SELECT merchant_id, entity_id, CASE WHEN amount_paise % 100 = 7 THEN 'foreign currency USD' ELSE 'unmapped row type mystery' END AS reason FROM ev WHERE type IN {_ITEMS} AND amount_paise % 100 IN (7, 9)")
_add("p7_lenient_report", f"SELECT merchant_id, type, count(*) AS events, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM ev WHERE type IN {_ITEMS} AND amount_paise % 100 <> 7 GROUP BY ALL")

_FACTS = """SELECT 'u' || (user_id % 7) AS merchant_id, CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS DATE) AS d, gross,
  CASE event_type WHEN 'purchase' THEN 'payment_captured' WHEN 'click' THEN 'refund_issued' WHEN 'error' THEN 'payment_failed' ELSE 'order_placed' END AS type, fee, CAST(round(CAST(fee AS DECIMAL(20,0)) * 18 / 100, 0) AS BIGINT) AS tax
FROM (SELECT *, CAST(round(CAST(gross AS DECIMAL(20,0)) * 2 / 100, 0) AS BIGINT) AS fee FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS gross FROM events))"""
_STREAMED = ("SELECT merchant_id, d, unnest(['gateway_receivable', 'fee_expense', 'gst_input_credit', 'tds_receivable', 'revenue']) AS account, "
             "unnest([abs(gross - fee - tax), abs(fee), abs(tax), 0, -abs(gross)]) AS amount FROM sfacts WHERE type = 'payment_captured' "
             "UNION ALL SELECT merchant_id, d, unnest(['refunds', 'gateway_receivable']), unnest([abs(gross), -abs(gross)]) FROM sfacts WHERE type = 'refund_issued'")
_add("t1_distinct_within", "SELECT merchant_id, event_id, type, gross AS amount_paise FROM sfacts", sfacts=_FACTS)
_add("t1_streamed_log", "SELECT merchant_id, event_id, type, gross AS amount_paise, CAST(1 AS BIGINT) AS delivery, "
     "row_number() OVER (PARTITION BY merchant_id ORDER BY d, event_id) AS seq FROM sfacts", sfacts=_FACTS)
_add("t4_running_balances", "SELECT merchant_id, account, CAST(sum(amount) AS BIGINT) AS balance_paise FROM streamed GROUP BY ALL", sfacts=_FACTS, streamed=_STREAMED)
_add("t3_weekly_movements", "SELECT merchant_id, CAST(DATE '1970-01-01' + CAST(7 * (CAST(d - DATE '1970-01-01' AS INT) // 7) AS INT) AS DATE) AS week_start, account, CAST(sum(amount) AS BIGINT) AS amount_paise "
     "FROM streamed WHERE account <> 'revenue' GROUP BY ALL", sfacts=_FACTS, streamed=_STREAMED)
