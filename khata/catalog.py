"""Every operator as a query over the sample tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions import dates, money, text
from khata.lineage import checkpoint_folder, cut, kept, passage
from khata.operators import apportion, audits, fees, linkage, log, movements, payouts, select
from khata.operators.calendar import add_bank_days
from khata.operators.movements import WINDOW
from khata.operators.postings import daily_sums
from khata.operators.ranking import parts_for
from khata.plans import (
    causes, close, conformal, forecast, grounding, insights, named, pack, restate, scoring, search, tax,
)
from khata.plans.sample_ledger import GATEWAY_GSTIN, SampleLedger, busy_days, order_facts, sample_ledger
from khata.plans.sample_stream import fact_stream
from khata.sources import gateway, log_store, statement
from khata.streaming import jobs
from khata.streaming.run import run_to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register a function of the sample ledger under ``name``."""

    def keep(build: Callable[[SampleLedger], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(sample_ledger(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        return build

    return keep


def _table(ledger: SampleLedger, name: str) -> DataFrame:
    return ledger.spark.read.parquet(f"{ledger.folder}/{name}.parquet")


# --- tables, projections, predicates -------------------------------------------------

query("s12_events")(lambda s: s.events)
query("s12_covers")(lambda s: s.covers.drop("recorded_at"))
query("s12_calendar")(lambda s: s.calendar)
query("p1_postings")(lambda s: s.postings)
query("p3_as_of")(lambda s: movements.balances(movements.daily_movements(movements.known(
    s.postings, F.lit("1998-06-30").cast("date"), F.lit("1998-06-30").cast("date")))))
query("p4_known_by_window")(lambda s: restate.signed(s.books).moves.select(*WINDOW, "account", "event_type", "amount_paise"))
query("p5_w11_windows")(lambda s: s.books.windows)


@query("p2_selectors")
def _(s):
    parts = [
        select.select(s.events, what).select(
            F.lit(what).alias("selector"), "merchant_id", "entity_id", "occurred_at", "amount_paise")
        for what in [*select.KINDS, "bank_outflows"]
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("p8_refund_gate")
def _(s):
    """Captures reported as refunded (every ninth key) without a refund row, by the gate of the payments export."""
    caught = s.events.filter("type = 'payment_captured'")
    returned = F.substring("entity_id", 5, 20).cast("bigint") % 9 == 0
    items = caught.select(
        "merchant_id", F.col("entity_id").alias("id"), F.when(returned, "refunded").otherwise("captured").alias("status"), "method", "currency",
        (F.col("fee_paise") + F.col("tax_paise")).alias("fee"), F.col("tax_paise").alias("tax"), F.when(returned, F.col("amount_paise")).otherwise(0).alias("amount_refunded"))
    refunds = select.select(s.events, "refunds").select("merchant_id", F.col("counterparty").alias("payment_id"), F.lit("processed").alias("status"))
    return gateway.payment_rejects(items, refunds).select("merchant_id", F.col("id").alias("payment_id"))


query("p11_bank_charges")(lambda s: s.events.filter("narration IS NOT NULL").select(
    "merchant_id", "entity_id", text.is_bank_charge(F.col("narration")).alias("charge")))


@query("p12_instruction_shapes")
def _(s):
    def flagged(table, key, body, name):
        rows = _table(s, table).select(F.lit(table).alias("source"), key.alias("id"), F.col(body))
        return text.flag_instructions(rows, body, name).drop(body)

    return (
        flagged("documents", F.col("doc_id"), "text", "flagged")
        .unionByName(flagged("conversations", F.col("conv_id") * 100000 + F.col("turn"), "text", "flagged"))
        .unionByName(flagged("pages", F.col("page_id"), "html", "flagged"))
    )


query("p13_gateway_credits")(lambda s: select.select(s.events, "credits")
    .filter(text.names_gateway(F.col("narration"), "Gateway")).groupBy("merchant_id")
    .agg(F.count("*").alias("credits"), F.sum("amount_paise").alias("amount_paise")))

# --- joins ----------------------------------------------------------------------------

query("j1_links")(lambda s: s.books.links.select("merchant_id", "bank_txn_id", "settlement_id", "rule", "candidates"))
query("j1_tiers")(lambda s: s.books.links.groupBy("merchant_id", "rule").agg(
    F.count("*").alias("credits"), F.count("settlement_id").alias("linked")))


@query("j1_busy_days")
def _(s):
    with passage(s.spark, "busy-days"):
        # credits and payouts are made of the same few columns
        facts = cut(order_facts(s.spark, s.folder).select("k", "merchant_id", "gross"), "order-facts")
        links = linkage.link_credits(*busy_days(facts)).filter("settlement_id IS NOT NULL")
        return kept(links.select("merchant_id", "bank_txn_id", "settlement_id"), "linked")


query("j1a_candidates")(lambda s: linkage.candidate_pairs(s.books.credits, s.books.payouts, ["merchant_id"])
    .filter("in_reach > 0"))
query("j1e_open_credits")(lambda s: s.books.links.filter("rule = 'abstain_ambiguous'").select(
    "merchant_id", "bank_txn_id", "rule", "reason"))
query("j1f_greedy")(lambda s: linkage.link_credits(s.books.credits, s.books.payouts, greedy=True).select(
    "merchant_id", "bank_txn_id", "settlement_id", "rule"))
query("j2_naive_missing")(lambda s: linkage.payouts_without_reference(s.books.credits, s.books.payouts).select(
    "merchant_id", "settlement_id"))
query("j3_unlinked_payouts")(lambda s: linkage.payouts_not_linked(s.books.payouts, s.books.links).select(
    "merchant_id", "settlement_id", "utr", "occurred_at", "amount_paise"))
query("j4_missing_payouts")(lambda s: causes.missing_payouts(s.books).select(
    "merchant_id", "settlement_id", "utr", "occurred_at", "amount_paise"))


@query("j5_slipped_receivable")
def _(s):
    days = s.calendar.filter("slipped_days > 0").select(F.col("d").alias("occurred_at"), "t2_actual", "slipped_days")
    due = s.books.daily.filter("account = 'gateway_receivable' AND event_type = 'payment_captured'")
    return due.join(F.broadcast(days), "occurred_at").groupBy(
        "merchant_id", "occurred_at", "t2_actual", "slipped_days").agg(F.sum("amount_paise").alias("amount_paise"))


@query("j6_splits_of_delayed")
def _(s):
    slipped = causes._slipped_windows(s.books).select("merchant_id", "window_id", F.col("d").alias("occurred_at"))
    taken = fees.captures(s.events).select("merchant_id", "payment_id", "occurred_at")
    delayed = taken.join(slipped, ["merchant_id", "occurred_at"])
    split = select.select(s.events, "transfers").select(
        "merchant_id", F.col("counterparty").alias("payment_id"), F.col("event_id").alias("split_id"), "amount_paise")
    return split.join(delayed, ["merchant_id", "payment_id"]).select(
        "merchant_id", "window_id", "split_id", "amount_paise").distinct()


query("j7_exceptions")(lambda s: close.exceptions(s.books).drop("reason"))
query("j8_priced_captures")(lambda s: s.books.priced.select(
    "merchant_id", "payment_id", "method", "amount_paise", "fee_paise", "contract_paise"))
query("j9_unsettled")(lambda s: payouts.unsettled(fees.captures(s.events), s.covers).select(
    "merchant_id", "payment_id", "occurred_at", "amount_paise"))
query("j10_restated_causes")(lambda s: restate.movements(s.books))
query("j11_scored")(lambda s: scoring.score_windows(
    close.findings(s.books), scoring.truth_by_window(s.truth, s.timing, s.books.windows)))
query("j13_coverage")(lambda s: close.coverage(s.books))

# --- aggregations ---------------------------------------------------------------------

query("a1_balances")(lambda s: movements.balances(s.books.daily))
query("a2_balance_delta")(lambda s: movements.balance_delta(
    movements.balances(s.books.daily),
    movements.balances(movements.known(s.books.daily, F.lit("1998-06-30").cast("date")))))
query("a3_cash_position")(lambda s: movements.cash_position(s.books.daily))
query("a4_variance_weekly")(lambda s: movements.variance(s.books.moves, s.books.windows))
query("a4_movements")(lambda s: movements.account_movements(s.books.moves))
query("a5_movement_slices")(lambda s: movements.movement_slices(s.books.moves))
query("a6_types_touching")(lambda s: s.books.daily.groupBy("merchant_id", "account", "event_type").agg(
    F.sum("amount_paise").alias("amount_paise"), F.sum("n").alias("n")))
query("a7_evidence_refs")(lambda s: causes.evidence_refs(s.books))
query("a7_shown_refs")(lambda s: causes.shown_refs(s.books))
query("a8_fees_by_method")(lambda s: causes.window_fees(s.books).filter("fee_paise <> contract_paise").select(
    *WINDOW, "method", "captures", "gross_paise", "fee_paise", "contract_paise",
    (F.col("fee_paise") - F.col("contract_paise")).alias("excess_paise")))


@query("a9_payout_rebuild")
def _(s):
    """The report a gateway would send for what is due each bank day, rebuilt into payouts."""
    days = s.calendar.select(F.col("d").alias("occurred_at"), "t2_actual")
    due = movements.known(s.postings, F.lit("9999-12-31").cast("date")).filter(
        "account = 'gateway_receivable' AND event_type <> 'settlement_executed'")
    stamp = F.date_format("t2_actual", "yyyyMMdd")
    rows = due.join(F.broadcast(days), "occurred_at").select(
        "merchant_id", F.concat(F.lit("rep_"), stamp).alias("settlement_id"), F.col("event_id").alias("entity_id"),
        F.greatest("amount_paise", F.lit(0)).alias("credit"), F.greatest(-F.col("amount_paise"), F.lit(0)).alias("debit"),
        F.concat(stamp, "merchant_id").alias("settlement_utr"), F.unix_seconds(F.col("t2_actual").cast("timestamp")).alias("settled_at"),
        F.col("event_id").alias("position"),
    )
    return payouts.rebuild(rows).drop("settled_at")


@query("a10_missing_utrs")
def _(s):
    return causes.never_arrived_payouts(s.books).groupBy(*WINDOW).agg(
        F.expr("listagg(utr, ',') WITHIN GROUP (ORDER BY utr)").alias("utrs"), F.sum("amount_paise").alias("amount_paise"))


query("a16_evaluation")(lambda s: scoring.score_run(s.books, s.truth, s.timing))
query("a16_blind_spots")(lambda s: scoring.blind_spots(scoring.score_windows(
    close.findings(s.books), scoring.truth_by_window(s.truth, s.timing, s.books.windows))))
query("a17_sizing")(lambda s: insights.sizing(s.whole))
query("a18_merchant_profile")(lambda s: fees.merchant_profile(s.events))
query("a19_insights")(lambda s: insights.bucket_totals(close.findings(s.books)))
query("a20_weeks")(lambda s: insights.weeks(s.books))
query("a20_overcharge_start")(lambda s: insights.overcharge_start(insights.weeks(s.books)))
query("a20_quarter")(lambda s: insights.quarter(s.books, s.whole))
query("a21_close_summary")(lambda s: close.flagship(s.books))
query("a22_slices")(lambda s: s.books.daily.select("merchant_id", "account", "event_type").distinct())
query("a25_events_by_type")(lambda s: s.events.groupBy("merchant_id", "type").agg(
    F.count("*").alias("events"), F.max(F.datediff("recorded_at", "occurred_at")).alias("longest_lag")))

# --- causes and closes ------------------------------------------------------------------


def _cause(name: str):
    source = {
        "normal_fee": causes.fee_causes, "fee_rate_increase": causes.fee_causes,
        "bank_holiday_delay": causes.holiday_delay, "settlement_never_arrived": causes.never_arrived,
    }.get(name, causes.slice_causes)
    return lambda s: source(s.books).filter((F.col("cause") == name) & (F.col("amount_paise") != 0)).select(
        *WINDOW, "amount_paise")


for _c in causes.CAUSES:
    query(f"cause_{_c.name}")(_cause(_c.name))
query("c18_findings")(lambda s: close.findings(s.books).drop("title"))
query("c21_restatement")(lambda s: restate.restatement(s.books))
query("c27_actions")(lambda s: insights.actions(close.findings(s.books), s.books.windows))

# --- named queries ------------------------------------------------------------------------


def _named(question: str):
    def run(s):
        named.register_views(s.spark, s.books, s.covers)
        return named.ask(s.spark, question)

    return run


for _i, _question in enumerate(named.NAMED, start=1):
    query(f"n{_i}_{_question}")(_named(_question))


@query("n10_view_query")
def _(s):
    named.register_views(s.spark, s.books, s.covers)
    return s.spark.sql(
        "SELECT account, event_type, count(*) AS n, sum(amount_paise) AS amount_paise FROM postings GROUP BY account, event_type")


# --- audits ---------------------------------------------------------------------------------

query("q1_unbalanced_entries")(lambda s: audits.unbalanced_entries(s.postings))
query("q2_currency_totals")(lambda s: audits.currency_totals(s.postings, s.events))
query("q3_wrong_side")(lambda s: audits.wrong_side(movements.balances(s.books.daily)))
query("q5_identity")(lambda s: audits.not_identical(s.books.daily, s.books.windows))
query("q6_unclaimed")(lambda s: audits.unclaimed(close.coverage(s.books)))
# some refunds lose one leg: exactly these entries are off, and exactly their windows leave a remainder
_LOST = "account = 'refunds' AND amount_paise % 7 = 3"
query("q1_lost_legs")(lambda s: audits.unbalanced_entries(s.postings.filter(f"NOT ({_LOST})")))
query("q5_lost_legs")(lambda s: audits.not_identical(
    movements.daily_movements(s.postings.filter(f"NOT ({_LOST})")), s.books.windows).select(*WINDOW, "remainder_paise"))
query("q8_linkage_work")(lambda s: audits.linkage_work(s.books.credits, s.books.payouts))

# --- order, sets, composite jobs --------------------------------------------------------------

query("k2_ranked_findings")(lambda s: close.findings(s.books).select(*WINDOW, "cause", "position"))


@query("k3_largest_account")
def _(s):
    sums = s.books.moves.filter("account <> 'bank'").groupBy(*WINDOW, "account").agg(F.sum("amount_paise").alias("amount_paise"))
    # ties go to the account that comes first by name; at most thirteen rows per window
    biggest = Window.partitionBy(*WINDOW).orderBy(F.abs("amount_paise").desc(), "account")
    return sums.withColumn("_at", F.row_number().over(biggest)).filter("_at = 1").drop("_at")


@query("u4_accounts_touched")
def _(s):
    claimed = causes.refined(s.books.measured).select(
        *WINDOW, causes.lookup(F.col("cause"), "account").alias("account"))
    moved = movements.account_movements(s.books.moves).select(*WINDOW, "account")
    return claimed.union(moved).distinct()


query("x9_score_run")(lambda s: scoring.score_run(s.books, s.truth, s.timing))
query("x10_truth_by_window")(lambda s: scoring.truth_by_window(s.truth, s.timing, s.books.windows))
query("x11_linkage_against_naive")(lambda s: scoring.linkage_against_naive(s.books))
query("x11_greedy_against_careful")(lambda s: scoring.greedy_against_careful(s.books, s.truth_links))
query("x13_closed_weeks")(lambda s: scoring.closed_weeks(s.books))
query("x15_fee_audit")(lambda s: fees.fee_audit(s.books.priced))
query("x20_evidence_grid")(lambda s: causes.all_evidence(s.books, causes.refined(s.books.measured)).drop("title"))

query("x17_findings_rows")(lambda s: close.drill_down(s.books, close.findings(s.books)))


@query("x13_weekly_check")
def _(s):
    """One merchant's log has an amount changed on every seventeenth fact; that merchant's check must fail, and no other."""
    links = s.chain
    touched = (F.col("merchant_id") == "m2") & (F.col("seq") % 17 == 5)
    facts = s.log.withColumn("digest", F.when(touched, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return scoring.weekly_check(s.books, facts, links)


# --- spellings of amounts, dates and headers, written from the orders and read back ---------------


def _rupees(s: SampleLedger) -> tuple[DataFrame, Column]:
    """Orders, and their amount in rupees with Indian grouping."""
    whole = F.call_function("div", F.col("gross"), F.lit(100))
    return s.facts, F.concat(money.indian_grouping(whole), F.lit("."), F.lpad((F.col("gross") % 100).cast("string"), 2, "0"))


@query("f5_amounts")
def _(s):
    orders, text = _rupees(s)
    spelled = F.element_at(F.array(
        text, F.concat(text, F.lit(" Cr")), F.concat(text, F.lit("DR ")), F.concat(F.lit("("), text, F.lit(")")),
        F.concat(F.lit(" INR "), text), F.concat(F.lit("-"), text), F.concat(F.lit("₹"), text), F.lit("N/A"), F.lit("see note")), (F.col("k") % 9 + 1).cast("int"))
    return orders.select(F.col("k"), money.signed_paise(spelled).alias("paise"))


@query("f21_return_amounts")
def _(s):
    orders, text = _rupees(s)
    spelled = F.element_at(F.array(text, F.concat(F.lit("₹"), text), F.lit("-"), F.lit(""), F.lit("nil")), (F.col("k") % 5 + 1).cast("int"))
    return orders.select("k", money.paise_or_zero(spelled).alias("paise"))


@query("f6_dates")
def _(s):
    layouts = ("dd/MM/yyyy", "d/M/yy", "dd-MM-yyyy", "d-M-yy", "dd-MMM-yyyy", "d-MMM-yy", "dd MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd", "yyyyMMdd")
    spelled = F.element_at(F.array(*[F.date_format("d", x) for x in layouts]), (F.col("k") % len(layouts) + 1).cast("int"))
    return s.facts.select("k", dates.parse_date(F.concat(F.lit(" "), F.upper(spelled))).alias("day"))


query("f7_header_keys")(lambda s: _table(s, "documents").select(
    "doc_id", F.length(text.header_key(F.col("text"))).alias("n"), F.md5(text.header_key(F.col("text")).cast("binary")).alias("key_md5")))
query("f19_money_columns")(lambda s: money.render_money_columns(movements.balances(s.books.daily)))


@query("p9_invalid_contracts")
def _(s):
    """A contract line per order, some of them with a method or a rate that does not exist."""
    rate = F.element_at(F.array(F.lit("2.00"), F.lit("2,00"), F.lit("10.5"), F.lit("-1"), F.lit("0"), F.lit(None).cast("string"), F.lit("10")), (F.col("k") % 7 + 1).cast("int"))
    raw = s.facts.select("k", F.when(F.col("k") % 11 == 3, "cheque").when(F.col("k") % 11 == 5, None).otherwise(F.col("method")).alias("method"), rate.alias("rate"))
    return fees.invalid_contracts(raw).select("k", "reason")


@query("w13_bank_days")
def _(s):
    days, out = s.facts.select("d").distinct(), None
    for n in range(4):
        one = add_bank_days(days, "d", n, s.calendar, "landed").select("d", F.lit(n).alias("n"), "landed")
        out = one if out is None else out.unionByName(one)
    return out


# --- log ---------------------------------------------------------------------------------------

query("f14_digests")(lambda s: log.with_digest(s.events).select("merchant_id", "event_id", "digest"))
query("u1_union_of_sources")(lambda s: select.union_sources(
    s.events.filter("type IN ('bank_credit_received', 'bank_charge_applied', 'bank_debit')"),
    s.events.filter("type NOT IN ('bank_credit_received', 'bank_charge_applied', 'bank_debit')"),
).select("merchant_id", "event_id", "occurred_at"))
query("u2_distinct_facts")(lambda s: log.distinct_facts(s.deliveries).select("merchant_id", "event_id"))
query("u2_ingestion")(lambda s: log.ingestion(s.deliveries, None))
query("u3_missing_facts")(lambda s: audits.differing_facts(
    s.log, log.with_digest(s.events.filter("type <> 'bank_debit'"))))
# the log is refolded without the bank's charges, so exactly the balances they touch must differ
query("q4_refolded_balances")(lambda s: audits.differing_balances(
    movements.balances(daily_sums(s.log.filter("type <> 'bank_charge_applied'"))), movements.balances(s.books.daily)))
query("q7_repeated_facts")(lambda s: audits.repeated_facts(s.deliveries).groupBy("merchant_id").agg(
    F.count("*").alias("facts"), F.sum("copies").alias("copies")))


@query("w2_broken_links")
def _(s):
    """Some links get another root, others another predecessor; both kinds must be found, and no other."""
    links = s.chain
    return log.broken_links(links.withColumns({
        "root": F.when(F.col("batch") % 9 == 4, F.sha2("root", 256)).otherwise(F.col("root")),
        "prev_hash": F.when(F.col("batch") % 9 == 7, F.sha2("prev_hash", 256)).otherwise(F.col("prev_hash")),
    }))


query("w3_chain")(lambda s: s.chain)


@query("s13_log_roundtrip")
def _(s):
    """Three deliveries, two of them on the same days and all with facts that were there before; read back verified."""
    path = f"{checkpoint_folder(s.spark)}/log-{uuid.uuid4().hex}"
    early, bank = F.col("recorded_at") <= F.lit("1998-06-30").cast("date"), F.col("type").isin("bank_credit_received", "bank_charge_applied", "bank_debit")
    captured, paid = F.col("type") == "payment_captured", F.col("type") == "settlement_executed"
    for delivery in (early & ~bank, early & (bank | captured), ~early | paid):
        log_store.append(s.events.filter(delivery), path)
    log_store.read_log(s.spark, path)
    return log_store.links(s.spark, path)


query("w4_sequence")(lambda s: audits.broken_sequence(s.log.filter("seq % 50 <> 17")))
query("w5_sequence")(lambda s: s.log.select("merchant_id", "event_id", "seq"))


@query("s14_pack_heads")
def _(s):
    return pack.build(s.books, log.heads(s.chain))[0]


@query("x12_pack_verify")
def _(s):
    heads = log.heads(s.chain)
    # each is read several times below
    sealed, lines = (cut(part, "pack") for part in pack.build(s.books, heads))
    w = F.col("window_id")
    told = sealed.withColumn("gross_paise", F.when(w % 11 == 3, F.col("gross_paise") + 1).otherwise(F.col("gross_paise")))
    changed = lines.withColumn("body", F.when(w % 11 == 5, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    fresh = sealed.withColumn("digest", F.when(w % 11 == 7, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return pack.verify(told, changed, fresh, heads)


# --- statements and tax --------------------------------------------------------------------------

query("w1_balance_check")(lambda s: statement.check_balances(s.statement_lines).select("file", "line", "checked", "broken"))
query("w1_statement_report")(lambda s: statement.statement_report(s.statement_lines))
query("s8_statement_events")(lambda s: statement.statement_events(
    s.statement_lines.filter("NOT opening").withColumn("ref", F.lit("")), F.element_at(F.split("file", "-"), 1)
).select("merchant_id", "event_id", "type", "occurred_at", "entity_id", "amount_paise", "narration"))
query("a11_supplier_credit")(lambda s: tax.supplier_credit(s.invoices))
query("a23_statement_totals")(lambda s: s.statement_lines.groupBy("file").agg(
    F.coalesce(F.sum("debit_paise"), F.lit(0)).alias("debits_paise"), F.coalesce(F.sum("credit_paise"), F.lit(0)).alias("credits_paise")))
query("c23_gst_shortfall")(lambda s: tax.gst_shortfall(s.window_fees, s.invoices, GATEWAY_GSTIN).drop("kind"))
query("c24_malformed_gstins")(lambda s: tax.malformed_gstins(s.invoices).drop("kind"))
query("c25_tds_gap")(lambda s: tax.tds_gap(s.window_fees, s.form_26as).drop("kind"))
query("c26_tax_risks")(lambda s: tax.assess(s.window_fees, s.invoices, s.form_26as, GATEWAY_GSTIN))
query("j12_paid_against_available")(lambda s: tax.gst_shortfall(s.window_fees, s.invoices, GATEWAY_GSTIN).groupBy("merchant_id").agg(
    F.sum("paid_paise").alias("paid_paise"), F.sum("shown_paise").alias("shown_paise")))

# --- apportionment and text -------------------------------------------------------------------------


@query("f4_apportion")
def _(s):
    """Each order's total split over its lines by quantity."""
    orders = _table(s, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("total_paise"))
    lines = _table(s, "lineitem")
    # all steps go by the order: one shuffle, into as many parts as the lines ask for
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity").repartition(parts_for(lines.count(), s.spark), "l_orderkey")
    lines = lines.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("weight"))
    return apportion.allocate(lines.join(orders, "k"), ["k"], "total_paise", "weight", "line").select("k", "line", "share_paise")


@query("f9_narration_styles")
def _(s):
    paid = s.books.payouts.select("merchant_id", "settlement_id", "utr")
    known = s.books.credits.join(s.truth_links, ["merchant_id", "bank_txn_id"]).join(paid, ["merchant_id", "settlement_id"])
    return known.groupBy("merchant_id", text.narration_style(F.col("narration"), F.col("utr")).alias("style")).agg(
        F.count("*").alias("credits"))


query("f15_document_figures")(lambda s: grounding.citations(_table(s, "documents"), ["doc_id"]))
query("x8_checked_figures")(lambda s: grounding.check(s.texts, grounding.permitted_figures(s.books), WINDOW).select(
    *WINDOW, "paise", "grounded", "nearest_paise"))
query("x8_grounding_rate")(lambda s: grounding.grounding_rate(
    grounding.check(s.texts, grounding.permitted_figures(s.books), WINDOW), WINDOW, s.texts))
query("x18_permitted_figures")(lambda s: grounding.permitted_figures(s.books))

# --- forecasts -----------------------------------------------------------------------------------------

query("a12_weekday_shape")(lambda s: s.outlook.weekdays)
query("a12_rates")(lambda s: s.outlook.rates)
query("a24_overdue_and_written_off")(lambda s: s.outlook.overdue.join(s.outlook.written_off, ["merchant_id", "as_of"]))
query("x1_forecast_days")(lambda s: s.outlook.days.drop("is_bank_day"))
query("x1_forecast_totals")(lambda s: s.outlook.totals)
query("w14_through")(lambda s: s.outlook.through())
query("x2_error_causes")(lambda s: s.outlook.error_causes())
query("x3_outcomes")(lambda s: s.outlook.outcomes)
query("a13_backtest")(lambda s: forecast.backtest(s.outlook.outcomes))
query("k4_worst_windows")(lambda s: forecast.worst(s.outlook.outcomes))
query("w7_split_floors")(lambda s: conformal.split_floors(s.outlook.outcomes))
query("w8_adaptive_floors")(lambda s: conformal.adaptive_floors(s.outlook.outcomes).withColumn(
    "level", F.round("level", 9)).withColumn("discount", F.round("discount", 9)))
query("a14_coverage")(lambda s: conformal.coverage(conformal.split_floors(s.outlook.outcomes), "split", 14, 28))


@query("a15_pooled_coverage")
def _(s):
    split = conformal.coverage(conformal.split_floors(s.outlook.outcomes), "split", 14, 28)
    adaptive = conformal.coverage(conformal.adaptive_floors(s.outlook.outcomes), "adaptive", 14, 28)
    return conformal.pooled(split.unionByName(adaptive))


# --- search ----------------------------------------------------------------------------------------------

query("x4_slices")(lambda s: search.slices(s.books))
query("x6_hold_out")(lambda s: search.hold_out(s.books))
query("x6_rediscover")(lambda s: search.rediscover(s.books))
query("x5_blame_largest")(lambda s: search.blame_largest(s.books).select(*WINDOW, "cause", "account", "claim_paise", "accepted"))
query("x7_second_opinion")(lambda s: search.second_opinion(s.books))
query("x17_drill_down")(lambda s: movements.in_windows(
    s.postings.filter("account = 'chargeback_loss'"), s.books.windows).select(
    *WINDOW, "event_id", "account", "amount_paise", "ref"))

# --- sources over the ledger's own rows ------------------------------------------------------------------------


def _report_items(s: SampleLedger) -> DataFrame:
    """The ledger's order events as the rows a settlement report would carry."""
    kinds = {"payment_captured": "payment", "refund_issued": "refund", "route_transfer": "transfer", "gateway_adjustment": "adjustment"}
    rows = s.events.filter(F.col("type").isin(*kinds))
    kind = None
    for event, name in kinds.items():
        kind = F.when(F.col("type") == event, name) if kind is None else kind.when(F.col("type") == event, name)
    taken = F.col("type") == "payment_captured"
    credit = F.when(taken, F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")).otherwise(0)
    seconds = F.unix_seconds(F.col("occurred_at").cast("timestamp"))
    month = F.date_format("occurred_at", "yyyyMM")
    wanted = {
        "entity_id": F.col("entity_id"), "type": kind, "amount": F.col("amount_paise"), "credit": credit,
        "debit": F.when(taken, 0).otherwise(F.col("amount_paise")), "fee": F.col("fee_paise"), "tax": F.col("tax_paise"),
        "currency": F.lit("INR"), "created_at": seconds, "settled_at": F.unix_seconds(F.last_day("occurred_at").cast("timestamp")),
        "settlement_id": F.concat(F.lit("rs_"), month), "settlement_utr": F.concat(month, "merchant_id"),
        "order_id": F.col("counterparty"), "payment_id": F.col("counterparty"), "description": F.col("detail"), "method": F.col("method"),
        "id": F.col("entity_id"), "entity": F.lit("payment"), "status": F.lit("captured"),
    }
    columns = []
    for field in gateway.ITEM.split(", "):
        name, typed = field.split(" ")
        columns.append((wanted[name] if name in wanted else F.lit(None)).cast(typed).alias(name))
    return rows.select("merchant_id", F.lit("report").alias("file"), F.xxhash64("event_id").alias("position"), *columns)


_BOOKED = ["merchant_id", "event_id", "type", "occurred_at", "recorded_at", "entity_id", "counterparty", "amount_paise",
           "fee_paise", "tax_paise", "utr", "detail"]
query("s1_report_events")(lambda s: gateway.report_events(_report_items(s), F.lit("2002-01-01").cast("date")).select(*_BOOKED))
query("s1_report_covers")(lambda s: gateway.report_covers(_report_items(s), F.lit("2002-01-01").cast("date")).select(
    "merchant_id", "settlement_id", "payment_id"))


@query("s2_payment_events")
def _(s):
    """Captures as a payments export reports them: the fee includes its tax."""
    items = _report_items(s).filter("type = 'payment'").withColumn("fee", F.col("fee") + F.col("tax"))
    return gateway.payment_events(items).select(*_BOOKED)


@query("s3_refund_events")
def _(s):
    items = _report_items(s).filter("type = 'refund'").withColumn("status", F.when(F.col("amount") % 10 == 3, "failed").otherwise("processed"))
    fast = F.when(F.col("description") == "instant", "optimum").otherwise("normal")
    return gateway.refund_events(items.withColumn("speed_processed", fast)).select(*_BOOKED)


query("p6_report_rejects")(lambda s: gateway.report_rejects(
    _report_items(s).withColumn("currency", F.when(F.col("amount") % 100 == 7, "USD").otherwise(F.col("currency"))).withColumn(
        "type", F.when(F.col("amount") % 100 == 9, "mystery").otherwise(F.col("type")))
).select("merchant_id", "entity_id", "reason"))
query("p7_lenient_report")(lambda s: gateway.report_events(
    _report_items(s).withColumn("currency", F.when(F.col("amount") % 100 == 7, "USD").otherwise(F.col("currency"))),
    F.lit("2002-01-01").cast("date"), strict=False).filter("type <> 'settlement_executed'").groupBy("merchant_id", "type").agg(
    F.count("*").alias("events"), F.sum("amount_paise").alias("amount_paise")))

# --- streams over the sample events ------------------------------------------------------------------------------


def stream_query(name: str, mode: str, keys: list[str] | None = None):
    def keep(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return run_to_table(build(fact_stream(spark, folder)), mode, name, keys)

        QUERIES[name] = run
        return build

    return keep


stream_query("t1_distinct_within", "append")(lambda facts: jobs.distinct_within(facts.union(facts)).select(
    "merchant_id", "event_id", "type", "amount_paise"))


def _t1_streamed_log(spark: SparkSession, folder: str) -> DataFrame:
    """The stream, with every fact twice, recorded into a log and read back verified."""
    base = f"{checkpoint_folder(spark)}/streamed-{uuid.uuid4().hex}"
    facts = fact_stream(spark, folder)
    jobs.ingest(facts.union(facts), f"{base}/log", f"{base}/state").awaitTermination()
    return log_store.read_log(spark, f"{base}/log").select("merchant_id", "event_id", "type", "amount_paise", "delivery", "seq")


QUERIES["t1_streamed_log"] = _t1_streamed_log
stream_query("t3_weekly_movements", "update", ["merchant_id", "week_start", "account"])(jobs.weekly_movements)
stream_query("t4_running_balances", "update", ["merchant_id", "account"])(jobs.running_balances)
