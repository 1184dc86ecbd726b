"""Closes, restatements, named queries, packs and the three-source job."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from test_sources import write

from khata.functions import money
from khata.operators import fees, log
from khata.plans import causes, close, conformal, forecast, named, pack, reconcile, restate, search, tax
from khata.schemas import CONTRACTS
from khata.sources import exports


def test_every_window_closes_and_is_covered(ledger):
    rows = close.close_summary(ledger.books)
    assert rows.filter("NOT closes OR NOT fully_covered").isEmpty() and rows.count() > 1000


def test_evidence_sql_reproduces_its_finding(spark, ledger):
    named.register_views(spark, ledger.books, ledger.covers)
    found = close.evidence_sql(close.findings(ledger.books).join(ledger.books.windows, ["merchant_id", "window_id"]))
    rows = found.filter("evidence_sql IS NOT NULL").join(
        causes.refined(ledger.books.measured).select("merchant_id", "window_id", "cause", "raw_paise"), ["merchant_id", "window_id", "cause"])
    # the newest window of every cause, and the largest finding of each that the contract, the calendar or the links decide
    last = rows.groupBy("cause").agg(F.max_by("evidence_sql", F.struct("window_id", "merchant_id")).alias("sql"), F.max_by("raw_paise", F.struct("window_id", "merchant_id")).alias("raw"))
    most = rows.filter(F.col("cause").isin("normal_fee", "fee_rate_increase", "bank_holiday_delay", "settlement_never_arrived")).groupBy("cause").agg(
        F.max_by("evidence_sql", F.abs("raw_paise")).alias("sql"), F.max_by("raw_paise", F.abs("raw_paise")).alias("raw"))
    taken = last.unionByName(most).collect()
    assert {r["cause"] for r in taken} == {r["cause"] for r in rows.select("cause").distinct().collect()} >= {"normal_fee", "fee_rate_increase", "bank_holiday_delay", "settlement_never_arrived"}
    for row in taken:
        assert spark.sql(row["sql"]).first()["amount_paise"] == row["raw"], row["cause"]


def test_without_a_contract_fees_stay_open(spark, ledger):
    none = ledger.books.over(ledger.books.windows)
    for name in ("daily_fees", "measured"):
        none.__dict__.pop(name, None)
    none.contracts = spark.createDataFrame([], CONTRACTS)
    summary = close.close_summary(none)
    assert not summary.filter("remainder_paise <> 0").isEmpty()
    open_accounts = close.coverage(none).filter("NOT ok").select("account").distinct().collect()
    assert [r["account"] for r in open_accounts] == ["fee_expense"]
    assert search.short_accounts(close.coverage(none)).filter("account <> 'fee_expense'").isEmpty()


def test_contract_lines_are_checked(spark):
    raw = spark.createDataFrame([("m", "card", "2.00"), ("m", "barter", "1"), ("m", "upi", "two"), ("m", "emi", "11")],
                                "merchant_id string, method string, rate string")
    got = {r["method"]: r["reason"] for r in fees.invalid_contracts(raw).collect()}
    assert got == {"barter": "unknown method", "upi": "rate is not a number", "emi": "rate outside 0 to 10 percent"}


def test_late_disputes_restate_signed_closes(ledger):
    moved = restate.movements(ledger.books)
    assert not moved.filter("cause = 'dispute_reserve_held' AND appeared").isEmpty()
    assert restate.restatement(ledger.books).filter("drift_paise <> 0").isEmpty()


def test_sweep_finds_every_removable_cause_and_the_baseline_few(ledger):
    swept = search.rediscover(ledger.books)
    assert swept.count() > 1000
    missed = swept.filter("NOT accepted")
    # a slice of another account may happen to be as large; then the search must not guess
    assert missed.count() / swept.count() < 0.05
    assert missed.filter("slice IS NOT NULL").isEmpty()
    baseline = search.blame_largest(ledger.books)
    assert baseline.filter("accepted").count() / baseline.count() < 0.05


def test_questions_find_their_query(spark, ledger):
    assert named.which("which payouts never arrived?") == "payouts_without_credit"
    assert named.which("top 5 biggest settlements") == "largest_payouts"
    assert named.which("what is the weather") is None
    named.register_views(spark, ledger.books, ledger.covers)
    assert named.ask(spark, "largest_payouts", top=3).count() == 3
    assert named.shown(named.ask(spark, "refunds"), 2).count() == 2
    shown = money.render_money_columns(named.ask(spark, "largest_payouts", top=1)).first()
    assert shown["amount_paise"].startswith("INR ")


def test_packs_verify_and_catch_changes(spark, ledger, tmp_path):
    books = ledger.books.over(ledger.books.windows.filter("window_id < 30"))
    heads = log.heads(log.chain(ledger.log))
    sealed, lines = pack.build(books, heads)
    assert pack.verify(sealed, lines, sealed, heads).isEmpty()
    exports.write_packs(sealed, lines, str(tmp_path / "pack"))
    stored = spark.read.schema(lines.schema).json(str(tmp_path / "pack" / "lines"))
    assert pack.verify(sealed, stored, sealed, heads).isEmpty()
    forged = lines.withColumn("body", F.replace("body", F.lit('"ok":true'), F.lit('"ok":false')))
    assert {r["reason"] for r in pack.verify(sealed, forged, sealed, heads).collect()} == {"lines do not match the digest"}
    other = heads.withColumn("log_head", F.lit("0"))
    assert {r["reason"] for r in pack.verify(sealed, lines, sealed, other).collect()} == {"computed from another log"}
    touched = sealed.withColumn("gap_paise", F.col("gap_paise") + 1)
    assert {r["reason"] for r in pack.verify(touched, lines, sealed, heads).collect()} == {"contents do not match the digest"}


def test_results_are_written(spark, ledger, tmp_path):
    books = ledger.books.over(ledger.books.windows.filter("window_id < 3"))
    exports.write_results(books, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).count() == 15


def test_calibration_origins_end_by_the_day(spark):
    rows = forecast.calibration_origins(spark.sql("SELECT 'm' AS merchant_id, DATE '2026-06-01' AS as_of")).collect()
    days = sorted(r["as_of"] for r in rows)
    assert len(days) == 10 and days[-1] == datetime.date(2026, 5, 18) and days[0] == datetime.date(2026, 1, 12)


def test_forecast_is_blind_to_the_future(spark, ledger):
    """Taking away everything recorded after an origin does not change its forecast."""
    origin = spark.sql("SELECT 'm0' AS merchant_id, DATE '1997-06-03' AS as_of UNION ALL SELECT 'm3', DATE '1997-06-03'")
    day = F.lit("1997-06-03").cast("date")
    cut_books = type(ledger.books)(
        ledger.events.filter((F.col("recorded_at") <= day) & (F.col("occurred_at") <= day)), ledger.calendar,
        ledger.contracts, ledger.books.windows)
    full = forecast.Outlook(ledger.books, ledger.covers, origin).days
    blind = forecast.Outlook(cut_books, ledger.covers.filter(F.col("settled_on") <= day), origin).days
    assert full.count() == 28 and full.exceptAll(blind).isEmpty()


def test_pooled_coverage_adds_up(spark):
    rows = [("a", "x", 9, 1, 90, 100, 5), ("b", "x", 8, 2, 80, 100, 5)]
    covered = spark.createDataFrame(rows, "merchant_id string, method string, held int, breached int, floor_paise bigint, actual_paise bigint, independent int")
    got = conformal.pooled(covered).first()
    assert (got["held"], got["empirical"], got["tightness"], got["meets_target"]) == (17, 0.85, 0.85, False)


STAMP = 1772409600  # 2026-03-02
ITEMS = [
    dict(entity_id="pay_1", type="payment", amount=1000000, credit=971680, debit=0, fee=24000, tax=4320, currency="INR", method="card",
         created_at=STAMP, settled_at=STAMP + 2 * 86400, settlement_id="s1", settlement_utr="20260304000001"),
    dict(entity_id="pay_2", type="payment", amount=500000, credit=488200, debit=0, fee=10000, tax=1800, currency="INR", method="upi",
         created_at=STAMP + 86400, settled_at=STAMP + 3 * 86400, settlement_id="s2", settlement_utr="20260305000002"),
    dict(entity_id="rf_1", type="refund", amount=100000, credit=0, debit=100000, currency="INR", payment_id="pay_2",
         created_at=STAMP + 86400, settled_at=STAMP + 3 * 86400, settlement_id="s2", settlement_utr="20260305000002"),
]
BANK = """Date,Narration,Ref,Debit,Credit,Balance
04/03/2026,NEFT GATEWAY 20260304000001,,,"9,716.80","19,716.80"
06/03/2026,SMS ALERT CHRG,,10.00,,"19,706.80"
12/03/2026,TRANSFER,,,1.00,"19,707.80"
"""
RETURN = {"data": {"docdata": {"b2b": [{"ctin": "29ABCDE1234F1Z5", "inv": [
    {"inum": "I1", "dt": "31-03-2026", "itms": [{"itm_det": {"txval": "340.00", "igst": "50.00"}}]}]}]}}}


def three_sources(spark, tmp_path, bank=BANK, rate="2.00", **options):
    for part in ("gateway", "bank", "gst"):
        (tmp_path / part).mkdir(exist_ok=True)
    write(tmp_path / "gateway", "a.json", json.dumps({"items": ITEMS}))
    write(tmp_path / "bank", "b.csv", bank)
    write(tmp_path / "gst", "r.json", json.dumps(RETURN))
    contracts = spark.createDataFrame([("m1", "card", rate), ("m1", "upi", "2.00")], "merchant_id string, method string, rate string")
    return reconcile.reconcile(
        spark, str(tmp_path / "gateway" / "*"), str(tmp_path / "bank" / "*"), contracts, F.lit("2026-03-20").cast("date"),
        returns=str(tmp_path / "gst" / "*"), gateway_gstin="29ABCDE1234F1Z5", **options)


def test_three_sources_close(spark, tmp_path):
    out = three_sources(spark, tmp_path)
    row = out.summary.first()
    assert (row["gross_paise"], row["landed_paise"], row["closes"], row["fully_covered"]) == (1500000, 971680 - 1000 + 100, True, True)
    found = {r["cause"]: r["amount_paise"] for r in out.findings.collect()}
    assert found["fee_rate_increase"] == 4000 and found["normal_fee"] == 30000 and found["refunds_issued"] == 100000
    assert found["settlement_never_arrived"] == 388200 and found["gst_on_fee"] == 6120
    assert [r["amount_paise"] for r in out.exceptions.collect()] == [100]
    assert {r["kind"]: r["amount_paise"] for r in out.risks.collect()} == {"gst_input_credit": 6120 - 5000}
    assert {r["cause"] for r in out.actions.collect()} >= {"fee_rate_increase", "settlement_never_arrived", "gst_on_fee"}
    assert out.inputs.first()["rows_in"] == 3 and reconcile.open_credits(out).count() == 1


def test_weekly_close_of_three_sources(spark, tmp_path):
    out = three_sources(spark, tmp_path, weekly=True)
    assert out.summary.count() == 2 and out.summary.filter("NOT closes").isEmpty()


def test_a_statement_that_contradicts_itself_stops_the_job(spark, tmp_path):
    with pytest.raises(reconcile.UnreliableInput, match="balance"):
        three_sources(spark, tmp_path, bank=BANK.replace("19,706.80", "19,700.80"))
    with pytest.raises(reconcile.UnreliableInput, match="rate"):
        three_sources(spark, tmp_path, rate="cheap")


def test_tax_risks_without_and_with_proof(spark):
    window = "merchant_id string, window_id int, "
    paid = spark.createDataFrame([("m", 0, 500, 100)], window + "tax_paise bigint, tds_paise bigint")
    assert tax.tds_gap(paid).first()["amount_paise"] == 100
    shown = spark.createDataFrame([("m", 0, 150)], window + "amount_paise bigint")
    assert tax.tds_gap(paid, shown).first()["amount_paise"] == 0


def test_questions_in_words():
    asked = {
        "top five payouts": "largest_payouts", "Show the 20 largest settlements": "largest_payouts", "which payouts didn't arrive?": "payouts_without_credit",
        "What has never reached the bank": "payouts_without_credit", "what could not match?": "unattributed_credits", "unlinked credits": "unattributed_credits",
        "which methods fail most": "failed_by_method", "what did we pay in fees": "fees_by_method", "chargebacks of March": "disputes",
        "money sent back to buyers": "refunds", "which days slipped over a holiday": "slipped_days", "balance of every account": "account_balances", "hello": None,
    }
    assert {q: named.which(q) for q in asked} == asked
    assert [named.how_many(q) for q in ("top five payouts", "the 20 largest", "largest of all", "the largest in 2024")] == [5, 20, 10, 10]
