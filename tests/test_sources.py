import json

import pytest
from pyspark.sql import functions as F

from khata.operators.postings import project
from khata.sources import delimited, gateway, gst, statement



def pulled():
    return F.lit("2026-03-20").cast("date")


def write(folder, name, body):
    target = folder / "m1"
    target.mkdir(exist_ok=True)
    (target / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(target / name)


def report(folder, items, name="report.json"):
    return write(folder, name, json.dumps({"entity": "collection", "count": len(items), "items": items}))


ITEMS = [
    dict(entity_id="pay_a", type="payment", amount=120000, debit=0, credit=116885, fee=2640, tax=475, currency="INR",
         created_at=1773014400, settled_at=1773187200, settlement_id="setl_1", settlement_utr=None, method="card", email="buyer@shop.example"),
    dict(entity_id="pay_b", type="payment", amount=380000, debit=0, credit=370135, fee=8360, tax=1505, currency="INR",
         created_at=1773014400, settlement_id="setl_1", settlement_utr="KH77Q0042", method="upi", order_id="basket_4"),
    dict(entity_id="rf_a", type="refund", amount=91000, debit=91000, credit=0, currency="INR", settlement_id="setl_1", payment_id="pay_a"),
    dict(entity_id="trf_a", type="transfer", amount=40500, debit=40500, credit=0, settlement_id="setl_1", payment_id="pay_b", description="partner_2"),
    dict(entity_id="adj_a", type="adjustment", amount=13350, debit=13350, credit=0, settlement_id="setl_1", description="late papers"),
]


def test_report_becomes_events_and_one_payout(spark, tmp_path):
    items = gateway.read_export(spark, report(tmp_path, ITEMS))
    assert "email" not in items.columns
    events = gateway.report_events(items, pulled())
    got = {r["event_id"]: r for r in events.collect()}
    assert set(got) == {"cap-pay_a", "cap-pay_b", "ref-rf_a", "trf-trf_a", "adj-adj_a", "setl-setl_1"}
    payout = got["setl-setl_1"]
    assert (payout["amount_paise"], payout["utr"], str(payout["occurred_at"])) == (342170, "KH77Q0042", "2026-03-11")
    assert got["cap-pay_a"]["merchant_id"] == "m1" and got["cap-pay_a"]["fee_paise"] == 2640
    assert str(got["ref-rf_a"]["occurred_at"]) == "2026-03-20"
    assert gateway.report_covers(items, pulled()).count() == 5
    assert project(events).agg(F.sum("amount_paise")).first()[0] == 0


def test_strict_report_refuses_and_lenient_drops(spark, tmp_path):
    odd = [*ITEMS, dict(entity_id="q", type="payment", currency="USD", amount=1), dict(entity_id="z", type="mystery", amount=1)]
    items = gateway.read_export(spark, report(tmp_path, odd))
    with pytest.raises(gateway.RefusedLoad):
        gateway.report_events(items, pulled())
    assert {r["reason"] for r in gateway.report_rejects(items).collect()} == {"foreign currency USD", "unmapped row type mystery"}
    assert gateway.report_events(items, pulled(), strict=False).count() == 6


def test_credit_side_adjustments_are_listed(spark, tmp_path):
    items = gateway.read_export(spark, report(tmp_path, [dict(entity_id="a", type="adjustment", credit=5, debit=0, settlement_id="s")]))
    assert gateway.credit_adjustments(items).count() == 1


PAYMENTS = [
    dict(id="pay_1", entity="payment", amount=640000, amount_refunded=115000, fee=13216, tax=2016, status="captured", method="card",
         currency="INR", created_at=1773014400, order_id="basket_1"),
    dict(id="pay_2", entity="payment", amount=45500, status="failed", method="upi", error_code="DECLINED", created_at=1773014400),
    dict(id="pay_3", entity="payment", amount=1, status="created", method="upi", created_at=1773014400),
]
REFUNDS = [
    dict(id="r1", amount=115000, payment_id="pay_1", currency="INR", status="processed", speed_processed="optimum", created_at=1773100000),
    dict(id="r2", amount=9, payment_id="pay_1", status="failed", created_at=1773100000),
]


def test_payments_export_fee_includes_tax(spark, tmp_path):
    items = gateway.read_export(spark, report(tmp_path, PAYMENTS, "p.json"))
    refunds = gateway.read_export(spark, report(tmp_path, REFUNDS, "r.json"))
    got = {r["event_id"]: r for r in gateway.payment_events(items, refunds).collect()}
    assert set(got) == {"pay_1", "pay_2", "r1"}
    assert (got["pay_1"]["fee_paise"], got["pay_1"]["tax_paise"]) == (11200, 2016)
    assert got["pay_2"]["type"] == "payment_failed" and got["r1"]["detail"] == "instant"


def test_payments_without_their_refunds_are_refused(spark, tmp_path):
    items = gateway.read_export(spark, report(tmp_path, PAYMENTS, "p.json"))
    with pytest.raises(gateway.RefusedLoad, match="refund"):
        gateway.payment_events(items)
    with pytest.raises(gateway.RefusedLoad, match="method"):
        bad = gateway.read_export(spark, report(tmp_path, [dict(PAYMENTS[1], method="barter")], "b.json"))
        gateway.payment_events(bad)


def test_kind_of_export_is_told_by_its_rows(spark, tmp_path):
    report(tmp_path, ITEMS, "a.json")
    report(tmp_path, PAYMENTS, "b.json")
    items = gateway.read_export(spark, str(tmp_path / "m1" / "*.json"))
    parts = gateway.split_by_kind(items)
    assert (parts["report"].count(), parts["payments"].count()) == (5, 3)
    seen = gateway.input_report(parts["payments"], gateway.payment_events(parts["payments"].drop("amount_refunded").withColumn(
        "amount_refunded", F.lit(0)))).first()
    assert (seen["rows_in"], seen["events"]) == (3, 2)


TWO_COLUMNS = """BLUE HILLS COOPERATIVE
Branch,77

For the days from,01/03/26
,,
Holder,A Shop
Date,Narration,Chq./Ref.No.,Value Dt,Withdrawal Amt.,Deposit Amt.,Closing Balance
11/03/26,"PAYIN KHATA, LTD",K-1,11/03/26,,"64,210.75","2,10,400.00"
12/03/26,PAYIN KHATA,K-2,13/03/26,,"31,007.40","2,41,407.40"
13/03/26,SMS ALERT CHRG,,13/03/26,59.00,,"2,41,348.40"
14/03/26,LEASE,X,14/03/26,1500.00,,"2,39,000.00"
*** last line ***
"""
ONE_COLUMN = """Tran Date,CHQNO,PARTICULARS,AMOUNT,DR/CR,BAL,SOL
11-03-2026,,PAYIN KHATA,64210.75,CR,210400.00,1
12-03-2026,,AMC,75.00,DR,210325.00,1
"""


def test_statement_layouts_and_their_balance(spark, tmp_path):
    write(tmp_path, "two.csv", TWO_COLUMNS)
    write(tmp_path, "one.csv", ONE_COLUMN)
    write(tmp_path, "junk.csv", "a,b,c\n1,2,3\n")
    write(tmp_path, "blank.csv", "\n\n")
    with pytest.raises(delimited.RefusedFile, match="header"):
        statement.load(spark, str(tmp_path / "m1"))
    out = statement.load(spark, str(tmp_path / "m1"), strict=False)
    rows = out["rows"].withColumn("name", F.element_at(F.split("file", "/"), -1)).orderBy("name", "line").collect()
    one, two = [r for r in rows if r["name"] == "one.csv"], [r for r in rows if r["name"] == "two.csv"]
    assert [(r["debit_paise"], r["credit_paise"]) for r in one] == [(0, 6421075), (7500, 0)]
    assert [(r["debit_paise"], r["credit_paise"], r["balance_paise"]) for r in two] == [
        (0, 6421075, 21040000), (0, 3100740, 24140740), (5900, 0, 24134840), (150000, 0, 23900000)]
    assert two[0]["narration"] == "PAYIN KHATA, LTD" and str(two[1]["value_date"]) == "2026-03-13" and two[0]["line"] == 8
    assert [r["reason"] for r in out["skipped"].collect()] == ["*** last line ***"]
    assert {r["file"].split("/")[-1] for r in out["unreadable"].collect()} == {"junk.csv", "blank.csv"}
    told = {r["file"].split("/")[-1]: r for r in statement.statement_report(out["lines"]).collect()}
    assert (told["two.csv"]["checked"], told["two.csv"]["broken"], told["two.csv"]["reconciles"]) == (3, 1, False)
    assert told["one.csv"]["reconciles"]
    events = statement.statement_events(out["rows"], F.lit("m1")).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in events} == {"bank_credit_received": 3, "bank_charge_applied": 2, "bank_debit": 1}


def test_quoted_line_breaks_and_encodings(spark, tmp_path):
    body = 'Date,Narration,Debit,Credit,Balance\n05/03/2026,"NEFT\nGATEWAY",,10.00,10.00\n06/03/2026,caf\xe9 \x80,1.00,,9.00\n'
    write(tmp_path, "a.csv", body.encode("latin-1"))
    write(tmp_path, "b.csv", b"\xef\xbb\xbf" + TWO_COLUMNS.encode())
    out = statement.load(spark, str(tmp_path / "m1"))
    rows = {r["line"]: r["narration"] for r in out["rows"].filter("file LIKE '%a.csv'").collect()}
    assert rows == {2: "NEFT\nGATEWAY", 3: "café €"}
    assert out["rows"].filter("file LIKE '%b.csv'").count() == 4


def test_opening_balance_anchors_the_check(spark, tmp_path):
    write(tmp_path, "o.csv", "Date,Description,Debit,Credit,Balance\n01/03/2026,OPENING,,,100.00\n02/03/2026,A,,5.00,\n"
          "03/03/2026,B,1.00,,104.00\n04/03/2026,NOTE,,,104.00\n05/03/2026,C,,1.00,106.00\n")
    out = statement.load(spark, str(tmp_path / "m1"))
    told = statement.statement_report(out["lines"]).first()
    assert (told["rows"], told["balances_seen"], told["checked"], told["broken"]) == (3, 3, 2, 1)


RETURN = {"data": {"rtnprd": "032026", "gstin": "x", "docdata": {"b2b": [
    {"ctin": "07PQRST6543K1Z8", "trdnm": "PAYIN", "inv": [
        {"inum": "K1", "dt": "12-03-2026", "itms": [{"itm_det": {"txval": "3,120.50", "cgst": 280.84, "sgst": "280.85"}}]},
        {"inum": "K2", "dt": "soon", "itms": []}]},
    {"ctin": "07YYYYY8888Y8Y8", "inv": [{"inum": "K3", "dt": "21/03/2026", "itms": [{"txval": 200, "igst": "36"}, {"txval": 75}]}]}]}}}
CSV = ("Auto-drafted\n\nGSTIN of supplier,Trade/Legal name,Invoice number,Invoice date,Taxable Value (Rs),Integrated Tax(Rs),Central Tax(Rs),"
       "State/UT Tax(Rs)\n07pqrst6543k1z8,P,K9,12-03-2026,\"2,500.00\",0,225.00,225.00\nSum,,,,,,,\n")


def test_returns_in_both_forms(spark, tmp_path):
    write(tmp_path, "r.json", json.dumps(RETURN))
    write(tmp_path, "r.csv", CSV)
    write(tmp_path, "bracket.csv", "[draft]\n" + CSV)
    write(tmp_path, "broken.json", json.dumps(RETURN)[:-9])
    write(tmp_path, "other.csv", "a,b\n1,2\n")
    with pytest.raises(delimited.RefusedFile, match="not a return"):
        gst.load(spark, str(tmp_path / "m1"))
    out = gst.load(spark, str(tmp_path / "m1"), strict=False)
    assert {r["file"].split("/")[-1] for r in out["unreadable"].collect()} == {"broken.json", "other.csv"}
    got = {r["invoice_no"]: r for r in out["invoices"].collect()}
    assert set(got) == {"K1", "K3", "K9"}
    assert (got["K1"]["taxable_paise"], got["K1"]["cgst_paise"], got["K1"]["sgst_paise"]) == (312050, 28084, 28085)
    assert (got["K3"]["taxable_paise"], got["K3"]["igst_paise"]) == (27500, 3600)
    assert (got["K9"]["cgst_paise"], got["K9"]["sgst_paise"], got["K9"]["merchant_id"]) == (22500, 22500, "m1")
    assert out["invoices"].filter("invoice_no = 'K9'").count() == 2  # the second begins with a bracket and is no JSON
    from khata.plans import tax

    once = out["invoices"].dropDuplicates(["invoice_no"])
    credit = {r["supplier_gstin"]: r["credit_paise"] for r in tax.supplier_credit(once).collect()}
    assert credit == {"07PQRST6543K1Z8": 28084 + 28085 + 45000, "07YYYYY8888Y8Y8": 3600}
    assert tax.malformed_gstins(once, ["merchant_id"]).first()["amount_paise"] == 3600 + 45000  # lower case fails the format


def test_large_files_stop_a_strict_load_and_are_listed_by_a_lenient_one(spark, tmp_path):
    write(tmp_path, "large.csv", TWO_COLUMNS)
    write(tmp_path, "small.csv", "x,y\n")
    folder = str(tmp_path / "m1")
    with pytest.raises(delimited.RefusedFile, match="large.csv"):
        delimited.read_files(spark, folder, most=50)
    assert [r["file"].split("/")[-1] for r in delimited.read_files(spark, folder, strict=False, most=50).collect()] == ["small.csv"]
    assert [r["file"].split("/")[-1] for r in delimited.oversized(spark, folder, 50).collect()] == ["large.csv"]
    assert delimited.oversized(spark, folder).count() == 0


def test_every_cell_is_read_however_many_and_however_quoted(spark, tmp_path):
    line = ",".join(f"c{i}" for i in range(75))
    quoted = 'plain,"a, b","say ""x""",,"",end'
    write(tmp_path, "w.csv", f"{line}\n{quoted}\n")
    write(tmp_path, "o.csv", f'{line}\n"runs\nover",2\n{quoted}\n')
    got = {(r["file"].split("/")[-1], len(r["cells"])): r["cells"] for r in delimited.cells(delimited.read_files(spark, str(tmp_path / "m1"))).collect()}
    want = ["plain", "a, b", 'say "x"', "", "", "end"]
    assert got["w.csv", 75] == got["o.csv", 75] == line.split(",") and got["w.csv", 6] == got["o.csv", 6] == want
