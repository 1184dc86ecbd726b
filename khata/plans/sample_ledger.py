"""A merchant ledger derived by arithmetic from the star-schema sample tables.

Every order becomes a capture or a failure; refunds, disputes, holds, splits,
adjustments, bank charges and debits follow from its key; payouts are the sum of what
each merchant is due on a bank day; bank credits follow the payouts with references in
five states of repair. There is no randomness, so SQL can derive the same ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions.money import money_text
from khata.lineage import cut
from khata.operators.calendar import bank_calendar
from khata.operators.log import chain, record, with_digest
from khata.operators.movements import variance, weekly_windows, whole_period
from khata.operators.postings import daily_sums, project
from khata.plans import causes
from khata.plans.books import Books
from khata.plans.forecast import Outlook, rolling_origins
from khata.plans.grounding import memos
from khata.schemas import COVERS, EVENTS, conform, event_row

# Days shut every year in the sample ledger.
SAMPLE_HOLIDAYS = ("01-01", "01-26", "05-01", "08-15", "10-02", "12-25")
CONTRACT_RATES = {"card": "2.00", "upi": "2.00", "netbanking": "2.00", "wallet": "2.00", "emi": "2.00"}
SWEEP_PAISE = 5_000_000
GATEWAY_GSTIN = "29ABCDE1234F1Z5"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: merchant, day, gross, method, fee, tax, tds, first late return."""
    orders = _table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customers = _table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = _table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    first_return = (
        _table(spark, folder, "lineitem")
        .filter("l_returnflag = 'R'")
        .select("l_orderkey", F.to_date("l_shipdate").alias("shipped"))
        .join(
            orders.select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("placed")),
            "l_orderkey",
        )
        .filter("shipped > placed")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("shipped").alias("returned_on"))
    )
    method = (
        F.when(F.col("o_orderpriority").startswith("1"), "card")
        .when(F.col("o_orderpriority").startswith("2"), "upi")
        .when(F.col("o_orderpriority").startswith("3"), "netbanking")
        .when(F.col("o_orderpriority").startswith("4"), "wallet")
        .otherwise("emi")
    )
    base = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(first_return, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("k"),
            "n_regionkey",
            F.concat(F.lit("m"), F.col("n_regionkey")).alias("merchant_id"),
            F.to_date("o_orderdate").alias("d"),
            (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("gross"),
            method.alias("method"),
            (~((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 0))).alias("captured"),
            "returned_on",
        )
    )
    hiked = (F.col("method") == "card") & (F.col("d") >= F.lit("1998-07-01").cast("date"))
    points = F.when(hiked, 236).otherwise(200)
    return (
        base.withColumn("fee", F.call_function("div", F.col("gross") * 2 * points + 10000, F.lit(20000)))
        .withColumn("tax", F.call_function("div", F.col("fee") * 36 + 100, F.lit(200)))
        .withColumn(
            "tds",
            F.when(F.col("k") % 7 == 0, F.call_function("div", F.col("gross") * 20 + 10000, F.lit(20000)))
            .otherwise(F.lit(0).cast("bigint")),
        )
    )


def order_events(facts: DataFrame) -> DataFrame:
    """All events that follow from one order, as rows. A few passes over ``facts``, no shuffle."""
    k, d, gross = F.col("k"), F.col("d"), F.col("gross")
    key = k.cast("string")
    captured = F.col("captured")

    def ident(prefix: str) -> Column:
        return F.concat(F.lit(prefix), key)

    def event(kind: str, entity: str, on: Column, amount: Column, recorded: Column | None = None, **more: Column):
        return event_row(
            merchant_id=F.col("merchant_id"), event_id=F.concat(F.lit(kind + ":"), ident(entity)),
            type=F.lit(kind), occurred_at=on, recorded_at=on if recorded is None else recorded,
            entity_id=ident(entity), amount_paise=amount, currency=F.lit("INR"), **more,
        )

    pay = ident("pay_")
    half = F.call_function("div", gross, F.lit(2))
    quarter = F.call_function("div", gross, F.lit(4))
    opened = F.date_add(d, 5)
    known = F.date_add(opened, (7 + k % 15).cast("int"))
    made = [
        (k % 5 == 0, event("order_placed", "ord_", d, gross, counterparty=ident("cust_"))),
        (
            captured,
            event("payment_captured", "pay_", d, gross, method=F.col("method"), fee_paise=F.col("fee"),
                  tax_paise=F.col("tax"), tds_paise=F.col("tds"), counterparty=ident("ord_")),
        ),
        (
            ~captured,
            event("payment_failed", "pay_", d, gross, method=F.col("method"), counterparty=ident("ord_"),
                  detail=F.when(k % 3 == 0, "BAD_REQUEST").otherwise("GATEWAY_ERROR")),
        ),
        (
            captured & F.col("returned_on").isNotNull(),
            event("refund_issued", "rfnd_", F.col("returned_on"),
                  F.call_function("div", gross * 3, F.lit(10)), counterparty=pay,
                  detail=F.when(k % 2 == 0, "instant").otherwise("normal")),
        ),
        (
            captured & (k % 50 == 11),
            event("dispute_opened", "disp_", opened, half, known, counterparty=pay,
                  detail=F.when(k % 4 == 1, "goods_not_received").otherwise("fraudulent")),
        ),
        (
            captured & (k % 100 == 11),
            event("dispute_resolved", "disp_", F.date_add(d, 40), half, counterparty=pay, won=(k % 200 == 11)),
        ),
        (
            captured & (k % 400 == 23),
            event("risk_hold_applied", "hold_", F.date_add(d, 1), quarter,
                  detail=F.when(k % 3 == 0, "kyc_pending").otherwise("risk_review")),
        ),
        (captured & (k % 800 == 23), event("risk_hold_released", "hold_", F.date_add(d, 12), quarter)),
        (
            captured & (k % 60 == 17),
            event("route_transfer", "trf_", d, F.call_function("div", gross, F.lit(5)), counterparty=pay,
                  detail=F.concat(F.lit("acc_"), (k % 13).cast("string"))),
        ),
        (
            k % 150 == 31,
            event("gateway_adjustment", "adj_", F.date_add(d, 1), F.lit(35000), detail=F.lit("monthly minimum")),
        ),
        (
            k % 90 == 41,
            event("bank_charge_applied", "chg_", F.date_add(d, 2), 59000 + k % 1000,
                  narration=F.concat(F.lit("SMS ALERT CHRG "), key), value_date=F.date_add(d, 2)),
        ),
        (
            k % 120 == 53,
            event("bank_debit", "out_", F.date_add(d, 3), 100000 + k % 7777,
                  narration=F.concat(F.lit("VENDOR PAYMENT "), key), value_date=F.date_add(d, 3)),
        ),
    ]
    # the frequent kinds are a pass each, small enough to be compiled; the rare ones share one over the few orders that have any
    often, rare = made[:4], made[4:]
    out = None
    for when, row in often:
        one = facts.filter(when).select(row.alias("e")).select("e.*")
        out = one if out is None else out.unionByName(one)
    some = facts.filter(reduce(or_, [when for when, _ in rare]))
    rows = F.array(*[F.when(when, row) for when, row in rare])
    return out.unionByName(some.select(F.explode(rows).alias("e")).filter("e IS NOT NULL").select("e.*"))


def payouts_due(order_level: DataFrame, calendar: DataFrame) -> DataFrame:
    """What the gateway pays out per merchant and bank day, fixed-size sweeps split off."""
    due = daily_sums(order_level).filter("account = 'gateway_receivable'")
    settled_on = calendar.select(F.col("d").alias("occurred_at"), F.col("t2_actual").alias("day"))
    net = (
        due.join(F.broadcast(settled_on), "occurred_at")
        .groupBy("merchant_id", "day")
        .agg(F.sum("amount_paise").alias("net"))
        .filter("net > 0")
        .withColumn("n", F.datediff("day", F.lit("1994-01-01").cast("date")))
    )
    swept = (F.col("n") % 41).isin(0, 2) & (F.col("net") > SWEEP_PAISE + 1_000_000)
    parts = F.array(
        F.struct(
            F.lit("").alias("suffix"),
            (F.col("net") - F.when(swept, SWEEP_PAISE).otherwise(0)).alias("gross_out"),
        ),
        F.when(swept, F.struct(F.lit("b").alias("suffix"), F.lit(SWEEP_PAISE).cast("bigint").alias("gross_out"))),
    )
    out = (
        net.select("merchant_id", "day", "n", F.explode(parts).alias("p"))
        .filter("p IS NOT NULL")
        .select("merchant_id", "day", "n", "p.suffix", "p.gross_out")
    )
    instant = (F.col("n") % 11 == 5) & (F.col("suffix") == "")
    fee = F.when(instant, F.call_function("div", F.col("gross_out") * 2 + 500, F.lit(1000))).otherwise(0)
    stamp = F.date_format("day", "yyyyMMdd")
    merchant = F.substring("merchant_id", 2, 9)
    return out.select(
        "merchant_id",
        "day",
        "n",
        "suffix",
        (F.col("gross_out") - fee).cast("bigint").alias("net"),
        fee.cast("bigint").alias("fee"),
        F.concat(F.lit("setl_"), F.col("merchant_id"), F.lit("_"), stamp, F.col("suffix")).alias("settlement_id"),
        F.concat(
            stamp, F.lpad(merchant, 2, "0"),
            F.lpad((F.col("n") + F.when(F.col("suffix") == "b", 500000).otherwise(0)).cast("string"), 6, "0"),
        ).alias("utr"),
    )


def payout_events(payouts: DataFrame) -> DataFrame:
    """Executed payouts and the bank credits that answer them."""
    n = F.col("n")
    paid = event_row(
        merchant_id=F.col("merchant_id"), event_id=F.concat(F.lit("settlement_executed:"), F.col("settlement_id")),
        type=F.lit("settlement_executed"), occurred_at=F.col("day"), recorded_at=F.col("day"),
        entity_id=F.col("settlement_id"), amount_paise=F.col("net"), fee_paise=F.col("fee"),
        utr=F.col("utr"), currency=F.lit("INR"),
    )
    utr = F.col("utr")
    absent = F.lit("INWARD FROM GATEWAY")
    narration = (
        F.when(F.col("suffix") == "b", absent)
        .when(n % 5 == 0, F.concat(F.lit("GATEWAY DAY CLOSE "), utr))
        .when(n % 5 == 1, F.concat(F.lit("PAYOUT GATEWAY "), utr.substr(1, 8), F.lit("-"), utr.substr(9, 20)))
        .when(n % 5 == 2, F.concat(F.lit("SHORT SLIP "), utr.substr(1, 10)))
        .when(n % 5 == 3, absent)
        .otherwise(F.concat(F.lit("GATEWAY SLIP NO "), utr, F.lpad((n % 100).cast("string"), 2, "0")))
    )
    arrives = F.date_add("day", (n % 3).cast("int"))

    def credit(prefix: str, suffix: Column, amount: Column, text: Column) -> Column:
        name = F.concat(F.lit(prefix), F.col("merchant_id"), F.lit("_"), n.cast("string"), suffix)
        return event_row(
            merchant_id=F.col("merchant_id"), event_id=F.concat(F.lit("bank_credit_received:"), name),
            type=F.lit("bank_credit_received"), occurred_at=arrives, recorded_at=arrives, entity_id=name,
            amount_paise=amount, narration=text, currency=F.lit("INR"), value_date=arrives,
        )

    landed = (n % 37 != 0) | (F.col("suffix") == "b")
    stranger = (n % 53 == 7) & (F.col("suffix") == "")
    rows = F.array(
        paid,
        F.when(landed, credit("btx_", F.col("suffix"), F.col("net"), narration)),
        F.when(stranger, credit("bts_", F.lit(""), 1725000 + n, F.lit("SOME OTHER PAYER"))),
    )
    return payouts.select(F.explode(rows).alias("e")).filter("e IS NOT NULL").select("e.*")


def rate_changes(spark: SparkSession, folder: str) -> DataFrame:
    regions = _table(spark, folder, "region").select("r_regionkey")
    key = F.concat(F.lit("m"), F.col("r_regionkey"))
    day = F.lit("1998-07-01").cast("date")
    row = event_row(
        merchant_id=key, event_id=F.concat(F.lit("fee_schedule_changed:"), key), type=F.lit("fee_schedule_changed"),
        occurred_at=day, recorded_at=day, method=F.lit("card"), detail=F.lit("2.36"), currency=F.lit("INR"),
    )
    return regions.select(row.alias("e")).select("e.*")


@dataclass
class SampleLedger:
    """The sample ledger of one folder, each table written once per session and then scanned."""

    spark: SparkSession
    folder: str

    @cached_property
    def facts(self) -> DataFrame:
        """Written once: events, amounts and busy days read it several times."""
        return cut(order_facts(self.spark, self.folder), "order-facts")

    @cached_property
    def calendar(self) -> DataFrame:
        span = _table(self.spark, self.folder, "orders").agg(
            F.date_sub(F.to_date(F.min("o_orderdate")), 14).alias("lo"),
            F.date_add(F.to_date(F.max("o_orderdate")), 150).alias("hi"),
        )
        return cut(bank_calendar(span, yearly=SAMPLE_HOLIDAYS).coalesce(1), "calendar")

    @cached_property
    def from_orders(self) -> DataFrame:
        return cut(order_events(self.facts), "order-events")

    @cached_property
    def payouts(self) -> DataFrame:
        return cut(payouts_due(self.from_orders, self.calendar), "payouts")

    @cached_property
    def events(self) -> DataFrame:
        """Events of orders as written, those of payouts made on the fly from the few payout rows."""
        parts = self.from_orders.unionByName(payout_events(self.payouts))
        return parts.unionByName(rate_changes(self.spark, self.folder))

    @cached_property
    def covers(self) -> DataFrame:
        """Which payout settled which capture."""
        lands = self.calendar.select(F.col("d").alias("occurred_at"), F.col("t2_actual").alias("settled_on"))
        paid = self.payouts.filter("suffix = ''").select(
            "merchant_id", F.col("day").alias("settled_on"), "settlement_id", "utr"
        )
        captures = self.events.filter("type = 'payment_captured'").select(
            "merchant_id", "occurred_at", F.col("entity_id").alias("payment_id")
        )
        rows = captures.join(F.broadcast(lands), "occurred_at").join(paid, ["merchant_id", "settled_on"])
        return conform(rows.withColumn("recorded_at", F.col("settled_on")), COVERS)

    @cached_property
    def postings(self) -> DataFrame:
        return project(self.events)

    @cached_property
    def contracts(self) -> DataFrame:
        regions = _table(self.spark, self.folder, "region")
        pairs = [x for m, r in CONTRACT_RATES.items() for x in (F.lit(m), F.lit(r).cast("decimal(12,6)"))]
        return regions.select(
            F.concat(F.lit("m"), F.col("r_regionkey")).alias("merchant_id"),
            F.explode(F.create_map(*pairs)).alias("method", "rate"),
        )

    @cached_property
    def books(self) -> Books:
        """The ledger with its weekly windows."""
        return Books(self.events, self.calendar, self.contracts, cut(weekly_windows(self.events), "windows"))


    @cached_property
    def whole(self) -> Books:
        """The ledger with one window per merchant over its whole period."""
        return self.books.over(cut(whole_period(self.events), "period"))

    @cached_property
    def truth(self) -> DataFrame:
        """What was planted, labelled by cause: (merchant_id, occurred_at, recorded_at, cause, amount_paise)."""
        amount, zero = F.col("amount_paise"), F.lit(0).cast("bigint")
        fee = F.coalesce(F.col("fee_paise"), zero)
        contract = F.call_function("div", amount * 400 + 10000, F.lit(20000))

        def label(cause: str, value: Column) -> Column:
            return F.struct(F.lit(cause).alias("cause"), value.cast("bigint").alias("amount_paise"))

        by_type = {
            "payment_captured": [
                label("normal_fee", contract), label("fee_rate_increase", fee - contract),
                label("gst_on_fee", F.col("tax_paise")), label("tds_194o", F.col("tds_paise")),
            ],
            "refund_issued": [label("refunds_issued", amount)],
            "dispute_opened": [label("dispute_reserve_held", amount)],
            "dispute_resolved": [
                label("dispute_reserve_held", -amount),
                label("chargeback_lost", F.when(F.col("won"), zero).otherwise(amount)),
            ],
            "risk_hold_applied": [label("risk_hold", amount)],
            "risk_hold_released": [label("risk_hold", -amount)],
            "route_transfer": [label("route_split", amount)],
            "gateway_adjustment": [label("gateway_adjustment", amount)],
            "bank_charge_applied": [label("bank_charges", amount)],
            "bank_debit": [label("other_bank_outflow", amount)],
            "settlement_executed": [label("instant_settlement_fee", fee)],
        }
        rows = None
        for kind, labels in by_type.items():
            rows = F.when(F.col("type") == kind, F.array(*labels)) if rows is None else rows.when(
                F.col("type") == kind, F.array(*labels))
        planted = self.events.select("merchant_id", "occurred_at", "recorded_at", F.explode(rows).alias("t")).select(
            "merchant_id", "occurred_at", "recorded_at", "t.cause", "t.amount_paise"
        )
        lost = self.payouts.filter("suffix = '' AND n % 37 = 0").select(
            "merchant_id", F.col("day").alias("occurred_at"), F.col("day").alias("recorded_at"),
            F.lit("settlement_never_arrived").alias("cause"), F.col("net").alias("amount_paise"),
        )
        return planted.unionByName(lost).filter("amount_paise <> 0")

    @cached_property
    def timing(self) -> DataFrame:
        """When each capture was due and when it really settled, less what was split off it."""
        days = self.calendar.select(F.col("d").alias("captured_on"), "t2_naive", "t2_actual")
        split = F.when(F.col("k") % 60 == 17, F.call_function("div", F.col("gross"), F.lit(5))).otherwise(0)
        net = F.col("gross") - F.col("fee") - F.col("tax") - F.col("tds") - split
        return (
            self.facts.filter("captured")
            .select("merchant_id", F.col("d").alias("captured_on"), net.alias("net_paise"))
            .join(F.broadcast(days), "captured_on")
        )

    @cached_property
    def truth_links(self) -> DataFrame:
        """The payout each bank credit really came from."""
        landed = (F.col("n") % 37 != 0) | (F.col("suffix") == "b")
        name = F.concat(F.lit("btx_"), F.col("merchant_id"), F.lit("_"), F.col("n").cast("string"), F.col("suffix"))
        return self.payouts.filter(landed).select("merchant_id", name.alias("bank_txn_id"), "settlement_id")


    @cached_property
    def outlook(self) -> Outlook:
        """Forecasts every four weeks over the next fortnight."""
        origins = cut(rolling_origins(self.events, warmup=60, step=28, horizon=14), "origins")
        return Outlook(self.books, self.covers, origins, horizon=14)

    @cached_property
    def deliveries(self) -> DataFrame:
        """Everything delivered once, captures and payouts twice."""
        return with_digest(self._delivered)

    @cached_property
    def _delivered(self) -> DataFrame:
        return self.events.unionByName(self.events.filter("type IN ('payment_captured', 'settlement_executed')"))

    @cached_property
    def log(self) -> DataFrame:
        return record(self._delivered)

    @cached_property
    def chain(self) -> DataFrame:
        return cut(chain(self.log), "chain")

    @cached_property
    def statement_lines(self) -> DataFrame:
        """A bank statement per merchant and month: an opening balance, then its movements.

        Some lines print no balance and some a wrong one.
        """
        opening = F.lit(100_000_000).cast("bigint")
        bank = self.events.filter("type IN ('bank_credit_received', 'bank_charge_applied', 'bank_debit')")
        into = F.col("type") == "bank_credit_received"
        rows = bank.select(
            F.concat_ws("-", "merchant_id", F.date_format("occurred_at", "yyyyMM")).alias("file"),
            F.col("occurred_at").alias("txn_date"), F.col("occurred_at").alias("value_date"), "narration", "entity_id",
            F.when(into, 0).otherwise(F.col("amount_paise")).cast("bigint").alias("debit_paise"),
            F.when(into, F.col("amount_paise")).otherwise(0).cast("bigint").alias("credit_paise"),
        )
        order = Window.partitionBy("file").orderBy("txn_date", "entity_id")
        line = F.row_number().over(order) + 1
        running = opening + F.sum(F.col("credit_paise") - F.col("debit_paise")).over(order)
        rows = rows.withColumn("line", line.cast("bigint")).withColumn("running", running)
        shown = F.when(F.col("line") % 7 != 3, F.col("running") + F.when(F.col("line") % 13 == 5, 100).otherwise(0))
        rows = rows.withColumn("balance_paise", shown).withColumn("opening", F.lit(False))
        first = rows.select("file").distinct().select(
            "file", F.lit(1).cast("bigint").alias("line"), opening.alias("balance_paise"), F.lit(True).alias("opening"))
        return rows.drop("running").unionByName(first, allowMissingColumns=True)

    @cached_property
    def window_fees(self) -> DataFrame:
        return causes.window_fees(self.books)

    @cached_property
    def invoices(self) -> DataFrame:
        """Returns filed for each window: most in full, some short, some not at all, some by nobody real."""
        tax = self.window_fees.groupBy("merchant_id", "window_id").agg(F.sum("tax_paise").alias("tax"), F.sum("fee_paise").alias("fee"))
        w, zero = F.col("window_id"), F.lit(0).cast("bigint")
        filed = F.col("tax") - F.when(w % 7 == 3, 1000).otherwise(0)
        half = F.call_function("div", filed, F.lit(2))
        number = F.concat(F.lit("G"), w.cast("string"))

        def row(gstin: Column, tag: str, taxable: Column, igst: Column, cgst: Column, sgst: Column) -> Column:
            return F.struct(
                gstin.alias("supplier_gstin"), F.lit(tag).alias("supplier_name"), F.concat(F.lit(tag), number).alias("invoice_no"),
                taxable.cast("bigint").alias("taxable_paise"), igst.cast("bigint").alias("igst_paise"),
                cgst.cast("bigint").alias("cgst_paise"), sgst.cast("bigint").alias("sgst_paise"), zero.alias("cess_paise"))

        gstin = F.when(w % 2 == 0, GATEWAY_GSTIN.lower()).otherwise(GATEWAY_GSTIN)
        rows = F.array(
            F.when(w % 5 != 0, row(gstin, "GATEWAY", F.col("fee"), zero, half, filed - half)),
            F.when(w % 6 == 1, row(F.lit("29XXXXX9999X9X9"), "NOBODY", F.lit(100000), 18000 + w, zero, zero)),
        )
        return tax.select("merchant_id", "window_id", F.explode(rows).alias("i")).filter("i IS NOT NULL").select(
            "merchant_id", "window_id", "i.*")

    @cached_property
    def form_26as(self) -> DataFrame:
        """TDS the tax office shows for most windows, a little short for every third."""
        tds = self.window_fees.groupBy("merchant_id", "window_id").agg(F.sum("tds_paise").alias("tds"))
        w = F.col("window_id")
        return tds.filter(w % 4 != 2).select(
            "merchant_id", "window_id", (F.col("tds") - F.when(w % 3 == 0, 500).otherwise(0)).alias("amount_paise"))

    @cached_property
    def texts(self) -> DataFrame:
        """The memos of all windows; every ninth quotes a gap that is not the verified one."""
        wrong = money_text(F.col("gap_paise") + 12345)
        gaps = variance(self.books.moves, self.books.windows).select("merchant_id", "window_id", "gap_paise")
        spoiled = F.concat(F.substring_index("text", "; still out ", 1), F.lit("; still out "), wrong, F.lit("."))
        return memos(self.books).join(gaps, ["merchant_id", "window_id"]).select(
            "merchant_id", "window_id", F.when(F.col("window_id") % 9 == 4, spoiled).otherwise(F.col("text")).alias("text"))


def busy_days(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(credits, payouts) of merchants that are paid out order by order: all orders within twelve days, hundreds to many thousands a day."""
    k = F.col("k")
    utr = F.concat(F.lpad(((k * 7919 + 13) % 100_000_000).cast("string"), 8, "0"), F.lpad(k.cast("string"), 8, "0"))
    day = F.date_add(F.lit("2000-01-03").cast("date"), (k % 12).cast("int"))
    paid = facts.select(
        "merchant_id", F.concat(F.lit("set_"), k.cast("string")).alias("settlement_id"), utr.alias("utr"), F.col("gross").alias("amount_paise"),
        day.alias("occurred_at"), day.alias("recorded_at"), F.lit(0).cast("bigint").alias("fee_paise"))
    style, came = k % 5, F.date_add(day, (k % 4).cast("int"))
    narration = (
        F.when(style == 0, F.concat(F.lit("NEFT "), utr)).when(style == 1, F.concat(F.lit("UPI/"), F.left(utr, F.lit(8)), F.lit("-"), F.substring(utr, 9, 8)))
        .when(style == 2, F.concat(F.lit("IMPS "), F.left(utr, F.lit(11)))).otherwise(F.lit("FUND TRANSFER"))
    )
    credits = facts.filter(k % 10 != 7).select(
        "merchant_id", F.concat(F.lit("cr_"), k.cast("string")).alias("bank_txn_id"), F.col("gross").alias("amount_paise"),
        came.alias("occurred_at"), came.alias("recorded_at"), narration.alias("narration"))
    return credits, paid


_known: dict[tuple[str, str], SampleLedger] = {}


def sample_ledger(spark: SparkSession, folder: str) -> SampleLedger:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _known:
        _known[key] = SampleLedger(spark, folder)
    return _known[key]
