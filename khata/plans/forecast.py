"""What will land in the bank, as seen from any number of days at once.

``origins`` has (merchant_id, as_of); every step carries as_of in its keys, so one plan
answers all origins. Facts are first summed per merchant and day; an interval such as
"captured, not settled" then becomes a plus on one day and a minus on another, or is
spread over the few days it can last.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.money import ratio_half_up
from khata.lineage import cut
from khata.operators.apportion import allocate
from khata.operators.linkage import payouts_not_linked
from khata.plans.books import Books

# Days of history that shape the forecast, its half-life, days until an
# unlinked payout is written off, and the settlement lag in bank days.
LOOKBACK_DAYS = 45
HALF_LIFE_DAYS = 45.0
STALE_DAYS = 3
LAG_DAYS = 2
ORIGIN = ["merchant_id", "as_of"]


def _total(when: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0))


@dataclass
class Outlook:
    """Forecasts of ``books`` from each of ``origins`` over ``horizon`` days."""

    books: Books
    covers: DataFrame
    origins: DataFrame
    horizon: int = 14
    half_life: float = HALF_LIFE_DAYS

    @cached_property
    def flow(self) -> DataFrame:
        """Captured, deducted and landed per merchant and both clocks."""
        e = self.books.events
        kind, amount = F.col("type"), F.col("amount_paise")
        taken = kind == "payment_captured"
        fees = F.coalesce("fee_paise", F.lit(0)) + F.coalesce("tax_paise", F.lit(0)) + F.coalesce("tds_paise", F.lit(0))
        return cut(
            e.filter(kind.isin("payment_captured", "refund_issued", "dispute_opened", "bank_credit_received"))
            .groupBy("merchant_id", "occurred_at", "recorded_at")
            .agg(
                F.count_if(taken).alias("captures"),
                _total(taken, amount).alias("gross"),
                _total(taken, fees).alias("fees"),
                _total(kind.isin("refund_issued", "dispute_opened"), amount).alias("deductions"),
                _total(kind == "bank_credit_received", amount).alias("landed"),
            ),
            "flow",
        )

    @cached_property
    def recent(self) -> DataFrame:
        """The days each origin learns from, as it knew them."""
        first = F.greatest("occurred_at", "recorded_at")
        last = F.date_add("occurred_at", LOOKBACK_DAYS)
        seen = self.flow.filter(first <= last).withColumn("as_of", F.explode(F.sequence(first, last)))
        return seen.join(self.origins.select(*ORIGIN), ORIGIN).groupBy(*ORIGIN, "occurred_at").agg(
            *[F.sum(c).alias(c) for c in ("captures", "gross", "fees", "deductions", "landed")]
        )

    @cached_property
    def rates(self) -> DataFrame:
        """Totals of the lookback; fee, deduction and realisation rates are ratios of them."""
        sums = self.recent.groupBy(*ORIGIN).agg(
            *[F.sum(c).alias(c) for c in ("gross", "fees", "deductions", "landed")]
        )
        out = self.origins.select(*ORIGIN).join(sums, ORIGIN, "left")
        for name in ("gross", "fees", "deductions", "landed"):
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
        return out.withColumn("implied", F.col("gross") - F.col("fees") - F.col("deductions"))

    @cached_property
    def weekdays(self) -> DataFrame:
        """Typical gross per weekday, recent days weighing more."""
        weight = F.pow(F.lit(0.5), F.datediff("as_of", "occurred_at") / F.lit(self.half_life))
        return (
            self.recent.filter("captures > 0")
            .withColumn("w", weight)
            .groupBy(*ORIGIN, F.weekday("occurred_at").alias("weekday"))
            .agg(F.floor(F.sum(F.col("w") * F.col("gross")) / F.sum("w") + 0.5).cast("bigint").alias("typical"))
        )

    @cached_property
    def capture_flow(self) -> DataFrame:
        """Net of captures by the day they became known, the day they land and the day they were seen settled."""
        settled = self.covers.groupBy("merchant_id", "payment_id").agg(
            F.min(F.greatest("settled_on", F.coalesce("recorded_at", "settled_on"))).alias("settled_known")
        )
        days = self.books.calendar.select(F.col("d").alias("occurred_at"), F.col("t2_actual").alias("lands"))
        net = F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise") - F.col("tds_paise")
        return cut(
            self.books.priced.select(
                "merchant_id", "payment_id", "occurred_at", F.greatest("occurred_at", "recorded_at").alias("known_from"),
                net.alias("net"))
            .join(settled, ["merchant_id", "payment_id"], "left")
            .join(F.broadcast(days), "occurred_at")
            .groupBy("merchant_id", "known_from", "settled_known", "lands")
            .agg(F.sum("net").alias("net")),
            "capture-flow",
        )

    def _at_origins(self, changes: DataFrame) -> DataFrame:
        """Running total of daily changes (merchant_id, day, delta) at each origin."""
        daily = changes.groupBy("merchant_id", "day").agg(F.sum("delta").alias("delta"))
        marks = self.origins.select("merchant_id", F.col("as_of").alias("day"), F.lit(0).cast("bigint").alias("delta"), F.lit(True).alias("mark"))
        # one row per day and merchant at most, plus the origins
        order = Window.partitionBy("merchant_id").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        both = daily.withColumn("mark", F.lit(False)).unionByName(marks)
        return both.withColumn("running", F.sum("delta").over(order)).filter("mark").select(
            "merchant_id", F.col("day").alias("as_of"), "running"
        )

    @cached_property
    def overdue(self) -> DataFrame:
        """Captures that should have settled by the origin and were not seen to."""
        starts = F.greatest("known_from", "lands")
        open_ended = F.coalesce("settled_known", F.lit("9999-12-31").cast("date"))
        late = self.capture_flow.filter(starts < open_ended)
        ups = late.select("merchant_id", starts.alias("day"), F.col("net").alias("delta"))
        downs = late.filter("settled_known IS NOT NULL").select(
            "merchant_id", F.col("settled_known").alias("day"), (-F.col("net")).alias("delta"))
        return self._at_origins(ups.unionByName(downs)).withColumnRenamed("running", "overdue_paise")

    @cached_property
    def captured_pending(self) -> DataFrame:
        """Captured and unsettled at the origin, by the day it lands."""
        until = F.date_sub(F.least("lands", F.coalesce("settled_known", "lands")), 1)
        waiting = self.capture_flow.filter(F.col("known_from") <= until)
        spread = waiting.withColumn("as_of", F.explode(F.sequence("known_from", until)))
        return spread.join(self.origins.select(*ORIGIN), ORIGIN).groupBy(*ORIGIN, F.col("lands").alias("day")).agg(
            F.sum("net").alias("net"))

    @cached_property
    def unlinked_then(self) -> DataFrame:
        """Payouts that were open at an origin for which the final links did not hold yet."""
        history = self.books.history
        known = F.greatest("occurred_at", "recorded_at")
        waiting = self.books.payouts.join(history.settled, ["merchant_id", "settlement_id"]).filter(known < F.col("settled"))
        asked = waiting.withColumn("as_of", F.explode(F.sequence(known, F.date_sub("settled", 1)))).join(self.origins.select(*ORIGIN), ORIGIN)
        asked = cut(asked.withColumn("known_by", F.col("as_of")).drop("settled"), "asked")
        links, _, paid = history.relinked(asked, ORIGIN)
        unlinked = payouts_not_linked(paid, links, ORIGIN).select(*ORIGIN, "settlement_id")
        return cut(asked.join(unlinked, [*ORIGIN, "settlement_id"], "left_semi"), "unlinked")

    @cached_property
    def written_off(self) -> DataFrame:
        """Payouts older than a few days that nothing links to: gone unless proven otherwise."""
        unsettled = (
            self.unlinked_then.filter(F.datediff("as_of", "occurred_at") > STALE_DAYS)
            .groupBy(*ORIGIN).agg(F.sum("amount_paise").alias("unsettled"))
        )
        given_up = F.greatest("settled", F.date_add("occurred_at", STALE_DAYS + 1))
        ups = self.books.history.unlinked.select("merchant_id", given_up.alias("day"), F.col("amount_paise").alias("delta"))
        total = self._at_origins(ups).join(unsettled, ORIGIN, "left")
        return total.select(*ORIGIN, (F.col("running") + F.coalesce("unsettled", F.lit(0))).alias("written_off_paise"))

    @cached_property
    def pending(self) -> DataFrame:
        """Money already on its way at the origin, by the day it should land."""
        tomorrow = self.books.calendar.select(F.date_sub("d", 1).alias("as_of"), F.col("next_open").alias("day"))
        last = F.date_add("occurred_at", STALE_DAYS)
        fresh = self.books.history.unlinked.filter(F.col("settled") <= last).withColumn("as_of", F.explode(F.sequence("settled", last)))
        young = self.unlinked_then.filter(F.col("as_of") <= last).select(*ORIGIN, "amount_paise").unionByName(
            fresh.join(self.origins.select(*ORIGIN), ORIGIN).select(*ORIGIN, "amount_paise"))
        paid = young.join(F.broadcast(tomorrow), "as_of").select(*ORIGIN, "day", F.col("amount_paise").alias("net"))
        return self.captured_pending.unionByName(paid).groupBy(*ORIGIN, "day").agg(F.sum("net").alias("net"))

    def _realised(self, amount: Column) -> Column:
        short = (F.col("implied") > 0) & (F.col("landed") < F.col("implied"))
        return F.when(short, ratio_half_up(amount, F.col("landed"), F.col("implied"))).otherwise(amount)

    def _less(self, amount: Column, rate: str) -> Column:
        return amount - F.when(F.col("gross") == 0, F.lit(0)).otherwise(ratio_half_up(amount, F.col(rate), F.col("gross")))

    @cached_property
    def days(self) -> DataFrame:
        """Per origin and day ahead: what is committed, what is projected, and their sum."""
        ahead = self.origins.select(*ORIGIN, F.explode(F.sequence(F.lit(1), F.lit(self.horizon))).alias("ahead"))
        ahead = ahead.withColumn("day", F.expr("date_add(as_of, ahead)"))
        calendar = self.books.calendar.select(F.col("d").alias("day"), "is_bank_day", "t2_actual")
        ahead = ahead.join(F.broadcast(calendar), "day")
        shaped = (
            ahead.withColumn("weekday", F.weekday("day"))
            .join(self.weekdays, [*ORIGIN, "weekday"])
            .join(self.rates, ORIGIN)
            .withColumn("_a", self._less(F.col("typical"), "fees"))
            .withColumn("_b", self._less(F.col("_a"), "deductions"))
            .withColumn("_c", self._realised(F.col("_b")))
            .groupBy(*ORIGIN, F.col("t2_actual").alias("day"))
            .agg(F.sum("_c").alias("projected_paise"))
        )
        committed = (
            self.pending.join(self.rates, ORIGIN)
            .withColumn("_a", self._less(F.col("net"), "deductions"))
            .select(*ORIGIN, "day", self._realised(F.col("_a")).alias("committed_paise"))
        )
        out = (
            ahead.select(*ORIGIN, "day", "is_bank_day")
            .join(committed, [*ORIGIN, "day"], "left")
            .join(shaped, [*ORIGIN, "day"], "left")
        )
        for name in ("committed_paise", "projected_paise"):
            # nothing lands while the bank is shut
            out = out.withColumn(name, F.when(F.col("is_bank_day"), F.coalesce(F.col(name), F.lit(0))).otherwise(F.lit(0)))
        return out.withColumn("expected_paise", F.col("committed_paise") + F.col("projected_paise"))

    @cached_property
    def totals(self) -> DataFrame:
        sums = self.days.groupBy(*ORIGIN).agg(
            *[F.sum(c).alias(c) for c in ("committed_paise", "projected_paise", "expected_paise")])
        return sums.join(self.overdue, ORIGIN, "left").join(self.written_off, ORIGIN, "left")

    def through(self) -> DataFrame:
        """Expected cash up to each day ahead."""
        order = Window.partitionBy(*ORIGIN).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.days.select(*ORIGIN, "day", F.sum("expected_paise").over(order).alias("through_paise"))

    @cached_property
    def outcomes(self) -> DataFrame:
        """Forecast of the whole horizon against what really landed in it."""
        landed = self.flow.groupBy("merchant_id", "occurred_at").agg(F.sum("landed").alias("landed"))
        ahead = self.origins.select(*ORIGIN, F.explode(
            F.sequence(F.date_add("as_of", 1), F.date_add("as_of", self.horizon))).alias("occurred_at"))
        actual = ahead.join(landed, ["merchant_id", "occurred_at"], "left").groupBy(*ORIGIN).agg(
            F.coalesce(F.sum("landed"), F.lit(0)).alias("actual_paise"))
        forecast = self.days.groupBy(*ORIGIN).agg(F.sum("expected_paise").alias("forecast_paise"))
        return forecast.join(actual, ORIGIN).withColumn("error_paise", F.col("actual_paise") - F.col("forecast_paise"))

    # --- why a forecast was wrong ---------------------------------------------------------

    def error_causes(self) -> DataFrame:
        """What pushed each outcome off its forecast: (as_of, cause, amount)."""
        calendar = self.books.calendar.select(F.col("d").alias("occurred_at"), "t2_naive", "t2_actual")
        taken = (
            self.books.priced.join(F.broadcast(calendar), "occurred_at")
            .groupBy("merchant_id", "t2_naive", "t2_actual")
            .agg(
                F.sum("amount_paise").alias("gross_landing"),
                F.sum(F.col("fee_paise") - F.col("contract_paise")).alias("overcharge"),
                F.sum(F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise") - F.col("tds_paise")).alias("net"),
            )
        )
        last = F.date_add("as_of", self.horizon)
        days_ahead = self.origins.select(*ORIGIN, F.explode(F.sequence(F.date_add("as_of", 1), last)).alias("day"))
        landing = taken.withColumnRenamed("t2_actual", "day").join(days_ahead, ["merchant_id", "day"]).groupBy(*ORIGIN).agg(
            F.sum("gross_landing").alias("gross_landing"), F.sum("overcharge").alias("overcharge"))
        held = (
            taken.withColumnRenamed("t2_naive", "day").join(days_ahead, ["merchant_id", "day"])
            .filter(F.col("t2_actual") > F.date_add("as_of", self.horizon))
            .groupBy(*ORIGIN).agg(F.sum("net").alias("held"))
        )
        kind, amount = F.col("event_type"), F.col("amount_paise")
        seen = (
            self.books.daily.withColumnRenamed("occurred_at", "day").join(days_ahead, ["merchant_id", "day"])
            .groupBy(*ORIGIN)
            .agg(
                _total((kind == "refund_issued") & (F.col("account") == "refunds"), amount).alias("refunds"),
                _total((kind == "dispute_opened") & (F.col("account") == "dispute_reserve"), amount).alias("disputes"),
                (-_total(F.col("account") == "on_hold", amount)).alias("released"),
            )
        )
        every = self.rates.join(landing, ORIGIN, "left").join(held, ORIGIN, "left").join(seen, ORIGIN, "left")
        for name in ("gross_landing", "overcharge", "held", "refunds", "disputes", "released"):
            every = every.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
        modelled = F.when(F.col("gross") == 0, F.lit(0)).otherwise(
            ratio_half_up(F.col("gross_landing"), F.col("deductions"), F.col("gross")))
        every = every.withColumn("surprise", F.col("refunds") + F.col("disputes") - modelled)
        simple = every.select(*ORIGIN, F.explode(F.array(
            F.struct(F.lit("fee_rate_increase").alias("cause"), (-F.col("overcharge")).alias("amount_paise")),
            F.struct(F.lit("bank_holiday_delay").alias("cause"), (-F.col("held")).alias("amount_paise")),
            F.struct(F.lit("risk_hold").alias("cause"), F.col("released").alias("amount_paise")),
        )).alias("c")).select(*ORIGIN, "c.cause", "c.amount_paise")
        weights = every.filter("surprise <> 0 AND refunds + disputes <> 0").select(*ORIGIN, "surprise", F.explode(F.array(
            F.struct(F.lit(0).alias("index"), F.lit("refunds_issued").alias("cause"), F.col("refunds").alias("weight")),
            F.struct(F.lit(1).alias("index"), F.lit("dispute_reserve_held").alias("cause"), F.col("disputes").alias("weight")),
        )).alias("c")).select(*ORIGIN, "surprise", "c.index", "c.cause", "c.weight").filter("weight <> 0")
        split = allocate(weights, ORIGIN, "surprise", "weight", "index").select(
            *ORIGIN, "cause", (-F.col("share_paise")).alias("amount_paise"))
        return simple.unionByName(split).filter("amount_paise <> 0")


def rolling_origins(events: DataFrame, warmup: int, step: int, horizon: int) -> DataFrame:
    """Every ``step`` days from ``warmup`` days in, while a whole horizon is left to compare with."""
    span = events.groupBy("merchant_id").agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    first, last = F.date_add("lo", warmup), F.date_sub("hi", horizon)
    return span.filter(first <= last).select(
        "merchant_id", F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step} DAY"))).alias("as_of")
    )


def calibration_origins(as_of: DataFrame, lookback: int = 140, horizon: int = 14) -> DataFrame:
    """Origins a horizon apart whose windows all end by ``as_of`` (merchant_id, as_of)."""
    first = F.date_sub("as_of", lookback)
    last = F.date_sub("as_of", horizon)
    return as_of.select(
        "merchant_id", F.explode(F.sequence(first, last, F.expr(f"INTERVAL {horizon} DAY"))).alias("as_of")
    )


def backtest(outcomes: DataFrame) -> DataFrame:
    """How good the forecasts of each merchant were."""
    error, actual = F.col("error_paise"), F.col("actual_paise")
    off = F.when(actual != 0, F.abs(error) / F.abs(actual))
    return outcomes.groupBy("merchant_id").agg(
        F.count("*").alias("windows"),
        F.round(F.coalesce(F.avg(off), F.lit(0.0)), 6).alias("mape"),
        F.sum(error).alias("bias_paise"),
        F.round(F.when(F.sum(actual) != 0, -F.sum(error) / F.sum(actual)).otherwise(F.lit(0.0)), 6).alias("optimism"),
        F.count_if(error < 0).alias("days_short"),
    )


def worst(outcomes: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("merchant_id").orderBy(F.abs("error_paise").desc(), "as_of")
    return outcomes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
