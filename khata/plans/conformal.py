"""Floors that hold a stated share of the time, from how far earlier forecasts overshot."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.operators.ranking import earlier_order_statistic, rank_in_group

# Share of breaches allowed, step of the adaptive rule, its bounds, and
# when a model counts as in distress.
ALPHA = 0.10
GAMMA = 0.02
LEAST, MOST = 1e-4, 0.999
MAX_DISCOUNT = 0.25
RECENT_WINDOWS = 12


def over_forecast(forecast: Column, actual: Column) -> Column:
    return F.when(forecast <= 0, F.lit(0.0)).otherwise((forecast - actual) / forecast)


def split_floors(outcomes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """A floor per window from the scores of the merchant's earlier windows.

    Earlier scores are counted by rank, so a window holds none of them, however many its merchant has.
    """
    scored = outcomes.filter("forecast_paise <> 0").withColumn(
        "score", over_forecast(F.col("forecast_paise"), F.col("actual_paise"))
    )
    scored = rank_in_group(scored, ["merchant_id"], [F.col("as_of")], "n").withColumn("n", (F.col("n") - 1).cast("int"))
    rank = F.least(F.ceil((F.col("n") + 1) * F.lit(1 - alpha)).cast("int"), F.col("n"))
    seen = earlier_order_statistic(scored.withColumn("rank", rank), ["merchant_id"], [F.col("as_of")], "score", "rank", "discount")
    n, quantile = F.col("n"), F.coalesce("discount", F.lit(0.0))
    floor = F.greatest(F.lit(0), (F.col("forecast_paise") * (1 - quantile)).cast("bigint"))
    return seen.select(
        "merchant_id", "as_of", "forecast_paise", "actual_paise", n.alias("calibrated_on"),
        floor.alias("floor_paise"), (n >= math.ceil(1 / alpha) - 1).alias("certified"),
    ).withColumn("held", F.col("actual_paise") >= F.col("floor_paise"))


def quantile(scores: list[float], alpha: float) -> float:
    if not scores:
        return 0.0
    ordered = sorted(scores)
    rank = math.ceil((len(ordered) + 1) * (1 - alpha))
    return ordered[min(rank, len(ordered)) - 1]


def observe(state: dict, forecast: int, actual: int, alpha: float = ALPHA, gamma: float = GAMMA) -> dict:
    """One window through the adaptive rule: its floor, and the state that the next one sees."""
    scores, level, recent = state["scores"], state["level"], state["recent"]
    floor = max(0, int(forecast * (1 - quantile(scores, min(max(level, LEAST), MOST)))))
    breached = actual < floor
    n = len(scores)
    level = min(max(level + gamma * (alpha - breached), LEAST), MOST)
    scores = [*scores, 0.0 if forecast <= 0 else (forecast - actual) / forecast]
    recent = [*recent, bool(breached)][-RECENT_WINDOWS:]
    discount = quantile(scores, min(max(level, LEAST), MOST))
    distress = len(scores) >= RECENT_WINDOWS and (
        discount > MAX_DISCOUNT or sum(recent) / len(recent) > alpha * 2)
    row = {"floor": floor, "n": n, "held": not breached, "level": level, "discount": discount, "distress": distress}
    return {"scores": scores, "level": level, "recent": recent, "row": row}


ADAPTIVE = (
    "merchant_id string, as_of date, forecast_paise bigint, actual_paise bigint, calibrated_on int, floor_paise bigint, "
    "certified boolean, held boolean, level double, discount double, in_distress boolean"
)


def start_state(alpha: float = ALPHA) -> dict:
    return {"scores": [], "level": alpha, "recent": []}


def adaptive_floors(outcomes: DataFrame, alpha: float = ALPHA, gamma: float = GAMMA) -> DataFrame:
    """Floors whose level moves with every breach. The next floor depends on the last one, so
    a merchant's windows go through in order; merchants run side by side."""
    least = math.ceil(1 / alpha) - 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start_state(alpha), []
        for row in pdf.sort_values("as_of").itertuples():
            state = observe(state, int(row.forecast_paise), int(row.actual_paise), alpha, gamma)
            told = state["row"]
            out.append((row.merchant_id, row.as_of, row.forecast_paise, row.actual_paise, told["n"], told["floor"],
                        told["n"] >= least, told["held"], told["level"], told["discount"], told["distress"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ADAPTIVE.split(", ")])

    columns = ["merchant_id", "as_of", "forecast_paise", "actual_paise"]
    return outcomes.filter("forecast_paise <> 0").select(*columns).groupBy("merchant_id").applyInPandas(run, ADAPTIVE)


def coverage(floors: DataFrame, method: str, horizon: int, step: int, alpha: float = ALPHA) -> DataFrame:
    """Per merchant: how often certified floors held, how tight they were, how many windows do not overlap."""
    sure = floors.filter("certified").groupBy("merchant_id").agg(
        F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("breached"),
        F.sum("floor_paise").alias("floor_paise"), F.sum("actual_paise").alias("actual_paise"),
    )
    overlap = max(1, horizon // max(step, 1))
    n = F.col("held") + F.col("breached")
    return _rates(sure.withColumn("independent", F.greatest(F.lit(1), F.floor(n / overlap))), alpha).withColumn("method", F.lit(method))


def pooled(covered: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The same over all merchants."""
    sums = covered.groupBy("method").agg(
        *[F.sum(c).alias(c) for c in ("held", "breached", "floor_paise", "actual_paise", "independent")])
    return _rates(sums, alpha)


def _rates(sums: DataFrame, alpha: float) -> DataFrame:
    n = F.col("held") + F.col("breached")
    share = F.when(n == 0, F.lit(0.0)).otherwise(F.col("held") / n)
    tight = F.when(F.col("actual_paise") == 0, F.lit(0.0)).otherwise(F.col("floor_paise") / F.col("actual_paise"))
    return (
        sums.withColumn("empirical", F.round(share, 6)).withColumn("tightness", F.round(tight, 6))
        .withColumn("meets_target", share >= 1 - alpha)
    )
