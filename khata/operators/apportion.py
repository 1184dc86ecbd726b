"""Splitting an amount by weights so that the parts add up exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.operators.ranking import rank_in_group


def allocate(rows: DataFrame, group: list[str], amount: str, weight: str, index: str, big_groups: bool = False) -> DataFrame:
    """Adds ``share_paise``: largest remainders get the left-over paise, ties go to the highest index.

    ``amount`` is the same on all rows of a group. A group whose weights sum to zero can
    only be given a zero amount. Set ``big_groups`` where one group may not fit a task.
    """
    wide = "decimal(38,0)"
    own = Window.partitionBy(*group)
    if big_groups:
        out = rows.join(rows.groupBy(*group).agg(F.sum(weight).cast("decimal(19,0)").alias("_all")), group)
    else:  # sums beside the rows, from the sort that ranks them too; a null group is none, as in the joins
        out = rows.dropna(subset=group).withColumn("_all", F.sum(weight).over(own).cast("decimal(19,0)"))
    size = F.abs(amount).cast("decimal(19,0)")
    product = (size * F.col(weight).cast("decimal(19,0)")).cast(wide)
    whole = F.when(F.col("_all") == 0, F.lit(0)).otherwise(F.call_function("div", product, F.col("_all").cast(wide)))
    out = out.withColumn("_share", whole.cast("bigint")).withColumn(
        "_rest", F.when(F.col("_all") == 0, F.lit(0)).otherwise(product % F.col("_all").cast(wide)).cast(wide)
    )
    # the group's own size is used up to this many paise short
    if big_groups:
        out = out.join(out.groupBy(*group).agg(F.sum("_share").alias("_given")), group)
    else:
        out = out.withColumn("_given", F.sum("_share").over(own))
    order = [F.col("_rest").desc(), F.col(index).desc()]
    if big_groups:
        out = rank_in_group(out, group, order, "_turn")
    else:
        out = out.withColumn("_turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    left = F.abs(amount) - F.col("_given")
    share = F.col("_share") + F.when(F.col("_turn") <= left, 1).otherwise(0)
    signed = F.when(F.col(amount) < 0, -share).otherwise(share)
    impossible = (F.col("_all") == 0) & (F.col(amount) != 0) | (F.col(weight) < 0)
    checked = F.when(impossible, F.raise_error(F.lit("cannot apportion by these weights"))).otherwise(signed)
    return out.withColumn("share_paise", checked.cast("bigint")).drop("_all", "_share", "_rest", "_given", "_turn")
