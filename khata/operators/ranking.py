"""Ranks inside groups that may be far too big for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.lineage import cut

# Rows of a shuffle's partition, beyond which there are more partitions: the memory of a task stays what it is.
PART_ROWS = 500_000
# A row id of ``monotonically_increasing_id`` is the partition's number above this many bits of the row's place in it.
PLACE_BITS = 33


def parts_for(rows: int, spark: SparkSession) -> int:
    """Partitions for so many rows: those of the session, and more where they would grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def _placed(df: DataFrame, group: list[str], order: list, parts: int | None) -> DataFrame:
    """``df`` in range partitions by (group, order), so that a big group spans many of them.

    Written out, so that partition numbers stay what they are when a task is run again.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
    return cut(placed.withColumn("_part", F.spark_partition_id()), "placed")


def running_sum(
    df: DataFrame, group: list[str], order: list, value: str, into: str, parts: int | None = None
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, without sorting one group in one task.

    Each partition sums its own piece and adds what the group's earlier partitions hold.
    ``order`` must be unique within a group.
    """
    placed = _placed(df, group, order, parts)
    pieces = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = pieces.select(*group, "_part", F.coalesce(F.sum("_size").over(earlier), zero).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_local", F.coalesce(F.sum(value).over(inside), zero))
        .join(offsets, [*group, "_part"])
        .withColumn(into, F.col("_local") + F.col("_before"))
        .drop("_part", "_local", "_before")
    )


def rank_in_group(
    df: DataFrame, group: list[str], order: list, into: str = "rank", parts: int | None = None
) -> DataFrame:
    """``row_number`` per group for groups of any size."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g) for g in group], *order]
    return rank_placed(df.repartitionByRange(parts, *by).sortWithinPartitions(*by), group, into)


def rank_placed(df: DataFrame, group: list[str], into: str, runs: list[str] | None = None, since: DataFrame | None = None) -> DataFrame:
    """``row_number`` per group of rows that are range partitioned and sorted by (group, order) already.

    The rows stay where they are. What is shared is one row per partition and group: where the group begins there, and how
    many rows of it the earlier partitions hold. Written out, so that places stay what they are when a task is run again.
    With ``runs``, the columns a group's order begins with, the rows are placed by (runs, group, order) instead.
    Groups that ``since`` has a number for, in ``_last``, go on from there.
    """
    runs = runs or []
    placed = cut(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    pieces = placed.groupBy(*group, *runs, F.shiftright("_at", PLACE_BITS).alias("_part")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_size"))
    earlier = Window.partitionBy(*group).orderBy(*runs, "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(earlier), F.lit(0).cast("bigint"))
    pieces = pieces.select(*group, *runs, "_part", (before - F.col("_first") + 1).alias("_shift"))
    if since is not None:
        pieces = pieces.join(since, group, "left").withColumn("_shift", F.col("_shift") + F.coalesce("_last", F.lit(0)))
    # written, so that its size is known and few pieces go to the rows, not the rows to them
    pieces = cut(pieces.select(*[F.col(g).alias(f"_of_{g}") for g in [*group, *runs]], F.col("_part").alias("_of_part"), "_shift"), "pieces")
    same = F.shiftright("_at", PLACE_BITS) == F.col("_of_part")
    for g in [*group, *runs]:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return placed.join(pieces, same).withColumn(into, F.col("_at") + F.col("_shift")).select(*[c for c in df.columns if c != into], into)


def carry_last(
    df: DataFrame, group: list[str], order: list, value: str, into: str, parts: int | None = None
) -> DataFrame:
    """The latest non-null ``value`` at or before each row of its group, however big the group is."""
    placed = _placed(df, group, order, parts)
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    seen = placed.withColumn("_local", F.last(value, ignorenulls=True).over(local)).withColumn(
        "_at", F.row_number().over(local)
    )
    ends = seen.groupBy(*group, "_part").agg(F.max_by("_local", "_at").alias("_end"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*group, "_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return (
        seen.join(ends, [*group, "_part"])
        .withColumn(into, F.coalesce("_local", "_carried"))
        .drop("_part", "_local", "_at", "_carried")
    )


def carry_both_ways(
    df: DataFrame, group: list[str], order: list, value: str, before: str, after: str, parts: int | None = None
) -> DataFrame:
    """The latest non-null ``value`` at or before each row of its group, and the first behind it, from one placing of the rows.

    Partitions fill their own rows in both directions with one sort; what a group's other partitions hold next to them is
    one row per partition. ``order`` must be unique in a group.
    """
    placed = _placed(df, group, order, parts)
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    seen = placed.withColumns({
        "_before": F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_after": F.first(value, ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)),
        "_at": F.row_number().over(inside),
    })
    held = F.when(F.col(value).isNotNull(), F.col("_at"))
    ends = seen.groupBy(*group, "_part").agg(F.max_by(value, held).alias("_last"), F.min_by(value, held).alias("_first"))
    pieces = Window.partitionBy(*group).orderBy("_part")
    ends = ends.select(
        *group, "_part", F.last("_last", ignorenulls=True).over(pieces.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(pieces.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    return seen.join(ends, [*group, "_part"]).withColumns(
        {before: F.coalesce("_before", "_earlier"), after: F.coalesce("_after", "_later")}).drop(
        "_part", "_before", "_after", "_at", "_earlier", "_later")


# Branches of a rank per pass over the rows.
BRANCHES = 16


def earlier_order_statistic(df: DataFrame, group: list[str], order: list, value: str, k: str, into: str) -> DataFrame:
    """The ``k``-th smallest ``value`` among the earlier rows of the group; null where they are fewer or ``k`` is below 1.

    Every value has a rank in its group. Ranks are narrowed down digit by digit: rows and questions with the same leading digits go in
    order past one running count per next digit, and a question follows the digit in which its k-th row lies. A pass is one sort;
    the number of passes is that of the digits, and no row ever holds the values before it. ``order`` must be unique in a group.
    """
    ranked = rank_in_group(df, group, [F.col(value), *order], "_rank")
    ranked = cut(rank_in_group(ranked.withColumn("_rank", F.col("_rank") - 1), group, order, "_turn"), "ranked")
    most = ranked.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    digits = 1
    while BRANCHES**digits < most:
        digits += 1
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    # a question comes before the row of its own turn
    rows = ranked.select(*group, "_turn", F.lit(1).alias("_kind"), "_rank", none.alias("_k"), zero.alias("_node"))
    asked = ranked.filter((F.col(k) >= 1) & (F.col(k) < F.col("_turn"))).select(
        *group, "_turn", F.lit(0).alias("_kind"), none.alias("_rank"), F.col(k).cast("bigint").alias("_k"), zero.alias("_node"))
    both = rows.unionByName(asked)
    before = Window.partitionBy(*group, "_node").orderBy("_turn", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    for place in range(digits - 1, -1, -1):
        digit = F.call_function("div", F.col("_rank"), F.lit(BRANCHES**place)) % BRANCHES
        counted = both.withColumn("_digit", digit)
        # rows whose next digit is at most d
        upto = [F.coalesce(F.sum((F.col("_digit") <= d).cast("bigint")).over(before), zero).alias(f"_upto{d}") for d in range(BRANCHES)]
        counted = counted.select("*", *upto)
        found, passed = F.lit(BRANCHES - 1), F.col(f"_upto{BRANCHES - 2}")
        for d in range(BRANCHES - 2, -1, -1):
            here = F.col(f"_upto{d}") >= F.col("_k")
            found = F.when(here, d).otherwise(found)
            passed = F.when(here, F.col(f"_upto{d - 1}") if d else zero).otherwise(passed)
        both = counted.select(
            *group, "_turn", "_kind", "_rank", (F.col("_k") - passed).alias("_k"),
            (F.col("_node") * BRANCHES + F.when(F.col("_kind") == 1, F.col("_digit")).otherwise(found)).alias("_node"))
    answer = both.filter("_kind = 0").select(*group, "_turn", F.col("_node").alias("_rank"))
    answer = answer.join(ranked.select(*group, "_rank", F.col(value).alias(into)), [*group, "_rank"]).drop("_rank")
    return ranked.join(answer, [*group, "_turn"], "left").drop("_rank", "_turn")
