"""The log on disk: facts (gzip) and chain, one JSON object per line, a folder per delivery.

A delivery is recorded in two writes. Its facts come first, numbered on from the stored heads; its links of the chain come
second and make it count. Facts of a delivery without links are what a run left that did not end: nobody reads them, and the
next delivery takes their number and replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.lineage import cut, kept, passage
from khata.operators import log
from khata.operators.ranking import parts_for, rank_placed
from khata.schemas import EVENTS

FACTS = T.StructType([*EVENTS.fields, T.StructField("digest", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("delivery", T.LongType())])
# Folders below a delivery: the month recorded, so that a later delivery reads only its own months.
MONTH = T.StructField("month", T.StringType())
# Merchants and months of a delivery beyond which their pieces are no longer few.
CELLS = 100_000


def _month() -> Column:
    return F.date_format("recorded_at", "yyyy-MM")


class BrokenLog(Exception):
    """What was read back is not what was chained."""


def _stored(spark: SparkSession, path: str, schema, below: str | None = None) -> DataFrame:
    """The JSON table at ``path``; empty where nothing was written yet. ``below``: the folder whose names of folders are columns."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", below or path).json(path)


def links(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/chain", log.CHAIN)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all deliveries that were recorded to the end."""
    whole = links(spark, path).select("delivery").distinct()
    return _stored(spark, f"{path}/facts", T.StructType([*FACTS.fields, MONTH])).join(whole, "delivery", "left_semi")


def append(batch: DataFrame, path: str) -> DataFrame:
    """Record what ``batch`` adds to the log at ``path``; per merchant, rows delivered, recorded and skipped.

    Facts that the log holds are skipped, so a delivery that comes again adds nothing. Of the log only the months of
    the delivery are read, and of the chain its links. One delivery is recorded at a time.
    """
    spark = batch.sparkSession
    with passage(spark, "delivery"):
        # one row per merchant and month
        came = cut(batch.groupBy("merchant_id", _month().alias("month")).agg(F.count("*").alias("delivered")), "came")
        rows, cells = came.agg(F.sum("delivered"), F.count("*")).first()
        parts = parts_for(rows or 0, spark)
        chained = links(spark, path)
        number = (chained.agg(F.max("delivery")).first()[0] or 0) + 1
        heads = cut(log.heads(chained), "heads")
        # a copy of a fact has the same recorded_at, so only these months can hold it
        held = facts(spark, path).join(came.select("month").distinct(), "month", "left_semi") if number > 1 else None
        last = heads.select("merchant_id", F.col("facts").alias("_last"))
        new = rank_placed(log.fresh(batch, held, parts), ["merchant_id"], "seq", ["recorded_in"], last)
        placed = new.select(*[c for c in FACTS.names if c != "delivery"], _month().alias("month"))
        if cells > CELLS:
            # too many to be brought to the rows, so these have left the place they had
            placed = placed.repartitionByRange(parts, "month", "merchant_id", "seq")
        target = f"{path}/facts/delivery={number}"
        placed.write.mode("overwrite").partitionBy("month").option("partitionOverwriteMode", "static").option(
            "ignoreNullFields", False).option("compression", "gzip").json(target)
        # read again, so the chain is over what was written; its number comes from the folder, as a constant would leave no trace in a plan
        # and rows dealt by it would be dealt once more
        written = _stored(spark, target, T.StructType([*FACTS.fields, MONTH]), f"{path}/facts")
        log.chain(written, heads, parts).drop("delivery").write.mode("overwrite").json(f"{path}/chain/delivery={number}")
        # the links say how many facts were recorded
        recorded = links(spark, path).filter(F.col("delivery") == number).groupBy("merchant_id").agg(F.sum("facts").alias("recorded"))
        told = came.groupBy("merchant_id").agg(F.sum("delivered").alias("delivered")).join(recorded, "merchant_id", "left")
        return kept(told.withColumn("recorded", F.coalesce("recorded", F.lit(0))).withColumn("skipped", F.col("delivered") - F.col("recorded")), "told")


def faults(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """(merchant_id, reason) of links and batches that do not hold; with ``since``, of the deliveries after that one only."""
    chained = links(spark, path)
    first = 0 if not since else chained.filter(F.col("delivery") <= since).groupBy("merchant_id").agg(F.max("batch").alias("_seen"))
    broken = log.broken_links(chained)
    if since:
        broken = broken.join(first, "merchant_id", "left").filter(F.col("batch") > F.coalesce("_seen", F.lit(0)))
    late = F.col("delivery") > since
    altered = log.altered_batches(facts(spark, path).filter(late), chained.filter(late))
    return broken.select("merchant_id", "reason").unionByName(
        altered.select("merchant_id", F.lit("facts were added, moved or altered").alias("reason")))


def read_log(spark: SparkSession, path: str, verify: bool = True, since: int = 0) -> DataFrame:
    """The facts, after the chain and they themselves were checked from delivery ``since`` on."""
    if verify:
        with passage(spark, "verify"):
            shown = [f"{r['merchant_id']}: {r['reason']}" for r in faults(spark, path, since).take(3)]
        if shown:
            raise BrokenLog("; ".join(shown))
    return facts(spark, path).select(*FACTS.names)


def write_events(events: DataFrame, path: str) -> None:
    """The event table for scans: a folder per type, sorted so that row groups can be skipped."""
    events.sortWithinPartitions("merchant_id", "occurred_at").write.mode("append").partitionBy("type").parquet(path)
