"""Runs a stream over what has arrived and hands back the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.lineage import checkpoint_folder


def run_to_table(frame: DataFrame, mode: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Process everything available and stop. In update mode the latest row of each key counts."""
    spark = frame.sparkSession
    base = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    spark.createDataFrame([], frame.schema).withColumn("batch", F.lit(0).cast("bigint")).write.parquet(f"{base}/rows")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(f"{base}/rows")

    query = (
        frame.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/rows")
    if not keys:
        return rows.drop("batch")
    rest = [c for c in frame.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return latest.select(*keys, "_row.*").select(*frame.columns)
