"""Running a stream over what is there, into files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.materialize import shared_folder


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """All that a stream has to say of the files present, as a batch DataFrame.

    Each micro-batch replaces its own folder below spark.checkpoint.dir, so a batch that
    runs again changes nothing. In update mode the last row of every key (keys) counts;
    in complete mode the last batch.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows/batch=*").drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_last")
    elif mode == "update":
        last = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
        rows = rows.join(last, [*keys, "_batch"])
    return rows.drop("_batch")
