"""Windowed trace metrics as a stream over a growing folder or file of events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with event time as a timestamp (streams can't take watermarks on timestamps without a zone)."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total for each hour; events later than ``late`` are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def windowed_counts(spark: SparkSession, path: str) -> DataFrame:
    """All hours of what is there now: the stream run to its end.

    Each micro-batch writes the hours that it changed, with its number, to the folder in spark.checkpoint.dir; of each hour the
    last such row holds. State and results stay with the executors, and a run that is begun again goes on where it was.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
    root = f"{base.rstrip('/')}/weftline/hours-{uuid.uuid4().hex}"

    def save(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/rows/run={batch}")

    hours = hourly(read_events(spark, path))
    run = hours.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(save).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(f"{hours.schema.simpleString()[7:-1].replace(':', ' ')}, batch int").parquet(f"{root}/rows/*")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("start", "event_type", "x.n", "x.total")
