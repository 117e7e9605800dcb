"""Metrics over a sliding look-back, and a rate limit, as streams with state and event-time timers.

State is a few numbers a key, whatever the number of events: hourly sums of the look-back, or a subject's open window. Both run on
the RocksDB state store and go on where they were from the checkpoint folder. Results go to the shared folder, a folder for each
micro-batch that a repeated one overwrites.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _LookBack(StatefulProcessor):
    """Hourly sums of a key; when the watermark passes hours, their look-backs are sent out and what no later one needs is evicted."""

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "hour long", "n long, total double")
        self.done = handle.getValueState("done", "hour long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for hour, n, total in zip(frame["hour"].tolist(), frame["n"].tolist(), frame["total"].tolist(), strict=True):
                had = self.sums.getValue((hour,)) if self.sums.containsKey((hour,)) else (0, 0.0)
                self.sums.updateValue((hour,), (had[0] + n, had[1] + total))
                self.handle.registerTimer((hour + 1) * HOUR)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // HOUR  # hours up to here are complete
        done = self.done.get()[0] if self.done.exists() else None
        sums = {k[0]: v for k, v in self.sums.iterator()}
        if not sums or (done is not None and done >= passed):
            return
        first = min(sums) + 1 if done is None else done + 1
        ends = sorted({e for h in sums for e in range(max(first, h + 1), min(passed, h + self.hours) + 1)})
        rows = [(e, *map(sum, zip(*(sums[h] for h in range(e - self.hours, e) if h in sums), strict=True))) for e in ends]
        for h in sums:
            if h + self.hours <= passed:
                self.sums.removeKey((h,))
        self.done.update((passed,))
        if any(h + self.hours > passed for h in sums):
            self.handle.registerTimer((passed + 1) * HOUR)
        if rows:
            until, n, total = zip(*rows, strict=True)
            yield pd.DataFrame({"event_type": key[0], "until": until, "n": n, "total": total})

    def close(self) -> None:
        pass


def look_back(events: DataFrame, hours: int = 24, late: str = "2 hours") -> DataFrame:
    """event_type, until (hours since 1970), n, total over the ``hours`` before it, for each full hour that the watermark has passed
    and whose look-back has events.

    events: a stream of event_type, ts, value. Each task sums up what it reads by key and hour first, so that a key which has most
    events is a few rows a task. The watermark is ``late`` behind the start of the newest hour: an hour is sent out once it has
    passed, and what comes for it afterwards is dropped (Spark counts such rows in the query's progress). Rows with a null time
    are left out; null values count 0, null types are an empty one.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            by = frame.groupby(["event_type", "hour"], dropna=False, as_index=False)
            yield by.agg(n=("value", "size"), total=("value", "sum"))

    rows = events.filter("ts is not null").select(F.coalesce("event_type", F.lit("")).alias("event_type"), F.floor(F.unix_millis("ts") / HOUR).alias("hour"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    summed = rows.mapInPandas(work, "event_type string, hour long, n long, total double").withColumn("ts", F.timestamp_millis(F.col("hour") * HOUR)).withWatermark("ts", late)
    return summed.groupBy("event_type").transformWithStateInPandas(_LookBack(hours), "event_type string, until long, n long, total double", "append", "eventTime")


class _Limit(StatefulProcessor):
    """A subject's window: when it opened and how many attempts it has let through. The state goes when the window closes."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["s", "event_id"])
        opened, used = self.window.get() if self.window.exists() else (None, 0)
        allowed = []
        for s in frame["s"].tolist():
            if opened is None or s >= opened + self.seconds:
                opened, used = s, 0
            allowed.append(used < self.most)
            used += allowed[-1]
        self.window.update((opened, used))
        self.handle.registerTimer((opened + self.seconds) * 1000)
        yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and (self.window.get()[0] + self.seconds) * 1000 <= timerValues.getCurrentWatermarkInMs():
            self.window.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited(events: DataFrame, most: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """user_id, event_id, allowed of a stream of attempts (user_id, event_id, ts): the rate limit of ``streaming.limits``.

    Attempts of a micro-batch are taken in time order; one that comes after later ones of an earlier micro-batch is judged then, by
    the window that is open. A closed window's state is dropped when the watermark passes its end.
    """
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.unix_seconds("ts").alias("s"), "ts").filter("ts is not null").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_Limit(most, seconds), "user_id long, event_id long, allowed boolean", "append", "eventTime")


def run(stream: DataFrame, root: str) -> DataFrame:
    """All rows of a stream over what is there now; with the same root another call goes on where this one ended, and returns the rows
    of both."""
    spark = stream.sparkSession

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/run={batch}")

    with _rocks(spark):
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(fields).parquet(f"{root}/rows/*")
