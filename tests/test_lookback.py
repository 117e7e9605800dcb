import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftline.streaming import limits, lookback

START = datetime(2024, 3, 1)


def write(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(seed, n, first, last):
    r = random.Random(seed)
    return [(seed * 1000 + i, r.randrange(5), r.choice(["a", "a", "a", "b", None]), START + timedelta(minutes=r.randrange(first * 60, last * 60)), r.choice([1.0, 2.5, None])) for i in range(n)]


def batch_twin(rows, hours, passed):
    sums = defaultdict(lambda: [0, 0.0])
    for _, _, kind, ts, value in rows:
        x = sums[kind or "", int(ts.timestamp() // 3600)]
        x[0], x[1] = x[0] + 1, x[1] + (value or 0)
    out = {}
    for (kind, h), (n, total) in sums.items():
        for e in range(h + 1, min(h + hours, passed) + 1):
            had = out.get((kind, e), (0, 0.0))
            out[kind, e] = (had[0] + n, round(had[1] + total, 6))
    return out


def test_look_back_goes_on_after_a_restart(spark, tmp_path):
    parts = [rows_of(1, 200, 0, 30), rows_of(2, 150, 29, 60), rows_of(3, 100, 61, 80)]
    write(spark, f"{tmp_path}/in", parts[0])
    first = lookback.run(lookback.look_back(stream(spark, f"{tmp_path}/in"), 24), f"{tmp_path}/out").count()
    write(spark, f"{tmp_path}/in", parts[1])
    lookback.run(lookback.look_back(stream(spark, f"{tmp_path}/in"), 24), f"{tmp_path}/out")
    write(spark, f"{tmp_path}/in", parts[2] + [(9999, 1, "a", START, 1.0)] * 3)
    got = lookback.run(lookback.look_back(stream(spark, f"{tmp_path}/in"), 24), f"{tmp_path}/out").collect()
    assert first  # the three old rows of the last part came too late
    every = [x for p in parts for x in p]
    passed = int(max(x[3] for x in every).timestamp() // 3600) - 2
    on_time = {(r.event_type, r.until): (r.n, round(r.total, 6)) for r in got}
    assert len(on_time) == len(got)  # each hour is sent out once
    assert on_time == batch_twin(every, 24, passed)


def test_limit_as_a_stream(spark, tmp_path):
    parts = [rows_of(4, 120, 0, 10), rows_of(5, 120, 10, 20)]
    for part in parts:
        write(spark, f"{tmp_path}/in", part)
        got = lookback.run(lookback.limited(stream(spark, f"{tmp_path}/in"), 2, 1800), f"{tmp_path}/out")
    rows = spark.createDataFrame([x for p in parts for x in p], "event_id long, user_id long, event_type string, ts timestamp, value double")
    want = limits.rate_limit(rows.select("user_id", "event_id", F.unix_seconds("ts").alias("s"), "ts"), 2, 1800)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("not allowed").count() > 10
