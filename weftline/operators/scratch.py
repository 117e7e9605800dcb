"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Tables are written once and read back, which cuts lineage and survives lost executors. A result that is still lazy reads from
them, so a run's folder lives until the caller removes it; tables that a later step has replaced are deleted at once.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of its own for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="weftline-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"

    def at(self, root: str) -> Scratch:
        """The same for a folder that outlives the run."""
        other = object.__new__(Scratch)
        other.spark, other.root = self.spark, root.rstrip("/")
        return other

    def done(self, name: str) -> bool:
        """Whether a table has been written to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df and return a DataFrame that reads it."""
        path = f"{self.root}/{name}"
        with eager(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_parts(self, df: DataFrame, name: str, part: str) -> DataFrame:
        """Like save, with a folder for each value of the column ``part``, so that drop() can take one of them."""
        path = f"{self.root}/{name}"
        with eager(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(part).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Like save, but bucketed by key, so that joins on it leave this side where it is. The table leaves the catalogue at once."""
        table = f"weftline_{name}_{uuid.uuid4().hex}"
        with eager(self.spark):
            df.write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(buckets, key).saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # an external one: its files stay
        return out

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def eager(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when each action ends: their results are in the shared folder by then."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
