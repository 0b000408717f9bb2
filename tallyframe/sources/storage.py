"""Versioned tables: a version is written whole, then a marker publishes it; readers never see half of one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400 * 1_000_000_000


@dataclass
class Store:
    """Tables under one folder of any file system that Spark knows."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> int | None:
        """The latest version whose marker exists."""
        fs, p = self._fs(f"{self.root}/published")
        if not fs.exists(p):
            return None
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=None)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        return self.spark.read.parquet(f"{self.root}/v={version}/{name}")

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next version, then create its marker. Tables of transfers and events are laid out by ledger and day, sorted by time."""
        version = (self.current() or 0) + 1
        for name, df in tables.items():
            if {"ledger", "timestamp"} <= set(df.columns) and name != "accounts":
                day = F.expr(f"timestamp div {DAY}").alias("day")
                df.select("*", day).repartition("ledger", "day").sortWithinPartitions("timestamp").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/v={version}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
        fs, marker = self._fs(f"{self.root}/published/{version}")
        if not fs.createNewFile(marker):  # one writer wins a version
            raise OSError(f"version {version} of {self.root} was published by another")
        return version

    def log(self, requests: DataFrame) -> None:
        """Append requests to the log that a replay reads."""
        requests.write.mode("append").parquet(f"{self.root}/request_log")

    def replay(self) -> DataFrame:
        """The results and events of the log, as they were when its requests came."""
        from ..operators.engine import execute

        return execute(self.spark.read.parquet(f"{self.root}/request_log"))

    def inspect(self) -> DataFrame:
        """Rows of each table of the current version."""
        fs, p = self._fs(f"{self.root}/v={self.current()}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        parts = [self.read(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out


def faults(log: DataFrame) -> DataFrame:
    """batch, problem: what is wrong with a request log, batch by batch.

    A batch holds each place from 0 to its size once, in one request of one kind; times grow with batches, and leave room for their events.
    """
    batches = log.groupBy("batch").agg(
        F.count("*").alias("n"), F.countDistinct("idx").alias("places"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.max("size").alias("size"), F.min("size").alias("least_size"),
        F.countDistinct("what").alias("kinds"), F.max("batch_time").alias("time"), F.min("batch_time").alias("least_time"), F.max("what").alias("what"),
    )
    # a row a request: the one before is found by a window over stretches of numbers, and what ends the stretch before
    stretch = F.expr("batch div 100000")
    ends = batches.groupBy(stretch.alias("s")).agg(F.max_by("time", "batch").alias("end"))
    ends = ends.select("s", F.lag("end").over(Window.orderBy("s")).alias("end"))  # a row for 100,000 requests
    own = Window.partitionBy("s").orderBy("batch")
    before = batches.withColumn("s", stretch).withColumn("last", F.lag("time").over(own))
    before = before.join(ends, "s", "left").withColumn("last", F.coalesce("last", "end"))
    tick = F.col("what") == "tick"
    whole = (F.col("n") == F.col("size")) & (F.col("places") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    problem = (
        F.when(F.col("kinds") > 1, "several kinds").when((F.col("size") != F.col("least_size")) | (F.col("time") != F.col("least_time")), "several headers")
        .when(~tick & ~whole, "events are missing or repeated").when(F.col("time") - F.when(tick, 0).otherwise(F.col("size")) < F.col("last"), "time does not grow")
    )
    return before.select("batch", problem.alias("problem")).where("problem is not null")


def merged(*logs: DataFrame) -> DataFrame:
    """One log out of several copies: every batch from the first copy that holds it whole.

    Raises nothing where copies differ; see disagreements().
    """
    both, names = None, logs[0].columns
    for i, log in enumerate(logs):
        tagged = log.select(*names).withColumn("copy_", F.lit(i))
        both = tagged if both is None else both.unionByName(tagged)
    counts = both.groupBy("batch", "copy_").agg(F.countDistinct("idx").alias("n"), F.max("size").alias("size"))
    best = counts.where("n = greatest(size, 1)").groupBy("batch").agg(F.min("copy_").alias("copy_"))
    return both.join(best, ["batch", "copy_"], "left_semi").drop("copy_")


def disagreements(*logs: DataFrame) -> DataFrame:
    """batch: those that whole copies hold with different events."""
    digests = None
    for log in logs:
        rows = log.withColumn("digest_", F.xxhash64(*sorted(log.columns))).groupBy("batch").agg(F.expr("bit_xor(digest_)").alias("digest"), F.countDistinct("idx").alias("n"), F.max("size").alias("size"))
        rows = rows.where("n = greatest(size, 1)").select("batch", "digest")
        digests = rows if digests is None else digests.unionByName(rows)
    return digests.groupBy("batch").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("batch")
