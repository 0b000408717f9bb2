"""Tables written in the shared folder on the way to a result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of scratch tables, by the scopes that are open.
_open: list[list[str]] = []
#: The folder of sessions without spark.checkpoint.dir, which can't be set any more once a session runs.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
        base = _own[0]
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, keep: bool = False, group_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, which cuts its lineage.

    The tables outlive lost executors. keep: also beyond the scope that is open. group_rows: the most rows of a row group, for
    large values; a reader holds 4,096 rows at a time, or those of a row group.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex[:12]}"
    if _open and not keep:
        _open[-1].append(path)
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(f"{path}/{name}")
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in this scope are deleted when it ends, so what is read from them has to be written or kept by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
