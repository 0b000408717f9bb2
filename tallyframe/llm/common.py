"""What the training-data operators share: Arrow maps, worker caches, joins on hot keys."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key that more than one in so many rows have is hot; there are fewer hot keys than this.
HOT = 10_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row for each key and in the column count how many of the total rows have it.

    Hot keys, fewer than HOT whatever the size, are broadcast and their rows stay where they are. The
    others are shuffled, and none of them brings more than one in HOT of all rows to a task.
    Both sides are read twice, so they should be written tables. how: inner or left.
    """
    hot = F.col(count) * HOT > total
    few = F.broadcast(keyed.where(hot))
    rest = rows.join(few.select(on), on, "left_anti").join(keyed.where(~hot), on, how)
    return rows.join(few, on).unionByName(rest).drop(count)


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks, until another owner asks for its own.

    So a worker that runs one stage of a pipeline after the other holds the words of one at a time.
    """
    module = sys.modules.setdefault("_tallyframe_worker", types.ModuleType("_tallyframe_worker"))
    held = module.__dict__.setdefault("held", {})
    if owner not in held:
        if held:
            held.clear()
            give_back()
        held[owner] = {}
    return held[owner]


def give_back() -> None:
    """Return what was freed to the system, as far as the platform lets us."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about max_bytes, one row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        rows = batch.num_rows
        if col.nbytes <= max_bytes or rows <= 1:
            if rows:
                yield batch
            continue
        start, size = 0, 0
        lengths = pa.compute.binary_length(col).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start, rows - start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
