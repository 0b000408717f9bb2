"""Line dedup: long lines that many documents share stay in one of them only.

Lines are exploded with their positions, normalised and hashed by Spark's own functions; of
lines nothing but position and hash is written and shuffled. Documents per hash are counted, and lines over the threshold
go back to their document as positions, which it is put together without.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import join_counted, map_arrow, slices

BLANKS = " \t\n\x0b\x0c\r"


def line_key(key: Column) -> tuple[Column, Column]:
    """Two texts that are equal for two lines if and only if these are with A-Z in lower case.

    Characters are put in lower case throughout, which is much cheaper than A-Z alone, and what isn't ASCII is
    given once more as it is, with a blank for what lies between. That tells all lines apart but those with one of
    the two characters that ASCII ones come from, the kelvin sign and the dotted I; these take the dear way.
    """
    odd = F.contains(key, F.lit("\u212a")) | F.contains(key, F.lit("\u0130"))
    plain = F.octet_length(key) == F.length(key)
    low = F.when(plain, F.lower(key)).when(odd, F.translate(key, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(key))
    return low, F.when(plain, F.lit("")).otherwise(F.regexp_replace(key, r"[\x00-\x7f]+", " "))


def keys_of(texts: DataFrame, min_chars: int) -> DataFrame:
    """id, row (the hash of its text), pos and the two hashes k0, k1 of each line that is long enough."""
    lines = texts.where("id is not null").select("id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.select("id", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    low, rest = line_key(F.col("key"))
    keyed = keyed.select("id", "row", "pos", low.alias("low"), rest.alias("rest"))
    return keyed.select("id", "row", "pos", F.xxhash64("low", "rest").alias("k0"), F.xxhash64("low", "rest", F.lit(1)).alias("k1"))


def dedup_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The rows of df with text_col cut down, and the columns counts (long): lines before, and lines dropped.

    A key of at least min_chars code points that at least min_docs documents hold (distinct
    doc_ids; a document counts once however often it repeats a line) loses all its lines, but
    for those in the largest doc_id that holds it. A null text is an empty one, of one line; a
    row without doc_id keeps all its lines and counts for none. Rows that repeat a doc_id are
    parts of one document. Columns of df that are named like the counts are replaced; others keep their values, whatever their names.

    Only 28 bytes a long line are shuffled to be counted. Lines that a
    good part of all documents share are broadcast, so no task gets them all. The positions to
    drop are gathered by row and meet the texts in one join.
    """
    rest = [c for c in df.columns if c not in counts]
    names = {c: f"c{i}_" for i, c in enumerate(rest)}
    text_name = names[text_col]
    text = F.coalesce(F.col(text_name).cast("string"), F.lit(""))
    inner = df.select(*[F.col(c).alias(names[c]) for c in rest], F.col(id_col).cast("long").alias("id")).withColumn(text_name, text).withColumn("row", F.xxhash64(text_name))
    keys = materialize(keys_of(inner.select("id", "row", F.col(text_name).alias("text")), min_chars), "keys")
    held = keys.select("id", "k0", "k1").distinct()
    many = materialize(held.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs), "many")
    lost = join_counted(keys, many, ["k0", "k1"], "n", keys.count()).where("id < keeper")
    lost = lost.groupBy("id", "row").agg(F.collect_set("pos").alias("lost_"))
    joined = inner.join(lost, ["id", "row"], "left").drop("id", "row")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "lost_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_name):
            at, gone = b.schema.get_field_index(text_name), b.schema.get_field_index("lost_")
            lists, texts, total, cut = b.column(gone), b.column(at).to_pylist(), [], []
            for i, t in enumerate(texts):
                total.append(t.count("\n") + 1)
                if lists[i].is_valid:
                    lines, keep = t.split("\n"), np.ones(total[-1], bool)
                    keep[lists[i].values.to_numpy()] = False
                    texts[i] = "\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
                    cut.append(total[-1] - int(keep.sum()))
                else:
                    cut.append(0)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns) if i != gone]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(cut, pa.int64())], [*[n for i, n in enumerate(b.schema.names) if i != gone], "total_", "cut_"])

    out = map_arrow(joined, run, ", ".join([*fields, "total_ long", "cut_ long"]))
    return out.select(*[F.col(names[c]).alias(c) for c in rest], F.col("total_").alias(counts[0]), F.col("cut_").alias(counts[1]))
