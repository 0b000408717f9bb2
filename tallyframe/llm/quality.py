"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .common import give_back, map_arrow, slices, worker_cache

WORD = re.compile(r"\w+|[^\w\s]+")
SECOND = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    #: Weights are kept for 2 ** bits hashes.
    bits: int = 18
    #: The model is fitted on so many labelled documents at most: those whose ids have the smallest hashes.
    sample: int = 6_000
    #: So many bytes of compressed features come to the driver at most: further documents of the sample are left out, none is cut.
    sample_bytes: int = 64 << 20
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def features(text: str, bits: int) -> np.ndarray:
    """The hashes of the text's words and pairs of neighbouring words, repeated as they occur.

    Pairs of one word, whichever, are one feature, as are words with one other between them.
    """
    known = worker_cache("quality").setdefault("words", {})
    if len(known) > 300_000:
        known.clear()
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint32)
    try:
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w.encode())
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    pairs = (ids[:-1] * SECOND) ^ ids[1:]
    pairs *= SECOND
    pairs[ids[:-1] == ids[1:]] = SECOND  # all words that are said twice share a feature, and
    again = np.full(int((ids[:-2] == ids[2:]).sum()), ~SECOND)  # those that come back after one other
    return (np.concatenate((ids, pairs, again)) >> np.uint64(64 - bits)).astype(np.uint32)


def counted(text: str, bits: int) -> bytes:
    """The distinct features, by their differences, and how often each occurs, compressed."""
    at, count = np.unique(features(text, bits), return_counts=True)
    return zlib.compress(np.concatenate((np.diff(at, prepend=at[:1] * 0), count)).astype("<u4").tobytes(), 1)


def uncounted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, count = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int64), count.astype(np.float64)


def fit_leader(examples: list[tuple[bytes, int]], s: Settings) -> np.ndarray:
    """Weights by follow-the-regularised-leader (proximal, a rate for each coordinate) from counted features and labels; the last one is the bias."""
    size = (1 << s.bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(s.epochs):
        for data, y in examples:
            at, count = uncounted(data)
            x = np.append(count / np.sqrt(max(1.0, float((count * count).sum()))), 1.0)
            at = np.append(at, size - 1)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * wi
            n[at] = ni + g * g
    live = np.abs(z) > s.l1
    w[live] = -(z[live] - np.sign(z[live]) * s.l1) / ((s.beta + np.sqrt(n[live])) / s.alpha + s.l2)
    return w


def learnable(id_col: str = "doc_id"):
    """Whether an id's label may be learned from: its crc32 as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def train_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from labelled documents that learnable() allows.

    Rows without an id or label teach nothing; an id with several labels has the lowest, and of an id's
    several texts one is taken. At most settings.sample documents are taken, by the hashes of their ids, and of these, in the same
    order, as many as settings.sample_bytes hold the features of. These bounds are what
    lets their ids be broadcast and their features come to the driver. Without any examples
    all weights are 0, and every score is a half.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    chosen = marked.where(learnable("id")).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(settings.sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "id")
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [counted(t, bits) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["id", "y", "features"])

    rows = map_arrow(picked, run, "id long, y int, features binary").groupBy("id").agg(F.min(F.struct(F.xxhash64("features").alias("h"), "features", "y")).alias("r"))
    # settings.sample rows at most
    held = F.sum(F.length("r.features")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = materialize(rows.withColumn("held", held).where(F.col("held") <= settings.sample_bytes).select("id", "r.y", "r.features"), "sample").collect()
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r.id).encode()))
    weights = fit_leader([(bytes(r.features), int(r.y > 0)) for r in rows], settings)
    del rows
    give_back()
    return weights


def score_quality(df: DataFrame, weights: np.ndarray, settings: Settings = Settings(), text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The rows of df with the columns names: a score (double, 0 to 1) and a prediction (int, 1 from a half); such columns of df are replaced.

    A null text is an empty one; its score comes from the bias alone. Nothing is shuffled.
    """
    bits, w = settings.bits, weights.astype(np.float32)
    df = df.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            scores = []
            for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
                ids = features(t or "", bits)
                v = float(w[-1])
                if len(ids):
                    found = w[ids]
                    if found.any():
                        count = np.unique(ids, return_counts=True)[1].astype(np.float64)
                        v += float(found.sum(dtype=np.float64)) / float(np.sqrt((count * count).sum()))
                scores.append(1 / (1 + float(np.exp(-np.clip(v, -35, 35)))))
            yield b.append_column(names[0], pa.array(scores, pa.float64())).append_column(names[1], pa.array([int(s >= 0.5) for s in scores], pa.int32()))

    return map_arrow(df, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{names[0]}` double", f"`{names[1]}` int"]))
