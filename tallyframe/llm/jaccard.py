"""N-gram Jaccard join: near copies through prefixes of rare tokens and combinations of frequent ones.

A document's tokens are the hashes of its distinct word n-grams. Tokens are in one order over
the whole table, by the number of documents that hold them, then by value. With a required
share of p %, a document of n tokens has t = n - ceil(p n / 100) to spare: what it is linked
with lacks t of its tokens at most. Its prefix is extended until its signatures survive the
loss of any t tokens:

* a token of at most RARE documents is a signature by itself, and worth one;
* frequent tokens are dealt by their hash into g groups, and every pair of prefix tokens in a
  group is a signature; m tokens of a group are worth m - 1, as one can stay unpaired.

So two linked documents share a signature: of the two prefixes, the one that ends first in the
order is worth more than what is lost, and what remains of it lies in the other one as well.
g follows the size class (powers of two) and a document also writes signatures for the
neighbouring class if its partners may be there, so the number of signatures stays in
proportion to the prefix. A set of one token is linked with copies of itself only, and those are one document here already.

Shared signatures make candidates; those that size and position rule out are dropped, the others
are verified on the whole sets. Candidates are linked to one document for each signature first;
only documents that are still apart then are compared among themselves, and of those only pairs
whose parity bits do not already rule them out, so a large group of
near copies costs about a comparison a document and signature, not one a pair.

Token counts cover all documents and no row is sent for a token. Texts are dealt into blocks; a
block's tokens go out as sorted, packed arrays by range, are counted there, and those which are
not unique come back to the block in the same form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.links import connected
from ..sources.scratch import materialize
from .common import join_counted, map_arrow, worker_cache

#: Tokens of more documents than this are frequent.
RARE = 32
#: Bytes of stored input for each block of texts.
BLOCK_BYTES = 4 << 20
#: Beyond 4 TB of stored input blocks grow.
MOST_BLOCKS = 1 << 20
PARITY = 16

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * P2
    return x ^ (x >> np.uint64(29))


def token_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; with fewer words, of all of them as one; none without words."""
    # bytes.lower() and bytes.split() know A-Z and the blanks 09-0D and 20 only
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    known = worker_cache("shingles").setdefault("words", {})
    if len(known) > 300_000:
        known.clear()
    try:
        ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    except KeyError:
        for w in {w for w in found if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(ids))
    size = len(ids) - n + 1
    out = np.full(size, np.uint64(n))
    for j in range(n):
        out = mixed((out * P1) ^ ids[j : j + size])
    return np.unique(out)


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte: high bytes are mostly zero and shrink in the shuffle."""
    deltas = np.diff(values, prepend=np.uint64(0))
    width = 8 if not len(deltas) else max(1, (int(deltas.max()).bit_length() + 7) // 8)
    planes = deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def parities(tokens: np.ndarray) -> np.ndarray:
    """PARITY words of 64 bits, each bit the parity of the tokens dealt to it: sets that differ in d tokens differ in d bits at most."""
    at = mixed(tokens ^ P1) % np.uint64(64 * PARITY)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def spare(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def classes_of(n: int, percent: int) -> list[int]:
    """Size classes of a set of n tokens and of all that it can be linked with."""
    low, high = -(-percent * n // 100), n * 100 // percent
    return list(range(max(low, 1).bit_length() - 1, high.bit_length()))


def groups_of(c: int) -> int:
    return max(1, (1 << c) // 20)


def signatures(tokens: np.ndarray, counts: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """(signature, position, slack) of a set; counts: how many documents hold each token.

    Where this is the first signature that two sets share, they have at most slack tokens in
    common before the position. Tokens of one document only are worth something, but not written.
    """
    n = len(tokens)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    needed = spare(n, percent) + 1
    rare = int(np.searchsorted(counts, RARE, "right"))
    head = min(rare, needed)
    out = [(int(t), p, 0) for p, (t, c) in enumerate(zip(tokens[:head].tolist(), counts[:head].tolist(), strict=True)) if c > 1]
    if rare >= needed:
        return out
    rest = tokens[rare:]
    by_class = []
    classes = classes_of(n, percent) if n > 1 else []
    for c in classes:
        g = groups_of(c)
        group = ((mixed(rest) >> np.uint64(40)) % np.uint64(g)).tolist()
        worth, members = rare, {}
        salt = np.uint64((2 * c + 3) * int(P1) & (1 << 64) - 1)
        for i, (t, j) in enumerate(zip(rest.tolist(), group, strict=True)):
            if worth >= needed:
                break
            if j not in members:
                members[j] = [t]
                continue
            worth += 1
            pairs = mixed(mixed(np.array(members[j], np.uint64) ^ salt) * P1 + np.uint64(t))
            by_class += [(int(s), rare + i, g) for s in pairs.tolist()]
            members[j].append(t)
    return out + by_class


KINDS = "kind int, doc_id long, n int, key binary, sig long, pos int, slack int, tokens array<long>, parity array<long>"
COLUMNS = ["kind", "doc_id", "n", "key", "sig", "pos", "slack", "tokens", "parity"]


def block_count(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # the planner doesn't know
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, min(MOST_BLOCKS, size // BLOCK_BYTES))


def labels(spark: SparkSession, n: int) -> DataFrame:
    """For each number under n a label that a repartition by it into n parts puts into the part of that number: n rows, MOST_BLOCKS at most.

    Numbers themselves would fall into the same parts here and there, and leave others empty.
    """
    tries = spark.range(32 * n).select(F.col("id").alias("label"), F.pmod(F.hash("id"), F.lit(n)).cast("long").alias("part"))
    found = tries.groupBy("part").agg(F.min("label").alias("label"))
    every = spark.range(n).select(F.col("id").alias("part"))
    return every.join(found, "part", "left").select("part", F.coalesce("label", "part").alias("label"))


def spread_out(df: DataFrame, part: Column, n: int, name: str) -> DataFrame:
    """df in n partitions, one for each number that part gives, with the number's label."""
    known = F.broadcast(labels(df.sparkSession, n))
    return df.withColumn("part", part.cast("long")).join(known, "part").drop("part").withColumnRenamed("label", name).repartition(n, name)


def written(df: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows of three kinds, in a scratch table: 0 (doc_id, n, key of its set), 1 (a signature), 2 (tokens of a set with signatures)."""
    blocks = block_count(df)
    bits = np.uint64(min(64, 30 + blocks.bit_length()))
    cut = np.uint64(64) - bits
    # xxhash64 of the row's place would move rows on a retry; that of the id does not
    dealt = spread_out(df, F.pmod(F.xxhash64("doc_id"), F.lit(blocks)), blocks, "block")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, np.ndarray]] = {}
        for b in batches:
            for t, k in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                tokens = token_set(t.as_py(), words)
                if len(tokens):  # copies within a block count once
                    held.setdefault(k, {})[set_key(tokens)] = tokens >> cut
        for k, sets in held.items():
            values = np.sort(np.concatenate(list(sets.values())))
            part = (values >> (bits - np.uint64(32))) * np.uint64(blocks) >> np.uint64(32)
            edges = np.flatnonzero(np.diff(part)) + 1
            for piece, r in zip(np.split(values, edges), part[np.concatenate(([0], edges))].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([k], pa.int64()), pa.array([packed(piece)], pa.binary())], ["range", "block", "values"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for r, k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(r, []).append((k, x))
        for parts in held.values():
            lists = [unpacked(x) for _, x in parts]
            values, n = np.unique(np.concatenate(lists), return_counts=True)
            values, n = values[n > 1], n[n > 1]
            if not len(values):
                continue
            for (k, _), x in zip(parts, lists, strict=True):
                own = np.unique(x)
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                hit = values[at] == own
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed(own[hit])], pa.binary()), pa.array([np.minimum(n[at[hit]], 2**31 - 1).astype("<u4").tobytes()], pa.binary())], ["block", "values", "counts"])

    def write(texts: pa.Table, shared: pa.Table) -> pa.Table:
        values = [unpacked(x) for x in shared.column("values").to_pylist()]
        values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        counts = np.frombuffer(b"".join(shared.column("counts").to_pylist()), "<u4").astype(np.int64)
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        rows: list[tuple] = []
        first: dict[bytes, tuple[int, np.ndarray]] = {}
        for d, t in zip(texts.column("doc_id").to_pylist(), texts.column("text"), strict=True):
            tokens = token_set(t.as_py(), words)
            key = set_key(tokens) if len(tokens) else None
            rows.append((0, d, len(tokens), key, None, None, None, None, None))
            if key is not None and d is not None and (key not in first or d < first[key][0]):
                first[key] = d, tokens
        for key, (d, tokens) in first.items():
            n = len(tokens)
            if len(values):
                at = np.minimum(np.searchsorted(values, tokens >> cut), len(values) - 1)
                held = np.where(values[at] == tokens >> cut, counts[at], 1)
                if found := signatures(tokens, held, percent):
                    rows += [(1, d, n, key, s - (1 << 64) if s >> 63 else s, p, slack, None, None) for s, p, slack in found]
                    rows.append((2, d, n, key, None, None, None, tokens.view(np.int64), parities(tokens)))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], COLUMNS)

    sent = map_arrow(dealt, send, "range long, block long, values binary")
    ranges = spread_out(sent, F.col("range"), blocks, "label").select("label", "block", "values")
    back = map_arrow(ranges, count, "block long, values binary, counts binary")
    return materialize(dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(write, KINDS), "signatures")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", shared.alias("i"), (F.size("ta") + F.size("tb")).alias("s")).where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i"))).select("a", "b")


def possible(percent: int):
    """Size and position leave enough tokens in common: i >= p (n + m) / (100 + p)."""
    most = F.greatest("slack", "slack_b") + F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    return (F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n") + F.col("n_b"))) & (F.lit(100) * F.least("n", "n_b") >= F.lit(percent) * F.greatest("n", "n_b"))


def alike(percent: int):
    """The parities leave enough tokens in common: with d different bits, i <= (n + m - d) / 2."""
    d = sum((F.bit_count(F.col("parity")[j].bitwiseXOR(F.col("parity_b")[j])) for j in range(PARITY)), F.lit(0))
    both = F.col("n") + F.col("n_b")
    return F.lit(100 + percent) * (both - d) >= F.lit(2 * percent) * both


def near_copies(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, and class_id, of every row.

    class_id is the smallest doc_id with the same set, component_id the smallest that links
    lead to. A text without words (a null one, too) has the empty set: it is linked with
    nothing. A row without doc_id is linked with nothing and has no ids. Rows that repeat a
    doc_id with different texts link these, and all have one component.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = written(texts, words, percent)
    docs = table.where("kind = 0").select("doc_id", "n", "key")
    classes = docs.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    # of copies, the document that stands for all
    first = table.where("kind > 0").join(classes.select("key", F.col("class_id").alias("doc_id")), ["key", "doc_id"])
    sigs = materialize(first.where("kind = 1").select("sig", "doc_id", "n", "pos", "slack"), "shared")
    sets = materialize(first.where("kind = 2").select("doc_id", "n", "tokens", "parity"), "sets")

    centres = sigs.groupBy("sig").agg(F.min(F.struct("pos", "n", "doc_id", "slack")).alias("c"), F.max("doc_id").alias("last"), F.min("doc_id").alias("least")).where("last > least")
    centres = centres.select("sig", F.col("c.doc_id").alias("doc_b"), F.col("c.n").alias("n_b"), F.col("c.pos").alias("pos_b"), F.col("c.slack").alias("slack_b"))
    pair = [F.least("doc_id", "doc_b").alias("a"), F.greatest("doc_id", "doc_b").alias("b")]
    tried = sigs.join(centres, "sig").where((F.col("doc_id") != F.col("doc_b")) & possible(percent)).select(*pair).distinct()
    tried = materialize(tried, "tried")
    links = materialize(verified(tried, sets, percent), "links")

    part = connected(links).select(F.col("node").alias("doc_id"), "component")
    placed = sigs.join(part, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("sig")
    placed = placed.join(apart, "sig", "left_semi").join(sets.select("doc_id", "parity"), "doc_id")
    placed = materialize(placed, "apart")
    other = placed.select("sig", *[F.col(c).alias(f"{c}_b") for c in ("n", "pos", "slack", "component", "parity")], F.col("doc_id").alias("doc_b"))
    more = placed.join(other, "sig").where((F.col("doc_id") < F.col("doc_b")) & (F.col("component") != F.col("component_b")) & possible(percent) & alike(percent))
    more = more.select(*pair).distinct().join(tried, ["a", "b"], "left_anti")
    links = materialize(links.unionByName(verified(more, sets, percent)), "all_links")

    # rows that repeat an id with different texts link the classes of these, each to the id
    text = F.coalesce("key", F.lit(b""))
    repeats = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("k0"), F.max(text).alias("k1")).where("k0 < k1").select("doc_id")
    same = docs.join(repeats, "doc_id", "left_semi").join(classes, "key").where("class_id <> doc_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    part = materialize(connected(links.unionByName(same)).select(F.col("node").alias("class_id"), "component"), "components")
    placed = materialize(classes.join(part, "class_id", "left").withColumn("component", F.coalesce("component", "class_id")), "placed")
    named = join_counted(docs.where("key is not null and doc_id is not null"), placed, ["key"], "copies", docs.count(), "left")
    empty = docs.where("key is null and doc_id is not null").join(part.withColumnRenamed("class_id", "doc_id"), "doc_id", "left").withColumn("class_id", F.col("doc_id"))
    alone = docs.where("doc_id is null").withColumn("class_id", F.col("doc_id")).withColumn("component", F.col("doc_id"))
    out = named.unionByName(empty).unionByName(alone)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
