"""The queries of the training-data operators, over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jaccard import near_copies
from .lines import dedup_lines
from .quality import learnable, score_quality, train_quality
from .secrets import scan_secrets
from .sharding import assign_shards
from .tokens import count_tokens, pack, round_trip
from .vectors import exact_top_k, nearest

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOTS = 2039


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, SHARDS, SLOTS)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, weights).select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_shard_documents, op2_line_dedup, op3_secret_scan, op4_token_counts, op5_bpe_round_trip, op6_quality, op7_best_fit, op8_jaccard_join, op9_exact_search, op10_nearest, pipeline]
    return {f.__name__: f for f in found}


def shard_sql() -> str:
    """Fills the table slot by slot in SQL, from the shards' names alone."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SHARDS))
    digest = lambda salt: f"('0x' || substr(md5('{salt}:' || name), 1, 15))::BIGINT"
    n, m = len(SHARDS), SLOTS
    return f"""
WITH RECURSIVE shards(i, name) AS (VALUES {names}),
prefer AS (SELECT list(({digest("offset")} % {m})::BIGINT ORDER BY i) AS offs, list((1 + {digest("skip")} % {m - 1})::BIGINT ORDER BY i) AS skips FROM shards),
fill(turn, owner) AS (
  SELECT 0, list_transform(range({m}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, list_transform(range({m}), lambda x: CASE WHEN x = slot THEN turn % {n} ELSE owner[x + 1] END)
  FROM (
    SELECT turn, owner, list_filter(list_transform(range({m}), lambda j: (offs[turn % {n} + 1] + j * skips[turn % {n} + 1]) % {m}), lambda s: owner[s + 1] < 0)[1] AS slot
    FROM fill, prefer WHERE turn < {m}
  )
),
filled AS (SELECT owner FROM fill WHERE turn = {m}),
slots AS (SELECT unnest(range({m})) AS slot, unnest(owner) AS i FROM filled)
SELECT d.doc_id, s.slot::BIGINT AS slot, n.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {m} AS slot FROM documents) d
JOIN slots s ON d.slot = s.slot JOIN shards n ON n.i = s.i"""


LINES_SQL = """
WITH lines AS (
  SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), many AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, coalesce(k.doc_id < m.keeper, false) AS lost FROM keyed k LEFT JOIN many m ON k.key = m.key
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c::BIGINT AS component_id
FROM sets s JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) r ON r.node = s.doc_id"""

SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_shard_documents": shard_sql(), "op2_line_dedup": LINES_SQL, "op8_jaccard_join": JACCARD_SQL, "op9_exact_search": SEARCH_SQL}
