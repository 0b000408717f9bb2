"""A cleaning pipeline over documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import table
from tallyframe.llm.jaccard import near_copies
from tallyframe.llm.lines import dedup_lines
from tallyframe.llm.quality import score_quality, train_quality
from tallyframe.llm.queries import VOCABULARY
from tallyframe.llm.secrets import mask_secrets
from tallyframe.llm.tokens import pack
from tallyframe.sources.scratch import materialize, scratch


def recounted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of before, with n_chars as the text now is."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return docs.select(*before.columns)


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until docs has no such columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return tuple(out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is judged as an empty one; rows without doc_id and rows that repeat one are judged each. Columns of
    whatever names keep their values. Without any labels, or any documents that have one, all stay.
    """
    weights = train_quality(docs, table(spark, sf_dir, "labels"))
    names = unused(docs, "score", "predicted")
    return score_quality(docs, weights, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more share stay in one.

    A null text becomes an empty one; rows without doc_id keep all lines; rows that repeat a doc_id are one document.
    """
    return recounted(dedup_lines(docs, counts=unused(docs, "n_lines", "n_dropped")), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; those without doc_id or words stay.

    Where rows repeat a doc_id with different texts, each row is a document of its own; rows that are alike in every column are one.
    """
    (row_no,) = unused(docs, "row_no")
    mark = F.xxhash64("text")
    by_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(mark) < F.max(mark)).alias("differ"))
    repeats, differ = by_id.agg(F.max("n") > 1, F.max(F.col("differ") & F.col("doc_id").isNotNull())).first()
    if not differ:
        rows = docs.withColumn(row_no, F.col("doc_id"))
    else:
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
        rows = materialize(docs.orderBy("doc_id", "text").withColumn(row_no, number), "rows")
    found = near_copies(rows, id_col=row_no).where("component_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(row_no)).distinct()
    kept = rows.join(found, row_no, "left_anti").drop(row_no)
    return (kept.dropDuplicates() if repeats else kept).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked. A null text stays null, with no characters; every row is looked at by itself."""
    return recounted(mask_secrets(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut and packed into sequences. A null text is an empty one, which is the closing id alone; every row is a document."""
    return pack(docs, VOCABULARY)


STAGES = [("quality", quality), ("lines", lines), ("near copies", near), ("secrets", secrets), ("packing", packing)]
#: SQL has no tokenizer and no classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what they write on the way is deleted once the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
