"""Ledgers out of the test tables: accounts and transfers in the compact profile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import shared_dir

TRANSFER = ("id", "debit_account_id", "credit_account_id", "amount", "pending_id", "user_data_128", "user_data_64", "user_data_32", "timeout", "ledger", "code", "flags", "timestamp")
ACCOUNT = ("id", "debits_pending", "debits_posted", "credits_pending", "credits_posted", "user_data_128", "user_data_64", "user_data_32", "reserved", "ledger", "code", "flags", "timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def full(df: DataFrame) -> DataFrame:
    """The columns of a transfer, zero where df has none."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in TRANSFER])


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transfer for each event, from its user to the next user of the same of five ledgers."""
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("user_id")).scalar()  # a subquery that runs once, whatever the plan holds of it
    u = F.col("user_id")
    partner = F.when(u + 5 <= top, u + 5).otherwise(u % 5) + 1
    code = F.element_at(F.create_map(*[F.lit(x) for kv in (("click", 1), ("view", 2), ("purchase", 3), ("signup", 4), ("error", 5)) for x in kv]), F.col("event_type"))
    return full(e.select(
        (F.col("event_id") + 1).alias("id"), (u + 1).alias("debit_account_id"), partner.alias("credit_account_id"), F.round(F.col("value") * 100).cast("long").alias("amount"),
        (u % 10).alias("user_data_128"), (F.col("event_id") % 100).alias("user_data_64"), (F.col("event_id") % 7).alias("user_data_32"),
        (u % 5 + 1).alias("ledger"), code.alias("code"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
    ))


def event_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account for each user; all keep history."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return accounts(users.select((F.col("user_id") + 1).alias("id"), (F.col("user_id") % 5 + 1).alias("ledger"), F.lit(1).alias("code"), F.lit(8).alias("flags"), (F.col("user_id") + 1).alias("timestamp")))


def accounts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in ACCOUNT])


def two_phase_transfers(spark: SparkSession, sf_dir: str, timeout: int = 86_400) -> DataFrame:
    """The events as two-phase transfers: a user's k-th purchase posts, and k-th error voids, the k-th view, which is pending for a day."""
    t = event_transfers(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("debit_account_id", "code").orderBy("timestamp"))
    t = t.withColumn("k", nth)
    views = t.where("code = 2").select("debit_account_id", "k", F.col("id").alias("view_id"), F.col("amount").alias("view_amount"))
    t = t.join(views, ["debit_account_id", "k"], "left")
    post, void, view = F.col("code") == 3, F.col("code") == 5, F.col("code") == 2
    resolves = post | void
    return full(t.select(
        "id", "user_data_128", "user_data_64", "user_data_32", "ledger", "timestamp",
        F.when(resolves, 0).otherwise(F.col("code")).alias("code"),
        F.when(resolves, 0).otherwise(F.col("debit_account_id")).alias("debit_account_id"), F.when(resolves, 0).otherwise(F.col("credit_account_id")).alias("credit_account_id"),
        F.when(post, F.least(F.col("amount"), F.coalesce("view_amount", "amount"))).when(void, 0).otherwise(F.col("amount")).alias("amount"),
        F.when(resolves, F.coalesce("view_id", F.col("id") + 1_000_000_000)).otherwise(0).alias("pending_id"),
        F.when(view, 2).when(post, 4).when(void, 8).otherwise(0).alias("flags"), F.when(view, timeout).otherwise(0).alias("timeout"),
    ))


def order_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and an operator for each nation."""
    c = table(spark, sf_dir, "customer")
    own = c.select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_nationkey").alias("user_data_64"), (F.col("c_custkey") % 4).alias("user_data_32"), F.lit(1).alias("ledger"), F.lit(10).alias("code"), (F.col("c_custkey") + 1).alias("timestamp"))
    n = table(spark, sf_dir, "nation")
    ops = n.select((F.col("n_nationkey") + 2_000_000).alias("id"), F.col("n_nationkey").alias("user_data_64"), F.lit(0).alias("user_data_32"), F.lit(1).alias("ledger"), F.lit(20).alias("code"), (F.col("n_nationkey") + 500_000_000).alias("timestamp"))
    return accounts(own.unionByName(ops))


#: Ledgers that were stored, by session and source.
_stored: dict[tuple, str] = {}


def line_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transfer for each line, from the customer to the supplier, as a ledger stores them.

    They are written once for a session, in order of their ids and times, so that filters and columns reach the scan; again if the source has changed.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    key = spark.sparkContext.applicationId, sf_dir, status.getLen(), status.getModificationTime()
    if key not in _stored:
        path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex[:12]}"
        made_line_transfers(spark, sf_dir).repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.parquet(path)
        _stored[key] = path
    return spark.read.schema(", ".join(f"{c} long" for c in TRANSFER)).parquet(_stored[key])


def made_line_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfers of the lines. The id orders whole rows, which are distinct; it is made of key parts, so no global sort is needed."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    same = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = li.withColumn("k", F.row_number().over(same)).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_orderkey") * 1000 + F.col("k")
    return full(rows.select(
        key.alias("id"), key.alias("timestamp"), (F.col("o_custkey") + 1_000_000).alias("debit_account_id"), (F.col("l_suppkey") + 3_000_000).alias("credit_account_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"), F.col("l_partkey").alias("user_data_64"), F.col("l_linenumber").alias("user_data_32"), F.lit(1).alias("ledger"),
        (F.ascii("l_returnflag") - 64).alias("code"),
    ))
