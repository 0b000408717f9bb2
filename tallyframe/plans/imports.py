"""Imports as a plan: whether a time goes back behind those before it is a running maximum, as only good rows raise it and each one made is above it.

For logs whose ids come once, without posts and voids, and whose imported accounts come before all transfers; nothing else in them may hang on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import NS, U63_MAX, AccountFlags, PendingStatus, TransferFlags
from ..sources.scratch import materialize
from .accept import BALANCES, DATA, account_rules, first_of, has, transfer_rules, with_accounts

#: So many rows in order are looked through by a task.
ROWS = 50_000
REGRESS = "imported_event_timestamp_must_not_regress"
PLACE = ("batch", "idx")


def outer(imported: Column) -> Column:
    """The status of an event by its batch, of which `imports` says whether it imports."""
    c = F.col
    return first_of(
        (imported & ~c("imports"), "imported_event_not_expected"), (~imported & c("imports"), "imported_event_expected"), (imported & (c("timestamp") < 1), "imported_event_timestamp_out_of_range"),
        (imported & (c("timestamp") >= c("batch_time")), "imported_event_timestamp_must_not_advance"), (~imported & (c("timestamp") != 0), "timestamp_must_be_zero"),
    )


def with_last(rows: DataFrame, n: int, time: Column) -> DataFrame:
    """The rows with last_, the largest time (null counts for nothing) of those before in order of batch and idx, or 0.

    Stretches of the order are looked through apart; their maxima, one a task, then add what lies before each.
    """
    dealt = rows.withColumn("time_", time).repartitionByRange(n // ROWS + 1, *PLACE).withColumn("part_", F.spark_partition_id())
    dealt = materialize(dealt, "in-order")
    ends = dealt.groupBy("part_").agg(F.max("time_").alias("end_"))
    earlier = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("part_", F.coalesce(F.max("end_").over(earlier("part_")), F.lit(0)).alias("before_"))
    own = F.coalesce(F.max("time_").over(Window.partitionBy("part_").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("own_", own).join(F.broadcast(before), "part_").withColumn("last_", F.greatest("own_", "before_")).drop("part_", "time_", "own_", "before_")


def accounts_of(accounts: DataFrame, n: int) -> DataFrame:
    """The rows with status and stamped. accounts: with at and imports."""
    imported = has(F.col("flags"), AccountFlags.IMPORTED)
    early, late = account_rules()
    rows = accounts.withColumn("outer_", outer(imported)).withColumn("fails_", F.coalesce("outer_", early, late))
    rows = rows.withColumn("stamped", F.when(imported & F.col("outer_").isNull(), F.col("timestamp")).otherwise(F.col("at")))
    rows = with_last(rows, n, F.when(F.col("fails_").isNull(), F.col("stamped")))
    return rows.withColumn("status", F.coalesce("fails_", first_of((imported & (F.col("stamped") <= F.col("last_")), REGRESS)), F.lit("created"))).drop("outer_", "fails_", "last_")


def transfers_of(transfers: DataFrame, accounts: DataFrame, n: int) -> DataFrame:
    """The rows as accept() gives them. accounts: those made, with id, ledger, at, flags and stamped; transfers: with at and imports."""
    c = F.col
    imported = has(c("flags"), TransferFlags.IMPORTED)
    early, late = transfer_rules()
    rows = with_accounts(transfers.withColumn("outer_", outer(imported)), accounts.drop("stamped"))
    for side in ("debit", "credit"):
        rows = rows.join(accounts.select(c("id").alias(f"{side}_account_id"), c("stamped").alias(f"{side}_stamped")), f"{side}_account_id", "left")
    taken = accounts.where(has(c("flags"), AccountFlags.IMPORTED)).groupBy(c("stamped").alias("timestamp")).agg(F.min("at").alias("taken_at_"))
    rows = rows.join(taken, "timestamp", "left")
    rows = rows.withColumn("stamped", F.when(imported & c("outer_").isNull(), c("timestamp")).otherwise(c("at")))
    first = F.coalesce("outer_", early, late, "accounts_")
    clash = imported & F.coalesce(c("taken_at_") < c("at"), F.lit(False))  # with the time of an account
    then = first_of(
        *[(imported & (c("stamped") <= c(f"{s}_stamped")), f"imported_event_timestamp_must_postdate_{s}_account") for s in ("debit", "credit")],
        (imported & (c("timeout") != 0), "imported_event_timeout_must_be_zero"), (c("timeout") > F.expr(f"({U63_MAX} - at) div {NS}"), "overflows_timeout"),
    )
    rows = rows.withColumns({"first_": first, "clash_": clash, "then_": then}).drop("debit_stamped", "credit_stamped", "taken_at_", "accounts_", "outer_")
    rows = with_last(rows, n, F.when(c("first_").isNull() & c("then_").isNull() & ~c("clash_"), c("stamped")))
    status = F.coalesce("first_", first_of((c("clash_") | imported & (c("stamped") <= c("last_")), REGRESS)), "then_", F.lit("created"))
    rows = rows.withColumn("status", status).drop("first_", "then_", "clash_", "last_")
    none = F.lit(None).cast("long")
    out = {f"p_{x}": none for x in ("id", "timestamp", "expires", "flags", "debit_account_id", "credit_account_id", "ledger", "code", "amount", "timeout", *DATA)}
    kind = F.when(has(c("flags"), TransferFlags.PENDING), int(PendingStatus.PENDING)).otherwise(int(PendingStatus.NONE))
    return rows.withColumns({**out, "kind": kind, "taken": c("amount"), "done_": F.lit(False), "at": c("stamped")})


def accept_imports(events: DataFrame, counts: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Accounts and transfers of a log, with status and stamped. counts: how many of both there are."""
    imports = F.when(F.col("what") == "account", int(AccountFlags.IMPORTED)).otherwise(int(TransferFlags.IMPORTED))
    firsts = events.groupBy("batch", "what").agg(F.min(F.struct("idx", "flags"))["flags"].alias("first"))
    firsts = materialize(firsts.select("batch", "what", (F.col("first").bitwiseAND(imports) != 0).alias("imports")), "firsts")
    rows = events.join(firsts, ["batch", "what"])
    own = (*PLACE, "at", "batch_time", "imports", "id", *DATA, "ledger", "code", "flags", "timestamp")
    accounts = accounts_of(rows.where("what = 'account'").select(*own, "reserved", *BALANCES), counts[0])
    made = materialize(accounts.where("status = 'created'").select("id", "ledger", "at", "flags", "stamped"), "made")
    moved = rows.where("what = 'transfer'").select(*own, "debit_account_id", "credit_account_id", "amount", "pending_id", "timeout")
    return accounts, transfers_of(moved, made, counts[1])
