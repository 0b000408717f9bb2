"""Lookups and filtered scans as plain DataFrame code: filters reach the scan, limits become top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import BATCH_MAX, CHANGE_EVENTS_MAX, EVENT_TYPES, U63_MAX, U128_MAX, AccountFilterFlags, AccountFlags, QueryFilterFlags, TransferFlags, to_bytes
from ..sources.scratch import materialize


@dataclass(frozen=True)
class AccountFilter:
    account_id: int
    user_data_128: int = 0
    user_data_64: int = 0
    user_data_32: int = 0
    code: int = 0
    timestamp_min: int = 0
    timestamp_max: int = 0
    limit: int = BATCH_MAX
    flags: int = AccountFilterFlags.DEBITS | AccountFilterFlags.CREDITS

    fields = ("user_data_128", "user_data_64", "user_data_32", "code")

    def valid(self) -> bool:
        sides = AccountFilterFlags.DEBITS | AccountFilterFlags.CREDITS
        return self.account_id not in (0, U128_MAX) and bool(self.flags & sides) and not self.flags >> 3 and good_range(self)

    def reversed(self) -> bool:
        return bool(self.flags & AccountFilterFlags.REVERSED)


@dataclass(frozen=True)
class QueryFilter:
    user_data_128: int = 0
    user_data_64: int = 0
    user_data_32: int = 0
    ledger: int = 0
    code: int = 0
    timestamp_min: int = 0
    timestamp_max: int = 0
    limit: int = BATCH_MAX
    flags: int = 0

    fields = ("user_data_128", "user_data_64", "user_data_32", "ledger", "code")

    def valid(self) -> bool:
        return not self.flags >> 1 and good_range(self)

    def reversed(self) -> bool:
        return bool(self.flags & QueryFilterFlags.REVERSED)


@dataclass(frozen=True)
class ChangeEventsFilter:
    timestamp_min: int = 0
    timestamp_max: int = 0
    limit: int = CHANGE_EVENTS_MAX

    fields = ()

    def valid(self) -> bool:
        return good_range(self)

    def reversed(self) -> bool:
        return False


Filter = AccountFilter | QueryFilter | ChangeEventsFilter


def good_range(f: Filter) -> bool:
    bounds = all(0 <= x <= U63_MAX for x in (f.timestamp_min, f.timestamp_max))
    return bounds and f.limit > 0 and (f.timestamp_max == 0 or f.timestamp_min <= f.timestamp_max)


def equal(df: DataFrame, name: str, value: int) -> Column:
    """Whether a column of either profile holds the value."""
    kind = dict(df.dtypes)[name]
    if kind == "binary":
        return F.col(name) == F.lit(bytearray(to_bytes(value)))
    if kind.startswith("decimal"):
        return F.col(name) == F.lit(Decimal(value))
    return F.col(name) == value if value <= U63_MAX else F.lit(False)


def predicate(df: DataFrame, f: Filter) -> Column:
    """Only what the filter asks for: a zero field asks for nothing, and a stored zero is never asked for."""
    tests = [equal(df, c, getattr(f, c)) for c in f.fields if getattr(f, c)]
    if f.timestamp_min:
        tests.append(F.col("timestamp") >= f.timestamp_min)
    if f.timestamp_max:
        tests.append(F.col("timestamp") <= f.timestamp_max)
    if isinstance(f, AccountFilter):
        sides = [equal(df, f"{s}_account_id", f.account_id) for s, flag in (("debit", AccountFilterFlags.DEBITS), ("credit", AccountFilterFlags.CREDITS)) if f.flags & flag]
        tests.append(reduce(Column.__or__, sides))
    return reduce(Column.__and__, tests, F.lit(True))


def scan(df: DataFrame, f: Filter, cap: int | None = BATCH_MAX) -> DataFrame:
    """The rows that f asks for, in its order, up to its limit and the cap. A broken filter gives none."""
    if not f.valid():
        return df.limit(0)
    by = F.col("timestamp")
    return df.where(predicate(df, f)).orderBy(by.desc() if f.reversed() else by.asc()).limit(min(f.limit, cap or f.limit))


def lookup(df: DataFrame, ids: list[int], cap: int | None = BATCH_MAX) -> DataFrame:
    """The row of each id in the order asked; ids that are missing are left out, repeated ones repeated.

    As many ids as a request may hold are broadcast; more of them only with cap=None, and then joined.
    """
    if cap and len(ids) > cap:
        raise ValueError(f"more than {cap} ids")
    if dict(df.dtypes)["id"] == "binary":
        asked = df.sparkSession.createDataFrame([(i, to_bytes(x)) for i, x in enumerate(ids)], "pos int, id binary")
    else:
        asked = df.sparkSession.range(1).select(F.posexplode(F.lit(list(ids)) if ids else F.array().cast("array<bigint>")).alias("pos", "id"))
    side = F.broadcast(asked) if cap else asked
    return df.join(side, "id").orderBy("pos").select(*df.columns)


def account_transfers(transfers: DataFrame, f: AccountFilter, cap: int | None = BATCH_MAX) -> DataFrame:
    return scan(transfers, f, cap)


def account_balances(accounts: DataFrame, events: DataFrame, f: AccountFilter, cap: int | None = BATCH_MAX) -> DataFrame:
    """timestamp and the four balances after each of the account's transfers; only of accounts that keep history.

    events has a row for each transfer with both accounts' balances after it, so the filter goes
    to it directly; expiries are no transfers and don't appear.
    """
    owner = accounts.where(equal(accounts, "id", f.account_id) & (F.col("flags").bitwiseAND(int(AccountFlags.HISTORY)) != 0))
    rows = scan(events.where(F.col("kind") != 4), f, cap)
    debit = equal(events, "debit_account_id", f.account_id)
    picked = [F.when(debit, F.col(f"dr_{c}")).otherwise(F.col(f"cr_{c}")).alias(c) for c in ("debits_pending", "debits_posted", "credits_pending", "credits_posted")]
    by = F.col("timestamp")
    return rows.join(F.broadcast(owner.limit(1).select(F.lit(1).alias("one"))), F.lit(1) == F.col("one"), "left_semi").select("timestamp", *picked).orderBy(by.desc() if f.reversed() else by)


def balance_as_of(accounts: DataFrame, events: DataFrame, account_id: int, timestamp: int) -> DataFrame:
    f = AccountFilter(account_id, timestamp_max=timestamp, limit=1, flags=7)
    return account_balances(accounts, events, f)


def change_events(events: DataFrame, transfers: DataFrame, accounts: DataFrame, f: ChangeEventsFilter, cap: int | None = CHANGE_EVENTS_MAX) -> DataFrame:
    """Events in time order, with their transfer's and both accounts' attributes.

    Balances and closed flags are those after the event; other attributes are as they are now. The events
    are cut down first, so the joins are of a request's size.
    """
    rows = scan(events, f, cap)
    clashing = [c for c in rows.columns if c.startswith("transfer_") and c != "transfer_key"]
    t = transfers.select(*[F.col(c).alias(f"transfer_{c}") for c in ("id", "pending_id", "user_data_128", "user_data_64", "user_data_32", "timeout", "code", "flags", "timestamp")])
    now = ("id", "user_data_128", "user_data_64", "user_data_32", "code", "flags", "timestamp")
    named = lambda side, key: accounts.select(*[F.col(c).alias(key if c == "id" else f"{side}_{c}") for c in now])
    kinds = F.element_at(F.array(*map(F.lit, EVENT_TYPES)), F.col("kind") + 1)
    joined = rows.drop(*clashing).join(t, F.col("transfer_key") == F.col("transfer_id"))
    for side, short in (("debit_account", "dr"), ("credit_account", "cr")):
        joined = joined.join(named(f"{side}_now", "key_"), F.col(f"{side}_id") == F.col("key_")).drop("key_")
        if f"{short}_flags" in joined.columns:  # as they were after the event
            joined = joined.withColumn(f"{side}_now_flags", F.col(f"{short}_flags"))
    return joined.withColumn("type", kinds).drop("kind").orderBy("timestamp")


def former_events(rows: DataFrame, transfers: DataFrame) -> DataFrame:
    """Events of an older kind, stored without their type, as rows for change_events().

    Rows that hold one side only are left out; the type is that of the transfer's flags. A row's transfer
    is that of its time, and of its transfer_key if rows have one, as times can repeat where ledgers were put together.
    """
    zero = lambda side: F.coalesce(equal(rows, f"{side}_account_id", 0), F.lit(True))
    flag = lambda x: F.col("now_flags").bitwiseAND(int(x)) != 0
    kind = F.when(flag(TransferFlags.PENDING), 1).when(flag(TransferFlags.POST_PENDING_TRANSFER), 2).when(flag(TransferFlags.VOID_PENDING_TRANSFER), 3).otherwise(0)
    now = transfers.select("timestamp", F.col("id").alias("transfer_key"), F.col("flags").alias("now_flags"))
    whole = rows.where(~zero("debit") & ~zero("credit")).drop("kind")
    return whole.join(now, ["timestamp", *(["transfer_key"] if "transfer_key" in rows.columns else [])]).withColumn("kind", kind).drop("now_flags")


def pages(df: DataFrame, f: Filter, size: int) -> Iterator[DataFrame]:
    """The scan of f in pages: each is asked for from just beyond the last row of the one before. The last one is short."""
    while f.valid():
        page = scan(df, replace(f, limit=size), None)
        edge = page.agg(F.count("*").alias("n"), (F.min if f.reversed() else F.max)("timestamp").alias("t")).first()
        yield page
        if edge["n"] < size or f.reversed() and edge["t"] <= 1:
            return
        f = replace(f, timestamp_max=edge["t"] - 1) if f.reversed() else replace(f, timestamp_min=edge["t"] + 1)


def paged(df: DataFrame, f: Filter, size: int) -> DataFrame:
    """The rows of all of pages() with page, the number of theirs, by one sort instead of a request for each page."""
    if not f.valid():
        return df.limit(0).withColumn("page", F.lit(0))
    by = F.desc("timestamp") if f.reversed() else F.asc("timestamp")
    rows = materialize(df.where(predicate(df, f)).repartitionByRange(by).withColumn("part_", F.spark_partition_id()), "paged")
    # a row for each range of times, which are as many as there are partitions
    before = rows.groupBy("part_").agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).drop("n_")
    place = F.row_number().over(Window.partitionBy("part_").orderBy(by)).cast("long") - 1 + F.col("before_")
    return rows.join(F.broadcast(before), "part_").withColumn("page", F.floor(place / size).cast("int")).drop("part_", "before_")


def answer_all(df: DataFrame, filters: list[Filter], cap: int | None = BATCH_MAX) -> DataFrame:
    """The answers to several filters, each tagged with its number in batch_index; broken ones have none."""
    parts = [scan(df, f, cap).withColumn("batch_index", F.lit(i)) for i, f in enumerate(filters)]
    return reduce(DataFrame.unionByName, parts)


def with_status(transfers: DataFrame, statuses: DataFrame, wanted: int) -> DataFrame:
    """An extension: pending transfers by what became of them. statuses: id and status (a PendingStatus) of each."""
    return transfers.join(statuses.where(F.col("status") == int(wanted)).select("id"), "id", "left_semi")


def union(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that any condition selects, each once."""
    return df.where(reduce(Column.__or__, conditions))


def intersection(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.where(reduce(Column.__and__, conditions))


def difference(df: DataFrame, keep: Column, drop: Column) -> DataFrame:
    """An extension: rows that one condition selects and another doesn't."""
    return df.where(keep & ~F.coalesce(drop, F.lit(False)))
