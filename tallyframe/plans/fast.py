"""Order-free and two-phase batches as pure DataFrame plans: signed legs, prefix sums, first resolver wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import NS
from .accept import BALANCES, DATA, accept, account_rules, transfer_rules


def static_status() -> Column:
    """The checks of an ordinary transfer that need nothing but its own fields, in order; null if all pass."""
    return F.coalesce(*transfer_rules())


def account_status() -> Column:
    """The checks of a new account that need nothing but its own fields, in order; null if all pass."""
    return F.coalesce(*account_rules())


def two_phase(transfers: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """status, kind and p_* (the pending transfer's fields) for batches of single, pending, post and void transfers, at their timestamps.

    A created post or void has the amount that it takes and the user data that it inherits, as it is kept.
    """
    return as_kept(accept(transfers.withColumn("at", F.col("timestamp")).withColumn("timestamp", F.lit(0).cast("long")), accounts))


def as_kept(accepted: DataFrame) -> DataFrame:
    """The rows of accept() at the time they were given, with the amount and user data that are kept, and amount_requested."""
    src = F.col("p_id").isNotNull()
    inherited = {n: F.when(src & (F.col(n) == 0), F.col(f"p_{n}")).otherwise(F.col(n)) for n in DATA}
    amount = F.when(src, F.col("taken")).otherwise(F.col("amount"))
    return accepted.withColumns({**inherited, "timestamp": F.col("at"), "amount_requested": F.col("amount"), "amount": amount}).drop("at", "taken")


def expiries(resolved: DataFrame, now: int | None = None) -> DataFrame:
    """A row for each pending transfer that ran out unresolved, by now if given: kind 4, at the time it was due."""
    out = resolved.where((F.col("status") == "created") & (F.col("kind") == 1) & (F.col("timeout") > 0) & ~F.col("done_"))
    out = out.withColumn("due", F.col("timestamp") + F.col("timeout") * NS)
    return out if now is None else out.where(F.col("due") <= now)


def effects(resolved: DataFrame, expired: DataFrame | None = None) -> DataFrame:
    """A row for each thing that moved balances: its accounts, what it moved, what it freed, and the transfer's fields. Where expired has seq, see event_log()."""
    whole = "p_id" in resolved.columns
    sides = [F.col(n) for n in ("debit_flags", "credit_flags") if n in resolved.columns]
    rest = ["user_data_128", "user_data_64", "user_data_32", *[F.col(n).alias(f"transfer_{n}") if n == "flags" else n for n in ("amount_requested", "flags", "batch") if n in resolved.columns]]
    pick = lambda n: F.when(F.col("p_id").isNotNull(), F.col(f"p_{n}")).otherwise(F.col(n)).alias(n) if whole else F.col(n)
    rows = resolved.where("status = 'created'").select(
        "timestamp", F.lit(0).alias("seq"), F.col("kind") if whole else F.lit(0).alias("kind"), "amount", (F.coalesce("p_amount", F.lit(0)) if whole else F.lit(0)).cast("long").alias("freed"),
        pick("debit_account_id"), pick("credit_account_id"), pick("ledger"), pick("code"), *rest, F.col("id").alias("transfer_key"), *sides,
    )
    if expired is None:
        return rows
    gone = expired.select(
        F.col("due").alias("timestamp"), (F.col("seq") if "seq" in expired.columns else F.lit(1)).alias("seq"), F.lit(4).alias("kind"), "amount", F.col("amount").alias("freed"),
        "debit_account_id", "credit_account_id", "ledger", "code", *rest, F.col("id").alias("transfer_key"), *sides,
    )
    return rows.unionByName(gone)


def in_legs(rows: DataFrame, *carried: str) -> DataFrame:
    """Two rows for each effect, one an account: account_id, debit (whether it's that side), the change of each balance, and carried, with the debit only."""
    pending = F.when(F.col("kind") == 1, F.col("amount")).otherwise(-F.col("freed")).cast("long")
    posted = F.when(F.col("kind").isin(0, 2), F.col("amount")).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    held = lambda mine: [F.when(F.lit(mine), F.col(n)).alias(n) for n in carried]
    side = lambda key, mine, *moved: F.struct(F.col(key).alias("account_id"), F.lit(mine).alias("debit"), *[m.alias(b) for b, m in zip(BALANCES, moved, strict=True)], *held(mine))
    both = F.array(side("debit_account_id", True, pending, posted, zero, zero), side("credit_account_id", False, zero, zero, pending, posted))
    return rows.select("timestamp", "seq", "kind", "transfer_key", F.explode(both).alias("leg")).select("timestamp", "seq", "kind", "transfer_key", "leg.*")


def legs(resolved: DataFrame, expired: DataFrame | None = None) -> DataFrame:
    """Two rows for each effect, one an account: (account_id, timestamp, seq, and the change of each balance)."""
    return in_legs(effects(resolved, expired)).drop("debit", "transfer_key")


def running(legs_: DataFrame, *kept: str, slice_ns: int | None = None) -> DataFrame:
    """Balances of each account after each of its legs.

    With slice_ns an account's legs are dealt by such stretches of time, summed up within each, and the sums of the stretches before
    are added, so that an account with a good part of all legs is no single task.
    """
    keys = ["account_id"]
    if slice_ns:
        keys.append("slice")
        legs_ = legs_.withColumn("slice", F.expr(f"timestamp div {slice_ns}")).repartition(*keys)
    w = Window.partitionBy(*keys).orderBy("timestamp", "seq", *(["transfer_key"] if "transfer_key" in kept else [])).rowsBetween(Window.unboundedPreceding, 0)
    out = legs_.select(*keys, "timestamp", "seq", "kind", *[F.sum(b).over(w).alias(b) for b in BALANCES], *kept)
    if not slice_ns:
        return out
    before = Window.partitionBy("account_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = legs_.groupBy(*keys).agg(*[F.sum(b).alias(b) for b in BALANCES])
    totals = totals.select(*keys, *[F.coalesce(F.sum(b).over(before), F.lit(0)).alias(f"{b}_0") for b in BALANCES])
    return out.join(totals, keys).select("account_id", "timestamp", "seq", "kind", *[(F.col(b) + F.col(f"{b}_0")).alias(b) for b in BALANCES], *kept)


def final(legs_: DataFrame) -> DataFrame:
    return legs_.groupBy("account_id").agg(*[F.sum(b).alias(b) for b in BALANCES])


def event_log(resolved: DataFrame, expired: DataFrame | None = None, slice_ns: int | None = None) -> DataFrame:
    """A row for each effect with both accounts' balances after it, and their flags where resolved has them.

    One window by account over the legs, which carry the effect with the debit, and one aggregation that puts two legs together.
    Expiries with a seq below 0 come before all else of their time, and are given times that count back from it, up to it at -1.
    """
    rows = effects(resolved, expired)
    carried = [c for c in rows.columns if c not in ("timestamp", "seq", "kind", "transfer_key", "freed", "debit_account_id", "credit_account_id")]
    after = running(in_legs(rows, *carried), "debit", "transfer_key", *carried, slice_ns=slice_ns)
    of = lambda mine, c, name: F.max(F.when(F.col("debit") == mine, F.col(c))).alias(name)
    sides = [(True, "dr"), (False, "cr")]
    out = after.groupBy("timestamp", "seq", "kind", "transfer_key").agg(
        of(True, "account_id", "debit_account_id"), of(False, "account_id", "credit_account_id"), *[F.max(c).alias(c) for c in carried], *[of(m, b, f"{s}_{b}") for m, s in sides for b in BALANCES],
    )
    out = out.withColumn("timestamp", F.col("timestamp") + F.least(F.col("seq") + 1, F.lit(0)))
    return out.drop("seq").withColumnsRenamed({"debit_flags": "dr_flags", "credit_flags": "cr_flags"})


def chain_ids(events: DataFrame, order: str = "timestamp", batch: tuple[str, ...] = ("batch",)) -> DataFrame:
    """chain: numbers the linked chains and single events of each batch."""
    w = Window.partitionBy(*batch).orderBy(order)
    starts = F.coalesce(F.lag(F.col("flags").bitwiseAND(1)).over(w) == 0, F.lit(True))
    return events.withColumn("chain", F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def assigned_timestamps(events: DataFrame, batch: str, index: str, ends: dict[int, int]) -> DataFrame:
    """timestamp of each event: its batch's end, less the events after it. ends: by batch, as many as requests are in flight."""
    size = F.count("*").over(Window.partitionBy(batch))
    end = F.element_at(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]), F.col(batch))
    return events.withColumn("timestamp", end - size + F.col(index) + 1)
