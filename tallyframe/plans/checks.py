"""The invariants of the books as plans: a row for each, with the number of places that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import AccountFlags, PendingStatus

WHOLE = "decimal(38,0)"
BALANCES = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")


def halves(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with each number n as n_hi and n_lo, its upper and lower 64 bits: sums of either stay exact."""

    def part(name: str, at: int) -> Column:
        if dict(df.dtypes)[name] != "binary":
            return F.col(name).cast(WHOLE) if at else F.lit(0).cast(WHOLE)
        return F.conv(F.hex(F.substring(name, 1 + 8 * at, 8)), 16, 10).cast(WHOLE)

    return df.select("*", *[part(n, at).alias(f"{n}_{'lo' if at else 'hi'}") for n in names for at in (0, 1)])


def sign(high: Column, low: Column) -> Column:
    """-1, 0 or 1 for high * 2 ** 64 + low."""
    word = F.lit(str(1 << 64)).cast(WHOLE)
    left = F.pmod(low, word)
    total = high + ((low - left) / word).cast(WHOLE)
    return F.when(total != 0, F.signum(total)).otherwise(F.signum(left)).cast("int")


def difference(plus: list[str], minus: list[str], of=F.col) -> Column:
    """The sign of the sum of some numbers less that of others."""
    side = lambda names, half: reduce(Column.__add__, [of(f"{n}_{half}") for n in names])
    return sign(*[(side(plus, h) - side(minus, h)).cast(WHOLE) for h in ("hi", "lo")])


def violations(accounts: DataFrame, transfers: DataFrame, events: DataFrame, statuses: DataFrame) -> DataFrame:
    """invariant, broken (long).

    accounts, transfers: records of either profile. events: timestamp, kind, transfer_key of each change.
    statuses: id and status of each pending transfer. Every check is an aggregate or an equi-join.
    """
    books = halves(accounts, BALANCES)
    summed = lambda c: F.sum(c)
    by_ledger = books.groupBy("ledger").agg(difference(["debits_posted"], ["credits_posted"], summed).alias("posted"), difference(["debits_pending"], ["credits_pending"], summed).alias("pending"))
    times = accounts.select("timestamp").unionByName(transfers.select("timestamp")).groupBy("timestamp").count()
    made = events.where(F.col("kind") != int(PendingStatus.EXPIRED)).groupBy(F.col("transfer_key").alias("id")).agg(F.count("*").alias("n"))
    logged = transfers.select("id").join(made, "id", "full_outer").where(F.coalesce("n", F.lit(0)) != 1)
    unknown = made.join(transfers, "id", "left_anti")

    def beyond(flag: AccountFlags, side: str, other: str) -> DataFrame:
        over = difference([f"{side}_pending", f"{side}_posted"], [f"{other}_posted"]) > 0
        return books.where((F.col("flags").bitwiseAND(int(flag)) != 0) & over)

    ends = events.where(F.col("kind").isin(2, 3, 4)).join(transfers.select(F.col("id").alias("transfer_key"), "pending_id"), "transfer_key")
    ends = ends.groupBy(F.when(F.col("kind") == 4, F.col("transfer_key")).otherwise(F.col("pending_id")).alias("id")).agg(F.count("*").alias("n"))
    waiting = halves(transfers.join(statuses.where(F.col("status") == int(PendingStatus.PENDING)).select("id"), "id"), ("amount",))
    held = waiting.groupBy("ledger").agg(F.sum("amount_hi").alias("held_hi"), F.sum("amount_lo").alias("held_lo"))
    kept = books.groupBy("ledger").agg(F.sum("debits_pending_hi").alias("kept_hi"), F.sum("debits_pending_lo").alias("kept_lo"))
    zero = F.lit(0).cast(WHOLE)
    both = held.join(kept, "ledger", "full_outer").select("ledger", *[F.coalesce(c, zero).alias(c) for c in ("held_hi", "held_lo", "kept_hi", "kept_lo")])
    side = lambda name: accounts.select(F.col("id").alias(f"{name}_account_id"), F.col("ledger").alias(f"{name}_ledger"))
    placed = transfers.join(side("debit"), "debit_account_id", "left").join(side("credit"), "credit_account_id", "left")
    misplaced = placed.where((F.col("debit_account_id") == F.col("credit_account_id")) | ~F.col("ledger").eqNullSafe(F.col("debit_ledger")) | ~F.col("ledger").eqNullSafe(F.col("credit_ledger")))
    found = {
        "ledgers balance": by_ledger.where("posted <> 0 or pending <> 0"),
        "timestamps are unique": times.where("count > 1"),
        "a transfer has one event": logged.select("id").unionByName(unknown.select("id")),
        "debits stay within credits": beyond(AccountFlags.DEBITS_MUST_NOT_EXCEED_CREDITS, "debits", "credits"),
        "credits stay within debits": beyond(AccountFlags.CREDITS_MUST_NOT_EXCEED_DEBITS, "credits", "debits"),
        "a pending transfer ends once": ends.where("n > 1"),
        "pending balances are held": both.where(difference(["held"], ["kept"]) != 0),
        "transfers stay in their ledger": misplaced,
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("invariant"), F.count("*").alias("broken")) for name, rows in found.items()])
