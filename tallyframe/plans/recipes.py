"""Compositions of linked transfers as columns: arrays of transfers that a request holds for each row.

Accounts, ids and amounts are columns or numbers. A recipe's transfers take ids from first on and are
linked: all of them come through, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import TransferFlags
from .accept import ALL

T = TransferFlags
FIELDS = ("id", "debit_account_id", "credit_account_id", "amount", "pending_id", "user_data_128", "user_data_64", "user_data_32", "timeout", "ledger", "code", "flags", "timestamp")
Value = Column | int


def move(debit: Value, credit: Value, amount: Value, ledger: Value, flags: int = 0, code: Value = 1, **more: Value) -> dict:
    return {"debit_account_id": debit, "credit_account_id": credit, "amount": amount, "ledger": ledger, "code": code, "flags": int(flags), **more}


def void(pending_id: Value) -> dict:
    return {"pending_id": pending_id, "flags": int(T.VOID_PENDING_TRANSFER)}


def single(first: Column, *moves: dict) -> Column:
    """The moves as they are, each for itself."""
    cell = lambda m, n: (m[n] if isinstance(m.get(n), Column) else F.lit(m.get(n, 0))).cast("long").alias(n)
    return F.array(*[F.struct(*[cell({"id": first + i, **m}, n) for n in FIELDS]) for i, m in enumerate(moves)])


def linked(first: Column, *moves: dict) -> Column:
    """The moves as a chain."""
    return single(first, *[{**m, "flags": m["flags"] | (int(T.LINKED) if i < len(moves) - 1 else 0)} for i, m in enumerate(moves)])


def exchange(first: Column, payer: tuple[Value, Value], provider: tuple[Value, Value], sold: Value, bought: Value, ledgers: tuple[Value, Value], fee: Value | None = None) -> Column:
    """Currency for currency: payer and provider have an account in either ledger, and the provider can take a fee."""
    paid = [move(payer[0], provider[0], x, ledgers[0]) for x in ([sold] if fee is None else [sold, fee])]
    return linked(first, *paid, move(provider[1], payer[1], bought, ledgers[1]))


def many_to_many(first: Column, debits: list[tuple[Value, Value]], credits: list[tuple[Value, Value]], control: Value, ledger: Value) -> Column:
    """Several debits and credits, (account, amount) each, by way of a control account."""
    return linked(first, *[move(a, control, x, ledger) for a, x in debits], *[move(control, a, x, ledger) for a, x in credits])


def gather(first: Column, sources: list[Value], target: Value, amount: Value, setup: Value, limit: Value, ledger: Value) -> Column:
    """The amount from the sources, as much as each has, in their order; all of it or nothing. limit and sources may not owe."""
    both = T.BALANCING_DEBIT | T.BALANCING_CREDIT
    return linked(first, move(setup, limit, amount, ledger), *[move(s, setup, amount, ledger, both) for s in sources], move(setup, target, amount, ledger), move(limit, setup, ALL, ledger, T.BALANCING_CREDIT))


def close_debit(first: Column, account: Value, counter: Value, ledger: Value) -> Column:
    """Move what a credit account holds to counter, and close it; voiding the second transfer opens it again."""
    return linked(first, move(account, counter, ALL, ledger, T.BALANCING_DEBIT), move(account, counter, 0, ledger, T.CLOSING_DEBIT | T.PENDING))


def if_balance(first: Column, source: Value, target: Value, amount: Value, threshold: Value, control: Value, ledger: Value) -> Column:
    """A transfer if the source, which may not owe, holds the threshold at least."""
    return linked(first, move(source, control, threshold, ledger, T.PENDING), void(first), move(source, target, amount, ledger))


def no_credit_balance(first: Column, source: Value, target: Value, amount: Value, control: Value, ledger: Value) -> Column:
    """A transfer if it leaves the target without a credit balance. control has no balance and may not be owed."""
    return linked(first, move(source, target, amount, ledger), move(target, control, 1, ledger, T.PENDING | T.BALANCING_DEBIT), void(first + 1))


def up_to(first: Column, source: Value, target: Value, amount: Value, limit: Value, control: Value, operator: Value, ledger: Value) -> Column:
    """A transfer if the target then holds the limit at most. control may not be owed."""
    return linked(first, move(source, target, amount, ledger), move(control, operator, limit, ledger), move(target, control, ALL, ledger, T.BALANCING_DEBIT | T.PENDING), void(first + 2), move(operator, control, limit, ledger))


def request(rows: DataFrame, batch: int, time: int, width: int = 16, size: int = 10**9, what: str = "transfer") -> DataFrame:
    """A batch for the engine out of rows with key (from 0 on) and records, an array of width at most: those of a row follow each other.

    Places in the batch come from the keys and may have gaps, so nothing has to be counted or sorted.
    """
    found = rows.select("key", F.posexplode("records").alias("pos", "r")).withColumn("idx", (F.col("key") * width + F.col("pos")).cast("long"))
    number = lambda n: F.lit(n).cast("long")
    return found.select("key", "pos", F.lit(what).alias("what"), number(batch).alias("batch"), "idx", number(size).alias("size"), number(time).alias("batch_time"), "r.*")
