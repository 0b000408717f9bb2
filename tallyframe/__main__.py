"""python -m tallyframe repl|inspect|check|compact FOLDER, or benchmark FOLDER [--accounts N] [--transfers N]"""

from __future__ import annotations

import argparse
import random
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .client import Ledger
from .functions.types import BATCH_MAX, Account, Transfer, time_id
from .sources.statement import StatementError


def repl(ledger: Ledger, lines: Iterable[str]) -> Iterable[str]:
    """The answers to statements, which end with a semicolon and can go over several lines; what is wrong with one is said, and the next is read."""
    text = ""
    for line in lines:
        text += line
        while ";" in text:
            one, text = text.split(";", 1)
            try:
                yield from ledger.show(one)
            except (StatementError, ValueError) as error:
                yield f"Fail: {error}"


def benchmark(ledger: Ledger, accounts: int, transfers: int, seed: int = 42) -> Iterable[str]:
    """Load accepted in full batches: transfers a second, and batch times."""
    rnd = random.Random(seed)
    ids = [time_id() for _ in range(accounts)]
    for i in range(0, accounts, BATCH_MAX):
        ledger.create_accounts([Account(id=x, ledger=2, code=1) for x in ids[i : i + BATCH_MAX]])
    took = []
    for i in range(0, transfers, BATCH_MAX):
        pairs = [rnd.sample(ids, 2) for _ in range(min(BATCH_MAX, transfers - i))]
        began = time.time()
        results = ledger.create_transfers([Transfer(id=time_id(), debit_account_id=a, credit_account_id=b, amount=rnd.randint(1, 10**6), ledger=2, code=1) for a, b in pairs])
        took.append(time.time() - began)
        if any(s != "created" for _, s in results):
            raise RuntimeError("a transfer of the benchmark failed")
    yield f"load accepted = {transfers / sum(took):.0f} tx/s"
    yield from (f"batch latency p{p} = {sorted(took)[min(len(took) - 1, len(took) * p // 100)] * 1000:.0f} ms" for p in (1, 50, 99, 100))


def main(arguments: list[str], spark: SparkSession | None = None, lines: Iterable[str] = sys.stdin) -> Iterable[str]:
    parser = argparse.ArgumentParser(prog="tallyframe", description=__doc__)
    parser.add_argument("command", choices=["repl", "inspect", "check", "compact", "benchmark"])
    parser.add_argument("folder")
    parser.add_argument("--accounts", type=int, default=10_000)
    parser.add_argument("--transfers", type=int, default=100_000)
    a = parser.parse_args(arguments)
    ledger = Ledger(spark or SparkSession.builder.appName("tallyframe").getOrCreate(), a.folder)
    if a.command == "repl":
        yield from repl(ledger, lines)
    elif a.command == "benchmark":
        yield from benchmark(ledger, a.accounts, a.transfers)
    elif a.command == "compact":
        yield f"step {ledger.compact()}"
    else:
        yield from (" ".join(map(str, r)) for r in (ledger.inspect() if a.command == "inspect" else ledger.check()).collect())


if __name__ == "__main__":
    for line in main(sys.argv[1:]):
        print(line)
