"""Pulses as a plan, against one state, and of more than a request holds."""

import pytest

from test_engine import in_one_state, on_spark, random_log, untangled
from tallyframe.functions.types import Account, Transfer
from tallyframe.operators import engine


@pytest.mark.parametrize("seed", (30, 31))
def test_pulses_run_as_a_plan(spark, monkeypatch, seed):
    monkeypatch.setattr(engine, "run_groups", None)  # the kernel isn't needed
    log = [b for i, x in enumerate(untangled(random_log(seed, False, ledgers=2, batches=16, size=40))) for b in ([x, ("tick", x[1] + 40, [])] if i % 3 == 2 else [x])]
    want = in_one_state(log)
    assert sum(e[1] == 4 for e in want[1]) > 5
    assert on_spark(engine.execute(engine.requests(spark, log))) == want


@pytest.mark.parametrize("flags", (0, 4))
def test_a_pulse_of_more_than_a_request_gives_each_its_time(spark, flags):
    n = 8200
    log = [("account", 1000, [Account(id=1, ledger=1, code=1), Account(id=2, ledger=1, code=1, flags=flags), Account(id=3, ledger=1, code=1)])]
    log += [("transfer", 10**6, [Transfer(id=i, debit_account_id=1, credit_account_id=3, amount=1, ledger=1, code=1, flags=2, timeout=1) for i in range(1, n + 1)]), ("tick", 10**10, [])]
    out = engine.execute(engine.requests(spark, log)).where("kind = 4")
    assert sorted((r.transfer_key, r.timestamp) for r in out.select("transfer_key", "timestamp").collect()) == [(i, 10**10 - n + i) for i in range(1, n + 1)]
