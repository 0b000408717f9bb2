"""Imports that run as a plan, against one state."""

import random

import pytest

from test_engine import in_one_state, on_spark
from tallyframe.functions.types import Account, Transfer
from tallyframe.operators import engine
from tallyframe.plans import imports


def log_of(seed):
    """Imported accounts and others, then batches of transfers, some imported, with mistakes of all kinds; ids come once."""
    rnd = random.Random(seed)
    log, time, i = [], 10**6, 0
    for n in range(3):
        made = []
        for _ in range(20):
            i += 1
            flags = 16 if (n < 2) != (rnd.random() < 0.04) else 0
            made.append(Account(id=i, ledger=i % 2 + 1 if rnd.random() < 0.95 else 0, code=1, flags=flags | rnd.choice([0, 8]), timestamp=(100 * i - rnd.choice([0, 0, 0, 700]) if rnd.random() < 0.95 else rnd.choice([0, 10**8])) if flags else int(rnd.random() < 0.05)))
        log.append(("account", time, made))
        time += 10**5
    place, key = 3000, 0
    for n in range(12):
        bring, made = n not in (4, 9), []
        for _ in range(25):
            key, place = key + 1, place + rnd.choice([50, 100, 130])
            flags = 256 if bring != (rnd.random() < 0.04) else 0
            pending = rnd.choice([0, 0, 2])
            when = (rnd.choice([place, place, place, place - 400, 2400, rnd.randint(1, 2500)]) if rnd.random() < 0.95 else rnd.choice([0, -5, 10**9])) if flags else int(rnd.random() < 0.05)
            a = rnd.randint(0, 62)
            made.append(Transfer(id=key, debit_account_id=a, credit_account_id=max(0, a + rnd.choice([2, 2, 2, 4, 1, 0, -2])), amount=rnd.randint(0, 9), ledger=a % 2 + 1, code=int(rnd.random() < 0.97), flags=flags | pending | (512 if rnd.random() < 0.02 else 0), timeout=rnd.choice([0, 0, 0, 5]) if pending or rnd.random() < 0.05 else 0, timestamp=when))
        log.append(("transfer", time, made))
        time += 10**5
    return log


@pytest.mark.parametrize("seed", range(3))
def test_imports_run_as_a_plan(spark, monkeypatch, seed):
    monkeypatch.setattr(imports, "ROWS", 7)
    monkeypatch.setattr(engine, "run_groups", None)  # the kernel isn't needed
    log = log_of(seed)
    want = in_one_state(log)
    assert len({r[3] for r in want[0] if "import" in r[3]}) >= 6
    assert on_spark(engine.execute(engine.requests(spark, log))) == want


def test_what_hangs_on_more_than_times_is_left_to_the_kernel(spark):
    log = log_of(5)
    twice = [*log, ("transfer", log[-1][1] + 10**5, [log[4][2][0]])]
    late = [*log, ("account", log[-1][1] + 10**5, [Account(id=900 + i, ledger=1, code=1, flags=16, timestamp=3000 + 50 * i) for i in range(40)])]
    for some in (twice, late):
        assert on_spark(engine.execute(engine.requests(spark, some))) == in_one_state(some)
