"""Large logs in groups of accounts that depend on each other, against one state."""

import pytest

from test_engine import in_one_state, on_spark, random_log
from tallyframe.functions.types import Account, Transfer
from tallyframe.operators import engine
from tallyframe.plans.links import around, members, settled


@pytest.mark.parametrize("seed, rounds", [(10, 30), (11, 30), (12, 1)])
def test_groups_of_accounts_equal_one_state(spark, monkeypatch, seed, rounds):
    for name, value in (("CLOSE", 0), ("ROUNDS", rounds), ("STRETCH", 2)):
        monkeypatch.setattr(engine, name, value)
    log = random_log(seed, True, ledgers=10, size=12)
    want, frame = in_one_state(log), engine.requests(spark, log)
    assert on_spark(engine.execute(frame)) == want
    assert seed != 11 or on_spark(engine.fold(frame)) == want


def pairs(n):
    """Accounts of one ledger by twos; each first one may not owe, and pays by a chain of two, of which the second can fail."""
    accounts = [Account(id=i, ledger=1, code=1, flags=2 * (i % 2)) for i in range(1, 2 * n + 1)]
    filled = [Transfer(id=i + 1, debit_account_id=2 * i + 2, credit_account_id=2 * i + 1, amount=i % 3, ledger=1, code=1) for i in range(n)]
    paid = [Transfer(id=n + 2 * i + j + 1, debit_account_id=2 * i + 1, credit_account_id=2 * i + 2, amount=1, ledger=1, code=1, flags=1 - j) for i in range(n) for j in (0, 1)]
    return [("account", 10**6, accounts), ("transfer", 10**7, filled), ("transfer", 10**8, paid)]


def test_accounts_of_one_ledger_come_in_groups_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(engine, "CLOSE", 10)
    monkeypatch.setattr(engine, "STRETCH", 3)
    seen, run = [], engine.run_groups
    monkeypatch.setattr(engine, "run_groups", lambda rows, *more: seen.append(rows.select("component").distinct().count()) or run(rows, *more))
    log = pairs(20)
    want = in_one_state(log)
    assert {r[3] for r in want[0]} == {"created", "exceeds_credits", "linked_event_failed"}
    assert on_spark(engine.execute(engine.requests(spark, log))) == want and seen == [20]


def test_a_long_path_without_order_is_left_to_the_plan(spark, monkeypatch):
    monkeypatch.setattr(engine, "CLOSE", 10)
    monkeypatch.setattr(engine, "ROUNDS", 2)
    path = [Account(id=1000 + i, ledger=1, code=1) for i in range(300)]
    along = [Transfer(id=1000 + i, debit_account_id=1000 + i, credit_account_id=1001 + i, amount=1, ledger=1, code=1) for i in range(299)]
    log = [*pairs(5), ("account", 10**9, path), ("transfer", 10**10, along)]
    seen, run = [], engine.run_groups
    monkeypatch.setattr(engine, "run_groups", lambda rows, *more: seen.append(rows.count()) or run(rows, *more))
    assert on_spark(engine.execute(engine.requests(spark, log))) == in_one_state(log) and seen == [25]


def test_settled_says_whether_it_is_done(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    assert not settled(links, 1)[1]
    stars, done = settled(links, 20)
    assert done and {tuple(r) for r in members(stars).collect()} == {(i, 0) for i in range(201)} | {(1000, 1000), (1001, 1000)}
    nodes = spark.createDataFrame([(1001,)], "node long")
    assert around(links, nodes, 3).collect() == [(1000, 1001)] and around(links, spark.createDataFrame([(5,)], "node long"), 3) is None
