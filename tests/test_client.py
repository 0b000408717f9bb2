"""The requests as methods, over tables that grow by steps."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.client import Ledger
from tallyframe.functions.types import NS, Account, AccountFlags, Transfer, TransferFlags, from_bytes
from tallyframe.operators import reads
from tallyframe.operators.kernel import State
from tallyframe.operators.reads import AccountFilter, ChangeEventsFilter, QueryFilter
from tallyframe.plans.checks import violations

BIG = 2**127


def move(key, amount, dr=1, cr=2, **rest):
    return Transfer(id=key, debit_account_id=dr, credit_account_id=cr, amount=amount, ledger=1, code=1, **rest)


def ids(df):
    return [from_bytes(bytes(r.id)) for r in df.collect()]


def broken(df):
    return {r.invariant: r.broken for r in df.collect() if r.broken}


def test_a_ledger_from_batch_to_batch(spark, tmp_path):
    now = [1000 * NS]
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: now[0])
    assert ledger.lookup_accounts([1]).count() == 0
    made = ledger.create_accounts([Account(id=BIG, ledger=1, code=1, flags=AccountFlags.HISTORY), Account(id=2, ledger=1, code=1), Account(id=2, ledger=1, code=2), Account(id=0)])
    assert [s for _, s in made] == ["created", "created", "exists_with_different_code", "id_must_not_be_zero"]
    assert [t for t, _ in made] == [now[0] - 3, now[0] - 2, now[0] - 1, now[0]]
    sent = ledger.create_transfers([move(1, BIG + 5, BIG), move(2, 7, BIG, flags=TransferFlags.PENDING, timeout=10, user_data_64=2**64 - 1), move(3, 4, BIG, flags=TransferFlags.PENDING, timeout=10), move(4, 1, 99)])
    assert [s for _, s in sent] == ["created", "created", "created", "debit_account_not_found"]
    assert sent[0][0] == now[0] + 1  # the clock stood still; timestamps don't
    again = Ledger(spark, f"file://{tmp_path}/ledger", lambda: now[0])
    done = again.create_transfers([Transfer(id=5, pending_id=2, amount=3, flags=TransferFlags.POST_PENDING_TRANSFER), move(4, 1, BIG), move(1, BIG + 5, BIG)])
    assert [s for _, s in done] == ["created", "id_already_failed", "exists"] and done[2][0] == sent[0][0]
    now[0] += 11 * NS
    assert again.expire() == 1 and again.expire() == 0
    (late,) = again.create_transfers([Transfer(id=6, pending_id=3, amount=0, flags=TransferFlags.VOID_PENDING_TRANSFER)])
    assert late[1] == "pending_transfer_expired"

    def look():
        r = again.lookup_accounts([2, 77, BIG, 2]).collect()
        assert [from_bytes(bytes(x.id)) for x in r] == [2, BIG, 2]
        assert [from_bytes(bytes(r[1][c])) for c in ("debits_pending", "debits_posted")] == [0, BIG + 8]
        assert ids(again.get_account_transfers(AccountFilter(BIG, flags=5))) == [5, 3, 2, 1]
        assert ids(again.query_transfers(QueryFilter(user_data_64=2**64 - 1))) == [2, 5]
        assert ids(again.query_accounts(QueryFilter(code=1))) == [BIG, 2]
        history = again.get_account_balances(AccountFilter(BIG)).collect()
        assert [from_bytes(bytes(x.debits_pending)) for x in history] == [0, 7, 11, 4]
        assert again.get_account_balances(AccountFilter(2)).count() == 0
        assert broken(again.check()) == {}
        return [(x.type, from_bytes(bytes(x.amount))) for x in again.get_change_events(ChangeEventsFilter()).collect()]

    events = look()
    assert [t for t, _ in events] == ["single_phase", "two_phase_pending", "two_phase_pending", "two_phase_posted", "two_phase_expired"]
    again.compact()
    assert look() == events
    assert {r.name: r.rows for r in again.inspect().collect()} == {"accounts": 2, "transfers": 4, "statuses": 2, "orphans": 1, "events": 5}
    made, found, shown = again.execute("create_accounts id=8 code=1 ledger=1; lookup_accounts id=8; query_accounts code=1 limit=1")
    assert made[0][1] == "created" and found.count() == 1 and shown.count() == 1
    with pytest.raises(ValueError):
        again.create_accounts([Account()] * 9000)


def test_steps_equal_one_kernel(spark, tmp_path):
    dice, state, clock = random.Random(3), State(), [10 * NS]
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: clock[0])
    first = [Account(id=i, ledger=1, code=1, flags=dice.choice([0, 2, 4, 8])) for i in range(1, 8)]
    assert ledger.create_accounts(first) == state.create_accounts(first, clock[0])
    for n in range(3):
        clock[0] += 3 * NS
        batch = []
        for k in range(25):
            flags = dice.choice([0, 0, 1, 2, 2, 4, 8, 16, 32, 66])
            pending = dice.randrange(1, 30 * n + 20) if flags & 12 else 0
            batch.append(Transfer(id=dice.randrange(1, 90), debit_account_id=0 if pending else dice.randrange(0, 9), credit_account_id=0 if pending else dice.randrange(0, 9), amount=dice.randrange(0, 30), pending_id=pending, timeout=dice.choice([0, 2, 5]) if flags & 2 else 0, ledger=0 if pending else 1, code=0 if pending else 1, flags=flags))
        state.pulse(clock[0])
        assert ledger.create_transfers(batch) == state.create_transfers(batch, max(clock[0], ledger.journal.steps()[-1]["facts"]["time"]))
    now = {from_bytes(bytes(r.id)): tuple(from_bytes(bytes(r[b])) for b in ("debits_pending", "debits_posted", "credits_pending", "credits_posted")) for r in ledger.accounts().collect()}
    assert now == {a.id: (a.debits_pending, a.debits_posted, a.credits_pending, a.credits_posted) for a in state.accounts.values()}
    assert ledger.events().count() == len(state.events) and broken(ledger.check()) == {}


def test_a_step_has_one_writer(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: 5)
    ledger.create_accounts([Account(id=1, ledger=1, code=1)])
    (tmp_path / "ledger/published/2").touch()  # a writer that died
    assert [m["step"] for m in ledger.journal.steps()] == [1]
    ledger.create_accounts([Account(id=2, ledger=1, code=1)])
    assert [m["step"] for m in ledger.journal.steps()] == [1, 3] and ledger.accounts().count() == 2
    ledger.journal._free = lambda: 2  # as a writer sees it that raced for the step
    with pytest.raises(Exception, match="2"):
        ledger.journal.publish({}, {})


def test_checks_find_what_is_broken(spark):
    account = "id long, debits_pending long, debits_posted long, credits_pending long, credits_posted long, ledger long, flags long, timestamp long"
    accounts = spark.createDataFrame([(1, 0, 5, 0, 0, 1, 2, 1), (2, 0, 0, 0, 4, 1, 0, 2)], account)
    transfers = spark.createDataFrame([(9, 1, 2, 5, 0, 1, 2), (8, 1, 1, 0, 0, 1, 7)], "id long, debit_account_id long, credit_account_id long, amount long, pending_id long, ledger long, timestamp long")
    events = spark.createDataFrame([(2, 0, 9), (3, 4, 9), (4, 4, 9)], "timestamp long, kind int, transfer_key long")
    statuses = spark.createDataFrame([(9, 1)], "id long, status int")
    assert broken(violations(accounts, transfers, events, statuses)) == {
        "ledgers balance": 1, "timestamps are unique": 1, "a transfer has one event": 1, "debits stay within credits": 1,
        "a pending transfer ends once": 1, "pending balances are held": 1, "transfers stay in their ledger": 1,
    }


def test_former_events(spark):
    transfers = spark.createDataFrame([(7, 2, 10), (8, 4, 11), (9, 0, 12)], "id long, flags long, timestamp long")
    rows = spark.createDataFrame([(10, 1, 2), (11, 1, 2), (12, 0, 2)], "timestamp long, debit_account_id long, credit_account_id long")
    got = reads.former_events(rows, transfers).orderBy("timestamp").select("transfer_key", "kind").collect()
    assert [tuple(r) for r in got] == [(7, 1), (8, 2)]
    assert reads.former_events(rows.where(F.lit(False)), transfers).count() == 0
