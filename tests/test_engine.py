"""Logs on Spark against the rules run over one state, event by event: several ledgers, every status."""

import random

import pytest

from tallyframe.functions.types import AMOUNT_MAX, TRANSFER_STATUS, U128_MAX, Account, Transfer, TransferFlags, from_bytes
from tallyframe.operators import engine
from tallyframe.operators.kernel import State

T = TransferFlags
RESULT = ["batch", "idx", "timestamp", "status"]
EVENT = ["timestamp", "kind", "transfer_key", "debit_account_id", "credit_account_id", "amount", "ledger", "transfer_flags", "dr_flags", "cr_flags", "dr_debits_pending", "dr_debits_posted", "cr_credits_pending", "cr_credits_posted"]


def in_one_state(log):
    """(results, events) of the batches, one after the other."""
    s, results = State(), []
    for n, (what, time, records) in enumerate(log):
        if what == "tick":
            s.pulse(time)
        else:
            run = s.create_accounts if what == "account" else s.create_transfers
            results += [(n, i, *r) for i, r in enumerate(run(records, time))]
    events = []
    for e in s.events:
        t = e.transfer or e.pending
        events.append((e.timestamp, int(e.status), t.id, e.debit.id, e.credit.id, e.amount, e.debit.ledger, t.flags, e.debit.flags, e.credit.flags, e.debit.debits_pending, e.debit.debits_posted, e.credit.credits_pending, e.credit.credits_posted))
    return sorted(results), sorted(events)


def on_spark(out, wide=int):
    rows = out.collect()
    number = lambda n, v: wide(v) if n in ("transfer_key", "debit_account_id", "credit_account_id", "amount", *EVENT[-4:]) else v
    return sorted(tuple(r[c] for c in RESULT) for r in rows if r.what == "result"), sorted(tuple(number(c, r[c]) for c in EVENT) for r in rows if r.what == "event")


def random_log(seed, ordered, ledgers=4, batches=14, size=25):
    """Accounts and transfers of several ledgers, with mistakes of all kinds; ordered: chains, limits, balancing, closing, imports and ticks, too."""
    rnd = random.Random(seed)
    log, ids, pending, done, time = [], [0], [], [], 10**6
    ledger_of = lambda a: a % ledgers + 1
    for n in range(batches):
        time += rnd.randint(50, 10**10)
        if ordered and n > 2 and rnd.random() < 0.2:
            log.append(("tick", time, []))
            continue
        if n < 2 or rnd.random() < 0.15:
            made = []
            for _ in range(size):
                i = rnd.randint(1, 40)
                flags = rnd.choice([0, 8, 8, 6 if rnd.random() < 0.3 else 0, *([2, 4, 1, 1] if ordered else [])])
                made.append(Account(id=i if rnd.random() < 0.97 else 0, ledger=ledger_of(i) if rnd.random() < 0.9 else rnd.randint(0, ledgers), code=rnd.choice([1, 1, 1, 1, 2, 0]), flags=flags | (64 if rnd.random() < 0.02 else 0), user_data_64=rnd.choice([0, 0, 0, 5]), reserved=int(rnd.random() < 0.02), debits_posted=int(rnd.random() < 0.02), timestamp=int(rnd.random() < 0.02)))
            log.append(("account", time, made))
            continue
        made = []
        imports = ordered and rnd.random() < 0.1
        for k in range(size):
            u = rnd.random()
            if u < 0.3 and pending:
                p = rnd.choice(pending)
                how = rnd.choice([T.POST_PENDING_TRANSFER, T.POST_PENDING_TRANSFER, T.VOID_PENDING_TRANSFER])
                amount = rnd.choice([p.amount, AMOUNT_MAX, max(0, p.amount - 1), 0, p.amount + 1])
                more = rnd.choice([{}, {}, {}, {"debit_account_id": p.debit_account_id, "ledger": p.ledger}, {"credit_account_id": 3}, {"code": 9}, {"ledger": 9}, {"user_data_64": 7}, {"timeout": 4}, {"debit_account_id": 2}])
                ids.append(ids[-1] + 1)
                t = Transfer(id=ids[-1], pending_id=p.id if rnd.random() < 0.9 else rnd.choice([0, ids[-1], 10**6, rnd.choice(ids)]), amount=amount, flags=int(how) | (2 if rnd.random() < 0.03 else 0) | (12 if rnd.random() < 0.03 else 0), **more)
                done.append(t)
            elif u < 0.4 and done:  # once more, as it was or not
                t = Transfer(**{**vars(rnd.choice(done)), **rnd.choice([{}, {}, {"amount": 0}, {"amount": AMOUNT_MAX}, {"user_data_64": 3}, {"code": 7}, {"timeout": 2}, {"flags": 0}])})
                if t.amount == AMOUNT_MAX and not t.flags & 12 and not ordered:
                    continue
            else:
                a = rnd.randint(1, 45)
                b = a + ledgers * rnd.randint(1, 5) if rnd.random() < 0.9 else rnd.randint(0, 45)
                ids.append(ids[-1] + 1)
                flags = rnd.choice([0, 0, 2, 2])
                if ordered:
                    flags |= rnd.choice([0, 0, 0, 0, 1, 16, 32, 66 if flags else 0])
                t = Transfer(id=ids[-1] if rnd.random() < 0.95 else rnd.choice(ids), debit_account_id=a, credit_account_id=b % 45, amount=rnd.randint(0, 50), ledger=ledger_of(a) if rnd.random() < 0.92 else rnd.randint(0, ledgers), code=rnd.choice([1, 1, 1, 1, 0]), flags=flags, timeout=rnd.choice([0, 0, 5]) if flags & 2 else int(rnd.random() < 0.02), user_data_64=rnd.choice([0, 4]), pending_id=int(rnd.random() < 0.02), timestamp=int(rnd.random() < 0.02))
                done.append(t)
                if flags & 2:
                    pending.append(t)
            if imports:
                t = Transfer(**{**vars(t), "flags": t.flags | 256, "timestamp": rnd.randint(1, 10**11), "timeout": 0})
            made.append(t)
        log.append(("transfer", time, made))
    return log


@pytest.mark.parametrize("seed", range(3))
def test_plan_equals_the_rules(spark, seed):
    log = random_log(seed, False)
    want = in_one_state(log)
    assert len({r[3] for r in want[0]}) > 25
    frame = engine.requests(spark, log)
    assert not engine.survey(frame)["ordered"]
    assert on_spark(engine.execute(frame)) == want


def untangled(log):
    """The log without posts and voids whose ids the plan can't tell apart."""
    resolvers = {t.id for what, _, records in log if what == "transfer" for t in records if t.flags & 12}
    meant = {}

    def fine(t):
        return meant.setdefault(t.id, t.pending_id) == t.pending_id and t.pending_id not in resolvers if t.flags & 12 else t.id not in resolvers

    return [(what, time, [r for r in records if what == "account" or fine(r)]) for what, time, records in log]


def test_plan_alone_meets_the_statuses_of_two_phases(spark):
    seen = set()
    for seed in range(20, 23):
        log = untangled(random_log(seed, False, ledgers=2, batches=25, size=60))
        frame = engine.requests(spark, log)
        assert engine.tangled(frame.where("what = 'transfer'")).isEmpty()
        want = in_one_state(log)
        seen |= {r[3] for r in want[0]}
        assert on_spark(engine.plan(engine.placed(frame))) == want
        assert on_spark(engine.plan(engine.placed(frame), slice_ns=3 * 10**9)) == want
    assert {s for s in TRANSFER_STATUS if "pending_transfer" in s} - {"timeout_reserved_for_pending_transfer"} <= seen


@pytest.mark.parametrize("seed", range(10, 14))
def test_fold_and_execute_equal_one_state(spark, seed):
    log = random_log(seed, True)
    want = in_one_state(log)
    frame = engine.requests(spark, log)
    assert on_spark(engine.fold(frame)) == want
    assert on_spark(engine.execute(frame)) == want


def test_exact_profile(spark):
    log = random_log(15, True)
    log[2:2] = [("account", log[1][1] + 1, [Account(id=U128_MAX, ledger=1, code=1), Account(id=2**100, ledger=1, code=1), Account(id=2**100 + 1, ledger=1, code=1)])]
    log.append(("transfer", log[-1][1] + 5, [Transfer(id=2**90, debit_account_id=2**100, credit_account_id=2**100 + 1, amount=2**100, ledger=1, code=1), Transfer(id=2**90 + 1, debit_account_id=2**100, credit_account_id=2**100 + 1, amount=AMOUNT_MAX, ledger=1, code=1)]))
    want = in_one_state(log)
    got = on_spark(engine.fold(engine.requests(spark, log, exact=True), exact=True), lambda b: from_bytes(bytes(b)))
    assert got == want


def test_ledgers_that_meet_run_together(spark):
    """Through an account, a chain of accounts, and a transfer between accounts of another ledger."""
    log = [
        ("account", 1000, [Account(id=1, ledger=1, code=1), Account(id=2, ledger=1, code=1), Account(id=2, ledger=2, code=1), Account(id=3, ledger=3, code=1)]),
        ("account", 2000, [Account(id=5, ledger=1, code=1, flags=1), Account(id=6, ledger=2, code=0)]),
        ("transfer", 3000, [Transfer(id=1, debit_account_id=1, credit_account_id=2, amount=1, ledger=2, code=1), Transfer(id=1, debit_account_id=1, credit_account_id=2, amount=1, ledger=1, code=1)]),
    ]
    want = in_one_state(log)
    assert [r[3] for r in want[0]] == ["created", "created", "exists_with_different_ledger", "created", "linked_event_failed", "code_must_not_be_zero", "transfer_must_have_the_same_ledger_as_accounts", "created"]
    frame = engine.requests(spark, log)
    assert on_spark(engine.fold(frame)) == on_spark(engine.execute(frame)) == want
    groups = engine.grouped(engine.placed(frame), False, engine.survey(frame))
    assert {r.ledger: r.component for r in groups.select("ledger", "component").distinct().collect()} == {1: 1, 2: 1, 3: 3}


def test_imports_leave_other_ledgers_alone(spark):
    log = [
        ("account", 1000, [Account(id=1, ledger=1, code=1, flags=16, timestamp=3), Account(id=2, ledger=1, code=1, flags=16, timestamp=4)]),
        ("transfer", 1100, [Transfer(id=1, debit_account_id=1, credit_account_id=2, amount=1, ledger=1, code=1, flags=256, timestamp=9), Transfer(id=2, debit_account_id=1, credit_account_id=2, amount=1, ledger=1, code=1, flags=256, timestamp=8)]),
        ("account", 2000, [Account(id=3, ledger=2, code=1), Account(id=4, ledger=2, code=1)]),
        ("transfer", 3000, [Transfer(id=3, debit_account_id=3, credit_account_id=4, amount=1, ledger=2, code=1)]),
    ]
    frame = engine.requests(spark, log)
    assert on_spark(engine.fold(frame)) == in_one_state(log) and on_spark(engine.execute(frame)) == in_one_state(log)
    groups = engine.grouped(engine.placed(frame), False, engine.survey(frame))
    assert groups.select("component").distinct().count() == 2


def test_logs_without_events(spark):
    log = engine.requests(spark, [("account", 1000, [Account(id=1, ledger=1, code=1)]), ("tick", 2000, [])])
    for some in (log.limit(0), log.where("what = 'tick'")):
        assert engine.execute(some).count() == engine.fold(some).count() == 0
    assert [r.status for r in engine.execute(log).collect()] == ["created"]
