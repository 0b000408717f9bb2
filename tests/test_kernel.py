"""The ledger's rules, case by case."""

import random
from dataclasses import replace

from tallyframe.functions.types import AMOUNT_MAX, NS, U128_MAX, Account, AccountFlags, PendingStatus, Transfer, TransferFlags, from_bytes, time_id, to_bytes
from tallyframe.operators.kernel import State

A, T = AccountFlags, TransferFlags


def ledger(*flags, **balances):
    s = State()
    assert all(r == "created" for _, r in s.create_accounts([Account(id=i + 1, ledger=1, code=1, flags=int(f)) for i, f in enumerate(flags)], 1000))
    for key, values in balances.items():
        names = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")
        s.accounts[int(key[1:])] = replace(s.accounts[int(key[1:])], **dict(zip(names, values, strict=True)))
    return s


def move(i, dr=1, cr=2, amount=0, flags=0, **more):
    resolves = flags & (T.POST_PENDING_TRANSFER | T.VOID_PENDING_TRANSFER)
    base = {} if resolves else {"debit_account_id": dr, "credit_account_id": cr, "ledger": 1, "code": 1}
    return Transfer(id=i, amount=amount, flags=int(flags), **(base | more))


def run(s, *transfers, at=None):
    s.clock = at or getattr(s, "clock", 2000) + 1000
    return [status for _, status in s.create_transfers(list(transfers), s.clock)]


def balances(s, i):
    a = s.accounts[i]
    return a.debits_pending, a.debits_posted, a.credits_pending, a.credits_posted


def test_linked_accounts_f01():
    s = State()
    make = lambda i, linked=0, **k: Account(**({"id": i, "ledger": 1, "code": 1, "flags": linked} | k))
    names = lambda *a, at: [r for _, r in s.create_accounts(list(a), at)]
    assert names(make(7), make(1, 1), make(2, 1), make(1, 1), make(3), at=100) == ["created", "linked_event_failed", "linked_event_failed", "exists_with_different_flags" if 0 else "exists", "linked_event_failed"]
    assert names(make(1), at=200) == ["created"]
    assert names(make(1, 1, code=2), make(2), at=300) == ["exists_with_different_flags", "linked_event_failed"]
    assert names(make(3, 1), make(1, ledger=2), at=400) == ["linked_event_failed", "exists_with_different_ledger"]
    assert names(make(3, 1), make(4), at=500) == ["created", "created"]
    assert sorted(s.accounts) == [1, 3, 4, 7]


def test_open_chain_f02():
    s = ledger(0)
    batch = [Account(id=2, ledger=1, code=1, flags=1), Account(id=1, ledger=1, code=1, flags=1), Account(id=3, ledger=1, code=1, flags=1)]
    assert [r for _, r in s.create_accounts(batch, 5000)] == ["linked_event_failed", "exists_with_different_flags", "linked_event_chain_open"]
    assert sorted(s.accounts) == [1]


def test_account_statuses_in_order():
    s = State()
    bad = Account(id=0, debits_pending=1, debits_posted=1, credits_pending=1, credits_posted=1, reserved=1, flags=64 | 6, timestamp=2)
    order = [("timestamp_must_be_zero", {"timestamp": 0}), ("reserved_field", {"reserved": 0}), ("reserved_flag", {"flags": 6}), ("id_must_not_be_zero", {"id": U128_MAX}), ("id_must_not_be_int_max", {"id": 5}), ("flags_are_mutually_exclusive", {"flags": 0}), ("debits_pending_must_be_zero", {"debits_pending": 0}), ("debits_posted_must_be_zero", {"debits_posted": 0}), ("credits_pending_must_be_zero", {"credits_pending": 0}), ("credits_posted_must_be_zero", {"credits_posted": 0}), ("ledger_must_not_be_zero", {"ledger": 1}), ("code_must_not_be_zero", {"code": 1}), ("created", {})]
    for status, fix in order:
        assert s.create_accounts([bad], 100)[0][1] == status
        bad = replace(bad, **fix)
    for change, status in (({"flags": 8}, "flags"), ({"user_data_128": 1}, "user_data_128"), ({"user_data_64": 1}, "user_data_64"), ({"user_data_32": 1}, "user_data_32"), ({"ledger": 9}, "ledger"), ({"code": 9}, "code")):
        assert s.create_accounts([replace(bad, **change)], 200)[0][1] == f"exists_with_different_{status}"
    assert s.create_accounts([bad], 300)[0] == (100, "exists")


def test_overflows_and_limits_f03():
    m = U128_MAX
    s = ledger(0, 0, 0, A.DEBITS_MUST_NOT_EXCEED_CREDITS, A.CREDITS_MUST_NOT_EXCEED_DEBITS, a1=(100, 200, 0, 0), a3=(0, 0, 110, 210), a4=(20, m - 700, 0, m - 500), a5=(0, m - 1000, 10, m - 1100))
    names = ["debits_pending", "credits_pending", "debits_posted", "credits_posted", "debits", "credits"]
    for i, (gap, name) in enumerate(zip((99, 109, 199, 209, 299, 319), names, strict=True)):
        assert run(s, move(10 + i, 1, 3, m - gap, T.PENDING)) == [f"overflows_{name}"]
    assert run(s, move(20, 4, 5, 199, T.PENDING, timeout=999), at=2**63 - 2) == ["overflows_timeout"]
    assert run(s, move(20, 4, 5, 199), at=9000) == ["exceeds_credits"]
    assert run(s, move(21, 4, 5, 91)) == ["exceeds_debits"]
    assert run(s, move(21, 4, 5, 1)) == ["id_already_failed"]


def test_two_phase_f04():
    s = ledger(0, 0)
    s.clock = 2000
    P = T.PENDING
    assert run(s, move(1, amount=15), move(2, amount=15, flags=P, timeout=1000), move(3, amount=15, flags=P, timeout=50), move(4, amount=15, flags=P, timeout=1), move(5, amount=7, flags=P, timeout=50), move(6, amount=1, flags=P), move(7, amount=1, flags=P)) == ["created"] * 7
    assert balances(s, 1) == (54, 15, 0, 0)
    now = s.clock + NS
    post, void = T.POST_PENDING_TRANSFER, T.VOID_PENDING_TRANSFER
    assert run(s, move(101, amount=13, flags=post, pending_id=2), move(102, flags=void, pending_id=3), move(103, amount=15, flags=post, pending_id=3), move(104, flags=void, pending_id=4), at=now + 10) == ["created", "created", "pending_transfer_already_voided", "pending_transfer_expired"]
    assert run(s, move(105, amount=8, flags=post, pending_id=5), move(105, amount=AMOUNT_MAX, flags=post, pending_id=5)) == ["exceeds_pending_transfer_amount", "created"]
    assert s.transfers[105].amount == 7
    again = [run(s, move(105, amount=a, flags=post, pending_id=5))[0] for a in (7, AMOUNT_MAX, 6, 8, 0)]
    assert again == ["exists", "exists", *["exists_with_different_amount"] * 3]
    assert run(s, move(106, flags=void, pending_id=6), move(107, amount=0, flags=post, pending_id=7)) == ["created", "created"]
    s.pulse(now + 20)
    assert balances(s, 1) == (0, 35, 0, 0) and balances(s, 2) == (0, 0, 0, 35)
    assert s.integrity() == []


def test_expiry_f05():
    s = ledger(0, 0)
    s.clock = 2000
    run(s, *[move(i + 1, amount=10 + i, flags=T.PENDING, timeout=i) for i in range(4)])
    seen = []
    for i in range(1, 4):
        s.pulse(s.clock + i * NS, most=1)
        seen.append(balances(s, 1)[0])
    assert seen == [35, 23, 10]
    assert run(s, move(9, amount=AMOUNT_MAX, flags=T.POST_PENDING_TRANSFER, pending_id=1), move(10, amount=AMOUNT_MAX, flags=T.POST_PENDING_TRANSFER, pending_id=2)) == ["created", "pending_transfer_expired"]
    assert [e.status for e in s.events].count(PendingStatus.EXPIRED) == 3


def test_undo_within_a_batch_f06():
    s = ledger(A.DEBITS_MUST_NOT_EXCEED_CREDITS, 0, a1=(0, 0, 0, 20))
    assert run(s, move(1, amount=15, flags=T.LINKED), move(2, amount=5, ledger=0), move(3, amount=15)) == ["linked_event_failed", "ledger_must_not_be_zero", "created"]
    assert balances(s, 1) == (0, 15, 0, 20)


def test_balancing_f07_f08():
    s = ledger(A.DEBITS_MUST_NOT_EXCEED_CREDITS, A.CREDITS_MUST_NOT_EXCEED_DEBITS, 0, a1=(1, 0, 0, 10), a2=(0, 10, 2, 0))
    for i, a in enumerate((3, 13, 1)):
        assert run(s, move(1 + i, 1, 3, a, T.BALANCING_DEBIT), move(11 + i, 3, 2, a, T.BALANCING_CREDIT)) == ["created"] * 2
    assert [s.transfers[i].amount for i in (1, 2, 3, 11, 12, 13)] == [3, 6, 0, 3, 5, 0]
    assert [run(s, move(1, 1, 3, a, T.BALANCING_DEBIT))[0] for a in (2, 3, 4)] == ["exists_with_different_amount", "exists", "exists"]
    assert (balances(s, 1), balances(s, 2), balances(s, 3)) == ((1, 9, 0, 10), (0, 10, 2, 8), (0, 8, 0, 9))
    s = ledger(A.DEBITS_MUST_NOT_EXCEED_CREDITS, A.CREDITS_MUST_NOT_EXCEED_DEBITS, 0, a1=(0, 0, 0, 20), a2=(0, 10, 0, 0), a3=(0, 99, 0, 0))
    both = T.BALANCING_DEBIT | T.BALANCING_CREDIT
    run(s, *[move(i, 1, 2, a, both) for i, a in ((1, 1), (2, 12), (3, 1))], *[move(i, 1, 3, a, both) for i, a in ((4, 12), (5, 1))])
    assert [s.transfers[i].amount for i in range(1, 6)] == [1, 9, 0, 10, 0]


def test_poison_in_chains_f11():
    s = ledger(0, A.CREDITS_MUST_NOT_EXCEED_DEBITS)
    assert run(s, move(1, 2, 1, 1, T.LINKED), move(2, 1, 2, 5)) == ["linked_event_failed", "exceeds_debits"]
    assert run(s, move(1, 2, 1, 1), move(2, 2, 1, 1)) == ["created", "id_already_failed"]


def test_import_f12():
    s = State()
    a = lambda i, t: Account(id=i, ledger=1, code=1, flags=int(A.IMPORTED), timestamp=t)
    got = [s.create_accounts([a(1, t)], 10)[0][1] for t in (0, U128_MAX, 99, 2)] + [s.create_accounts([a(2, 1)], 10)[0][1], *(s.create_accounts([a(i, t)], 10)[0][1] for i, t in ((2, 3), (3, 9)))]
    assert got == ["imported_event_timestamp_out_of_range", "imported_event_timestamp_out_of_range", "imported_event_timestamp_must_not_advance", "created", "imported_event_timestamp_must_not_regress", "created", "created"]
    t = lambda i, at, dr=1, cr=2: s.create_transfers([move(i, dr, cr, 1, T.IMPORTED, timestamp=at)], 20)[0][1]
    assert [t(1, 2), t(1, 3), t(1, 4, dr=3), t(1, 4, cr=3), t(1, 4), t(2, 3), t(2, 5), t(1, 7), t(1, 99)] == ["imported_event_timestamp_must_not_regress"] * 2 + ["imported_event_timestamp_must_postdate_debit_account", "imported_event_timestamp_must_postdate_credit_account", "created", "imported_event_timestamp_must_not_regress", "created", "exists", "imported_event_timestamp_must_not_advance"]
    mixed = s.create_accounts([a(5, 11), Account(id=6, ledger=1, code=1)], 30)
    assert mixed[1][1] == "imported_event_expected"


def test_closing_f13():
    s = ledger(0, 0)
    assert run(s, move(1, flags=T.CLOSING_DEBIT)) == ["closing_transfer_must_be_pending"]
    assert run(s, move(2, amount=5, flags=T.PENDING), move(3, flags=T.PENDING | T.CLOSING_DEBIT), move(4, amount=1), move(4, amount=1)) == ["created", "created", "debit_account_already_closed", "id_already_failed"]
    assert run(s, move(5, amount=5, flags=T.POST_PENDING_TRANSFER, pending_id=2), move(6, flags=T.VOID_PENDING_TRANSFER, pending_id=3), move(7, amount=1)) == ["debit_account_already_closed", "created", "created"]


def test_random_batches_keep_the_books():
    rnd = random.Random(5)
    for _ in range(30):
        s = ledger(*[rnd.choice([0, 2, 4, 8]) for _ in range(4)])
        s.clock, n = 2000, 0
        for _ in range(40):
            batch = []
            for _ in range(rnd.randint(1, 6)):
                n += 1
                flags = rnd.choice([0, 0, 1, 2, 2, 4, 8, 16, 32, 66, 3])
                more = {"pending_id": rnd.randint(1, max(1, n - 1))} if flags in (4, 8) else {"timeout": rnd.randint(0, 2)} if flags & 2 else {}
                batch.append(move(rnd.choice([n, n, max(1, n - 2)]), rnd.randint(1, 4), rnd.randint(1, 4), rnd.randint(0, 9), T(flags), **more))
            before = (dict(s.accounts), dict(s.transfers))
            got = run(s, *batch, at=s.clock + rnd.choice([10, NS]))
            if "created" not in got:
                assert before == (s.accounts, s.transfers)
            s.pulse(s.clock)
            assert s.integrity() == []


def test_codecs():
    for n in (0, 1, 2**63, 2**127, 2**128 - 1):
        assert from_bytes(to_bytes(n)) == n
    ids = [time_id() for _ in range(1000)]
    assert ids == sorted(set(ids))
