"""Bytes of requests, coroutines, id permutations, metrics and console output."""

import asyncio
import random
import struct

import pytest

from tallyframe.__main__ import main
from tallyframe.aio import AsyncLedger
from tallyframe.client import Ledger
from tallyframe.functions.types import NS, U64_MAX, U128_MAX, Account, AccountFlags, Transfer, from_bytes, gathered, scattered
from tallyframe.operators import engine
from tallyframe.operators.reads import AccountFilter, QueryFilter
from tallyframe.sources import wire


def test_records_and_bodies_round_trip(spark):
    rnd = random.Random(3)
    number = lambda bits: rnd.choice([0, 1, 2**bits - 1, rnd.getrandbits(bits)])
    batches = [[Transfer(**{n: number(8 * size) if n != "timestamp" else number(63) for n, size in wire.LAYOUT[Transfer].items()}) for _ in range(n)] for n in (4, 8, 0, 1, 70)]
    data = [b"".join(map(wire.to_record, b)) for b in batches]
    assert [[wire.from_record(Transfer, d[i : i + 128]) for i in range(0, len(d), 128)] for d in data] == batches
    body = wire.joined(data)
    assert wire.separated(body) == data and len(body) == sum(map(len, data)) + 128
    assert wire.joined(data[:4])[-10:] == bytes([1, 0, 0, 0, 8, 0, 4, 0, 4, 0])
    many = [b"x" * 128] * 100 + [b""] * 30
    assert wire.separated(wire.joined(many)) == many
    for bad in (b"", b"x" * 127, b"\0" * 128, b"\xff" * 128, body[128:], body[:-2] + b"\7\0"):
        with pytest.raises(ValueError):
            wire.separated(bad)
    rows = wire.decoded(spark.createDataFrame([(7, bytearray(body))], "request long, body binary"), Transfer).orderBy("batch_index", "idx").collect()
    flat = [(i, k, t) for i, b in enumerate(batches) for k, t in enumerate(b)]
    assert [(r.request, r.batch_index, r.idx) for r in rows] == [(7, i, k) for i, k, _ in flat]
    for r, (_, _, t) in zip(rows, flat, strict=True):
        assert all((from_bytes(bytes(r[n])) if size == 16 else int(r[n])) == getattr(t, n) for n, size in wire.LAYOUT[Transfer].items())


def test_ids_lead_back():
    for how in ("ascending", "descending", "both", "random"):
        numbers = [0, 1, 2, 3, 999, U64_MAX]
        ids = [scattered(n, how, 5) for n in numbers]
        assert [gathered(i, how) for i in ids] == numbers and len(set(ids)) == len(ids) and all(0 <= i <= U128_MAX for i in ids)


def test_requests_that_wait_go_together(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: 1000 * NS)

    async def run():
        shared = AsyncLedger(ledger)
        first = await shared.create_accounts([Account(id=i, ledger=1, code=1) for i in (1, 2)])
        calls = [shared.create_transfers([Transfer(id=i, debit_account_id=1, credit_account_id=2, amount=i, ledger=1, code=1, flags=i % 2)]) for i in range(1, 7)]
        answers = await asyncio.gather(*calls)
        return first, answers, await shared.lookup_accounts([1])

    first, answers, (row,) = asyncio.run(run())
    assert [s for _, s in first] == ["created"] * 2
    assert [a[0][1] for a in answers] == ["linked_event_chain_open", "created"] * 3  # a chain never goes on in the next caller's batch
    assert len({t for a in answers for t, _ in a}) == 6 and from_bytes(bytes(row.debits_posted)) == 2 + 4 + 6
    assert len(ledger.journal.steps()) <= 3  # accounts, the first transfer, and those that waited for it


def test_console_output(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: 1000 * NS)
    (made,) = ledger.show("create_accounts id=5 code=10 ledger=700 flags=history|credits_must_not_exceed_debits")
    assert made == '{\n  "timestamp": "1000000000000",\n  "status": "created"\n}'
    (shown,) = ledger.show("lookup_accounts id=5")
    assert '"id": "5"' in shown and '"flags": ["credits_must_not_exceed_debits","history"]' in shown and "reserved" not in shown


def test_sparse_results(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: 1000 * NS)
    assert ledger.create_accounts_sparse([Account(id=1, ledger=1, code=1), Account(id=0), Account(id=1, ledger=1, code=1)]) == [(1, "id_must_not_be_zero"), (2, "exists")]
    assert ledger.create_transfers_sparse([Transfer(id=1, debit_account_id=1, credit_account_id=2, ledger=1, code=1)]) == [(0, "credit_account_not_found")]


def test_metrics(spark):
    log = engine.requests(spark, [("account", 1000, [Account(id=i, ledger=1, code=1) for i in (1, 2)]), ("transfer", 2000, [Transfer(id=i, debit_account_id=1, credit_account_id=2 + i % 2, ledger=1, code=1, flags=2) for i in range(1, 6)])])
    out, seen = engine.observed(engine.execute(log))
    out.collect()
    assert seen.get["events"] == 7 and seen.get["failed"] == 3 and seen.get["two_phase_pending"] == 2 and seen.get["single_phase"] == 0


def test_compaction_keeps_history(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: 1000 * NS)
    ledger.create_accounts([Account(id=1, ledger=1, code=1, flags=int(AccountFlags.HISTORY)), Account(id=2, ledger=1, code=1), Account(id=3, ledger=1, code=1)])
    ledger.create_transfers([Transfer(id=1, debit_account_id=1, credit_account_id=2, ledger=1, code=1), Transfer(id=2, debit_account_id=2, credit_account_id=3, ledger=1, code=1)])
    ledger.compact(events_from=2**62)
    assert [from_bytes(bytes(r.transfer_key)) for r in ledger.events().collect()] == [1]


def test_requests_and_replies_as_bytes(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lambda: 1000 * NS)
    accounts = [Account(id=2**100 + i, ledger=1, code=1, flags=int(AccountFlags.HISTORY)) for i in range(3)]
    reply = wire.answer(ledger, "create_accounts", wire.joined([b"".join(map(wire.to_record, accounts[:2])), b"", wire.to_record(accounts[2]) + wire.to_record(accounts[0])]))
    parts = wire.separated(reply, wire.RESULT)
    assert [len(p) // 16 for p in parts] == [2, 0, 2]
    assert [struct.unpack("<QII", p[i : i + 16])[1] for p in parts for i in range(0, len(p), 16)] == [2**32 - 1] * 3 + [21]
    moved = [Transfer(id=i + 1, debit_account_id=2**100, credit_account_id=2**100 + 1 + i % 2, amount=2**90, ledger=1, code=1) for i in range(4)]
    alone = wire.answer(ledger, "create_transfers_unbatched", b"".join(map(wire.to_record, moved)))
    assert [struct.unpack("<QII", alone[i : i + 16])[1] for i in range(0, 64, 16)] == [2**32 - 1] * 4
    wanted = b"".join(i.to_bytes(16, "little") for i in (2**100, 5, 2**100 + 1))
    found = [[wire.from_record(Account, p[i : i + 128]) for i in range(0, len(p), 128)] for p in wire.separated(wire.answer(ledger, "lookup_accounts", wire.joined([wanted, b""], 16)))]
    assert [(a.id, a.debits_posted, a.credits_posted) for a in found[0]] == [(2**100, 2**92, 0), (2**100 + 1, 0, 2**91)] and found[1] == []
    f = AccountFilter(2**100, limit=3, flags=5)
    assert wire.from_record(AccountFilter, wire.to_record(f)) == f
    got = wire.answer(ledger, "get_account_transfers_unbatched", wire.to_record(f))
    assert [wire.from_record(Transfer, got[i : i + 128]).id for i in range(0, len(got), 128)] == [4, 3, 2]
    balances = wire.answer(ledger, "get_account_balances_unbatched", wire.to_record(f))
    assert int.from_bytes(balances[16:32], "little") == 2**92 and len(balances) == 3 * 128
    spoilt = bytearray(wire.to_record(f))
    spoilt[60] = 1  # a reserved byte
    assert wire.answer(ledger, "get_account_transfers_unbatched", bytes(spoilt)) == b""
    q = wire.to_record(QueryFilter(ledger=1, code=1, limit=2))
    assert len(q) == 64 and len(wire.answer(ledger, "query_transfers_unbatched", q)) == 256 == len(wire.separated(wire.answer(ledger, "query_accounts", wire.joined([q], 64)))[0])
    for operation, body in (("nothing", b""), ("create_accounts_unbatched", b"x"), ("query_accounts_unbatched", q + q)):
        with pytest.raises(ValueError):
            wire.answer(ledger, operation, body)


def test_command_line(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    told = list(main(["repl", folder], spark, ["create_accounts id=1 code=1 ledger=1,\n", " id=2 code=1 ledger=1; lookup_accounts", " nothing=3; create_transfers id=1 debit_account_id=1 credit_account_id=2 amount=7 ledger=1 code=1;"]))
    assert ['"status": "created"' in x for x in told] == [True, True, False, True] and told[2].startswith("Fail: ")
    assert "transfers 1 1" in list(main(["inspect", folder], spark)) and list(main(["compact", folder], spark)) == ["step 3"]
    assert all(x.endswith(" 0") for x in main(["check", folder], spark))
    assert next(iter(main(["benchmark", f"{folder}2", "--accounts", "20", "--transfers", "50"], spark))).startswith("load accepted = ")
