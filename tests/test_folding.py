"""Groups of ledgers in a stream of small Arrow batches, against one state."""

import pyarrow as pa
import pytest

from test_engine import EVENT, RESULT, in_one_state, random_log
from tallyframe.functions.types import AMOUNT_MAX, WIDE, Account, Transfer
from tallyframe.operators import engine
from tallyframe.operators.folding import Fold
from tallyframe.operators.kernel import Packed

SHAPE = engine.OUT.format(w="long") + ", due long, made long"


def rows_of(log):
    """A log as the rows that a group's task reads; ids that come again are marked."""
    ids = [i for what, _, records in log if what == "transfer" for r in records for i in (r.id, *[r.pending_id] * (r.pending_id > 0))]
    rows = []
    for n, (what, time, records) in enumerate(log):
        imports = bool(records) and bool(records[0].flags & (1 << 4 if what == "account" else 1 << 8))
        for i, r in enumerate(records or [None]):
            known = dict.fromkeys(engine.NAMES) | ({k: -1 if k == "amount" and v == AMOUNT_MAX else v for k, v in vars(r).items()} if r else {})
            rows.append({"component": 0, "batch": n, "idx": i, "what": what, "size": len(records), "batch_time": time, "imports": imports, "again": what == "transfer" and ids.count(r.id) > 1, **known})
    return rows


def answered(rows, size, fold=None):
    shape = pa.schema([(n, pa.string() if n == "what" else pa.bool_() if n in ("imports", "again") else pa.int64()) for n in rows[0]])
    fold = fold or Fold(SHAPE, False, (10**9, 10**9))
    out = [r for b in fold(iter(pa.Table.from_pylist(rows, shape).to_batches(size))) for r in b.to_pylist()]
    return sorted(tuple(r[c] for c in RESULT) for r in out if r["what"] == "result"), sorted(tuple(r[c] for c in EVENT) for r in out if r["what"] == "event")


@pytest.mark.parametrize("few", (0, 20_000))
def test_small_batches_equal_one_state(few, monkeypatch):
    monkeypatch.setattr(Packed, "FEW", few)
    assert "id" in WIDE
    for seed in (10, 11, 12):
        log = random_log(seed, True)
        assert answered(rows_of(log), 3) == in_one_state(log)


def test_only_what_comes_again_is_held():
    accounts = [Account(id=i, ledger=1, code=1) for i in (1, 2)]
    moved = [Transfer(id=i, debit_account_id=1, credit_account_id=2, amount=1, ledger=1, code=1) for i in range(1, 1001)]
    log = [("account", 10**6, accounts), ("transfer", 10**7, [*moved, moved[7]])]
    fold = Fold(SHAPE, False, (None, None))
    got = answered(rows_of(log), 50, fold)
    assert got == in_one_state(log) and got[0][-1][3] == "exists"
    assert list(fold.state.transfers) == [8] and not fold.state.events and not fold.state.transfer_times


def test_a_batch_of_both_kinds_runs_one_after_the_other():
    accounts = [Account(id=i, ledger=1, code=1) for i in range(1, 7)]
    moved = [Transfer(id=i, debit_account_id=i, credit_account_id=i + 1, amount=1, ledger=1, code=1, flags=int(i < 5)) for i in range(1, 6)]
    rows = rows_of([("account", 10**6, accounts), ("transfer", 10**6, moved)])
    rows = sorted(({**r, "batch": 0} for r in rows), key=lambda r: (r["idx"], r["what"]))
    assert all(r[3] == "created" for r in answered(rows, 2)[0])
