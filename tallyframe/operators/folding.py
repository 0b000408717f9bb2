"""Groups of ledgers through the kernel as their events come by, in order: what is held is the state, an open chain and a batch of Arrow's."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import fields
from itertools import repeat, starmap

import pyarrow as pa

from ..functions.types import AMOUNT_MAX, U63_MAX, WIDE, Account, PendingStatus, Transfer, TransferFlags, from_bytes, to_bytes
from .kernel import Packed, Part, State

FIELDS = {kind: [f.name for f in fields(kind)] for kind in (Account, Transfer)}
KINDS = {"account": Account, "transfer": Transfer}
LINKED, PENDING = 1, int(TransferFlags.PENDING)
#: Rows of an answer that are sent at a time.
ROWS = 8192
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


class Fold:
    """The answer to a log that comes sorted by component, batch, idx and what.

    shape: the columns of the answer, in Spark's words. last_imports: the last batches that import
    accounts and transfers; times are held only as long as imports are compared with them. only: the
    rows wanted, 'result' or 'event', or both. Fields that the log's columns lack are zero.
    """

    def __init__(self, shape: str, exact: bool, last_imports: tuple[int | None, int | None], only: str | None = None):
        self.schema = pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in shape.split(", "))])
        self.exact, self.last_imports, self.only = exact, last_imports, only
        self.state, self.key, self.what, self.part = State(), None, None, (0, 0, False)
        self.held: tuple[list, list, list] = ([], [], [])  # places, records and whether their ids come again: of a chain that may go on
        self.later: dict[str, tuple[tuple, tuple]] = {}  # what a batch holds of the other kind
        self.results: list[tuple] = []
        self.events: list[tuple] = []

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()  # nothing of a state is in a cycle, and it would be looked through again and again
        gc.disable()
        try:
            yield from self._answers(batches)
        finally:
            gc.enable()
            gc.unfreeze()

    def _answers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: self._values(n, b.column(i)) for i, n in enumerate(b.schema.names)}
            component, batch, what, n = columns["component"], columns["batch"], columns["what"], b.num_rows
            seen = set(what)
            made = {w: list(zip(*[columns.get(f) or repeat(0, n) for f in FIELDS[kind]], strict=True)) for w, kind in KINDS.items() if w in seen}
            i = 0
            while i < n:
                run, j = (component[i], batch[i], what[i]), i + 1
                while j < n and what[j] == run[2] and batch[j] == run[1] and component[j] == run[0]:
                    j += 1
                if self.key != run[:2]:
                    yield from self._finish()
                    if self.key is None or self.key[0] != run[0]:
                        self.state = State(accounts=Packed(Account), transfers=Packed(Transfer))
                    self.key, self.what = run[:2], run[2]
                if run[2] == "tick":
                    yield from self._pulse(columns["batch_time"][i])
                else:
                    rows = columns["idx"][i:j], list(starmap(KINDS[run[2]], made[run[2]][i:j])), columns["again"][i:j]
                    yield from self._take(run[2], rows, (columns["batch_time"][i], columns["size"][i], columns["imports"][i]))
                i = j
        yield from self._finish()
        yield from self._sent(0)

    def _values(self, name: str, column: pa.Array) -> list:
        if self.exact and name in WIDE:
            return [0 if v is None else from_bytes(v) for v in column.to_pylist()]
        if name == "amount":
            return [AMOUNT_MAX if v == -1 else v for v in column.fill_null(0).to_numpy(zero_copy_only=False).tolist()]
        if pa.types.is_integer(column.type):
            return column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
        return column.to_pylist()

    def _take(self, what: str, rows: tuple[list, list, list], part: tuple[int, int, bool]) -> Iterator[pa.RecordBatch]:
        """Run the rows up to the end of their last whole chain. Those of a second kind in a batch wait for the first to end."""
        if what != self.what:
            waiting, _ = self.later.setdefault(what, (([], [], []), part))
            for held, more in zip(waiting, rows, strict=True):
                held += more
            return
        self.part = part
        if self.held[0]:
            rows = tuple(held + more for held, more in zip(self.held, rows, strict=True))
        cut = len(rows[0])
        while cut and rows[1][cut - 1].flags & LINKED:
            cut -= 1
        self.held = tuple(r[cut:] for r in rows)
        if cut:
            yield from self._apply(what, tuple(r[:cut] for r in rows) if self.held[0] else rows, *self.part)

    def _finish(self) -> Iterator[pa.RecordBatch]:
        """The end of a batch: what is held, a chain that stays open, and what waits behind it."""
        if self.held[0]:
            held, self.held = self.held, ([], [], [])
            yield from self._apply(self.what, held, *self.part)
        for what, (rows, part) in self.later.items():
            yield from self._apply(what, rows, *part)
        self.later = {}

    def _apply(self, what: str, rows: tuple[list, list, list], time: int, size: int, imports: bool) -> Iterator[pa.RecordBatch]:
        places, records, again = rows
        s, batch = self.state, self.key[1]
        run = s.create_accounts if what == "account" else s.create_transfers
        answers = run(records, time, Part(places, size, imports))
        if self.only != "event":
            self.results += [("result", batch, place, *r) for place, r in zip(places, answers, strict=True)]
        if what == "transfer":
            for r, more in zip(records, again, strict=True):
                if not more and not (r.timeout and r.flags & PENDING):  # nothing asks for it any more
                    s.transfers.pop(r.id, None)
                    s.pending.pop(r.id, None)
                    s.orphans.discard(r.id)
        accounts, transfers = self.last_imports
        if accounts is None or batch > accounts:
            s.transfer_times.clear()
        if transfers is None or batch > transfers:
            s.account_times.clear()
        self._drain()
        s.accounts.settle()
        s.transfers.settle()
        if len(self.results) > ROWS or len(self.events) > ROWS:
            yield from self._sent(ROWS)

    def _pulse(self, time: int) -> Iterator[pa.RecordBatch]:
        for _ in self.state.pulses(time):
            self._drain()
            self.state.accounts.settle()
            yield from self._sent(ROWS)

    def _drain(self) -> None:
        if self.only == "result":
            self.state.events.clear()
            return
        wide, batch = to_bytes if self.exact else (lambda x: x), self.key[1]
        for e in self.state.events:
            src, a, b = e.transfer or e.pending, e.debit, e.credit
            asked = wide(e.amount_requested) if self.exact or e.amount_requested <= U63_MAX else -1
            balances = [wide(x) for x in (a.debits_pending, a.debits_posted, a.credits_pending, a.credits_posted, b.debits_pending, b.debits_posted, b.credits_pending, b.credits_posted)]
            row = "event", batch, None, e.timestamp, None, int(e.status), wide(src.id), wide(a.id), wide(b.id), wide(e.amount), asked, a.ledger, src.flags, a.flags, b.flags, *balances
            # what expiries are put in order by
            self.events.append((*row, src.expires_at(), src.timestamp) if e.status == PendingStatus.EXPIRED else (*row, None, None))
        self.state.events.clear()

    def _sent(self, least: int) -> Iterator[pa.RecordBatch]:
        for rows in (self.results, self.events):
            if len(rows) > least:
                known = list(zip(*rows, strict=True))
                arrays = [pa.array(known[i], f.type) if i < len(known) else pa.nulls(len(rows), f.type) for i, f in enumerate(self.schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
                rows.clear()
