"""The ordered rules of the ledger, over plain dicts: exact, deterministic, without Spark.

A State is changed by batches of events in order. Failed chains are undone through a log of
old values; ids of transfers that failed for a passing reason stay taken.
"""

from __future__ import annotations

import heapq
import marshal
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from types import SimpleNamespace

from ..functions.types import AMOUNT_MAX, BATCH_MAX, NS, TRANSIENT, U63_MAX, U128_MAX, Account, AccountFlags, PendingStatus, Transfer, TransferFlags

# plain numbers: enum members are slow to combine
A, T = (SimpleNamespace(**{f.name: f.value for f in flags}) for flags in (AccountFlags, TransferFlags))
SIDES = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")


def replace(record, **changes):
    """A copy with other values."""
    out = object.__new__(type(record))
    out.__dict__.update(record.__dict__)
    out.__dict__.update(changes)
    return out


@dataclass(frozen=True)
class Event:
    """What a transfer or an expiry did: the type, and both accounts after it."""

    timestamp: int
    status: PendingStatus
    transfer: Transfer | None
    pending: Transfer | None
    amount: int
    amount_requested: int
    debit: Account
    credit: Account


@dataclass(frozen=True)
class Part:
    """Some events of a batch: their places in it, its size, and whether it imports, as its first event says."""

    places: Sequence[int]
    size: int
    imported: bool


class Packed(dict):
    """Records by id. settle() packs those that were set since into bytes, which are read again where they are asked for."""

    #: So many records stay as they are.
    FEW = 20_000

    def __init__(self, kind: type):
        super().__init__()
        self.kind, self.fresh = kind, set()

    def __getitem__(self, key):
        found = dict.__getitem__(self, key)
        return self.kind(*marshal.loads(found)) if type(found) is bytes else found

    def get(self, key, default=None):
        found = dict.get(self, key)
        return default if found is None else self.kind(*marshal.loads(found)) if type(found) is bytes else found

    def __setitem__(self, key, value) -> None:
        self.fresh.add(key)
        dict.__setitem__(self, key, value)

    def settle(self) -> None:
        if len(self.fresh) < self.FEW:
            return
        for key in self.fresh:
            found = dict.get(self, key)
            if found is not None and type(found) is not bytes:
                dict.__setitem__(self, key, marshal.dumps(tuple(vars(found).values())))
        self.fresh.clear()


@dataclass
class State:
    accounts: dict[int, Account] = field(default_factory=dict)
    transfers: dict[int, Transfer] = field(default_factory=dict)
    pending: dict[int, PendingStatus] = field(default_factory=dict)  # by the pending transfer's id
    orphans: set[int] = field(default_factory=set)
    events: list[Event] = field(default_factory=list)
    account_times: set[int] = field(default_factory=set)
    transfer_times: set[int] = field(default_factory=set)
    last_account: int = 0
    last_transfer: int = 0
    due: list[tuple[int, int, int]] = field(default_factory=list)  # (expires_at, timestamp, id), a heap

    # --- batches

    def create_accounts(self, batch: list[Account], timestamp: int, part: Part | None = None) -> list[tuple[int, str]]:
        return self._run(batch, timestamp, A.LINKED, A.IMPORTED, self._account, part)

    def create_transfers(self, batch: list[Transfer], timestamp: int, part: Part | None = None) -> list[tuple[int, str]]:
        return self._run(batch, timestamp, T.LINKED, T.IMPORTED, self._transfer, part)

    def _run(self, batch: list, timestamp: int, linked: int, imported: int, apply: Callable, part: Part | None) -> list[tuple[int, str]]:
        """(timestamp, status) for each event. A batch ends at its timestamp; events take the ones up to it."""
        part = part or Part(range(len(batch)), len(batch), bool(batch) and bool(batch[0].flags & imported))
        results: list[tuple[int, str]] = []
        chain: int | None = None
        broken = False
        undo: list[Callable[[], None]] = []
        for i, (place, e) in enumerate(zip(part.places, batch, strict=True)):
            at = timestamp - part.size + place + 1
            is_linked = bool(e.flags & linked)
            if is_linked and chain is None:
                chain, broken, undo = i, False, []
            log: list[Callable[[], None]] | None = undo if chain is not None else None  # nothing is taken back outside of a chain
            if is_linked and place == part.size - 1:
                status = "linked_event_chain_open"
            elif broken:
                status = "linked_event_failed"
            else:
                status = self._outer(e, part.imported, timestamp, imported)
                if status is None:
                    when = e.timestamp if e.flags & imported else at
                    status, at = apply(e, when, log)
            if status != "created" and chain is not None and not broken:
                broken = True
                for step in reversed(undo):
                    step()
                undo.clear()
                for j in range(chain, i):
                    results[j] = (results[j][0], "linked_event_failed")
            if status in TRANSIENT:
                self.orphans.add(e.id)
            results.append((at, status))
            if chain is not None and (not is_linked or status == "linked_event_chain_open"):
                chain, broken = None, False
        return results

    def _outer(self, e, expected: bool, timestamp: int, imported: int) -> str | None:
        is_imported = bool(e.flags & imported)
        if is_imported != expected:
            return "imported_event_not_expected" if is_imported else "imported_event_expected"
        if is_imported:
            if not 1 <= e.timestamp <= U63_MAX:
                return "imported_event_timestamp_out_of_range"
            if e.timestamp >= timestamp:
                return "imported_event_timestamp_must_not_advance"
        elif e.timestamp:
            return "timestamp_must_be_zero"
        return None

    def _set(self, log: list | None, d: dict, key, value) -> None:
        if log is not None:
            missing = key not in d
            old = d.get(key)
            log.append(lambda: d.pop(key) if missing else d.__setitem__(key, old))
        d[key] = value

    # --- accounts

    def _account(self, a: Account, at: int, log: list | None) -> tuple[str, int]:
        if a.reserved:
            return "reserved_field", at
        if a.flags >> 6:
            return "reserved_flag", at
        if a.id in (0, U128_MAX):
            return ("id_must_not_be_zero" if a.id == 0 else "id_must_not_be_int_max"), at
        if (e := self.accounts.get(a.id)) is not None:
            if a.flags != e.flags:
                return "exists_with_different_flags", at
            for name in ("user_data_128", "user_data_64", "user_data_32", "ledger", "code"):
                if getattr(a, name) != getattr(e, name):
                    return f"exists_with_different_{name}", at
            return "exists", e.timestamp
        if a.has(A.DEBITS_MUST_NOT_EXCEED_CREDITS) and a.has(A.CREDITS_MUST_NOT_EXCEED_DEBITS):
            return "flags_are_mutually_exclusive", at
        if a.debits_pending or a.debits_posted or a.credits_pending or a.credits_posted:
            return f"{next(name for name in SIDES if getattr(a, name))}_must_be_zero", at
        if not a.ledger:
            return "ledger_must_not_be_zero", at
        if not a.code:
            return "code_must_not_be_zero", at
        if a.has(A.IMPORTED) and (at <= self.last_account or at in self.transfer_times):
            return "imported_event_timestamp_must_not_regress", at
        self._set(log, self.accounts, a.id, replace(a, timestamp=at))
        self._stamp(log, "account", at)
        return "created", at

    def _stamp(self, log: list | None, kind: str, at: int) -> None:
        times, name = getattr(self, f"{kind}_times"), f"last_{kind}"
        old = getattr(self, name)

        def back() -> None:
            times.discard(at)
            setattr(self, name, old)

        if log is not None:
            log.append(back)
        times.add(at)
        setattr(self, name, max(old, at))

    # --- transfers

    def _transfer(self, t: Transfer, at: int, log: list | None) -> tuple[str, int]:
        if t.flags >> 9:
            return "reserved_flag", at
        if t.id in (0, U128_MAX):
            return ("id_must_not_be_zero" if t.id == 0 else "id_must_not_be_int_max"), at
        if (e := self.transfers.get(t.id)) is not None:
            return self._same(t, e, at)
        if t.id in self.orphans:
            return "id_already_failed", at
        if t.flags & (T.POST_PENDING_TRANSFER | T.VOID_PENDING_TRANSFER):
            return self._resolve(t, at, log), at
        return self._move(t, at, log), at

    def _same(self, t: Transfer, e: Transfer, at: int) -> tuple[str, int]:
        different = "exists_with_different_"
        for name in ("flags", "pending_id", "timeout"):
            if getattr(t, name) != getattr(e, name):
                return different + name, at
        if t.flags & (T.POST_PENDING_TRANSFER | T.VOID_PENDING_TRANSFER):
            p = self.transfers[e.pending_id]
            for name in ("debit_account_id", "credit_account_id"):
                if getattr(t, name) not in (0, getattr(e, name)):
                    return different + name, at
            if t.has(T.VOID_PENDING_TRANSFER):
                same = e.amount == p.amount if t.amount == 0 else t.amount == e.amount
            else:
                same = e.amount == p.amount if t.amount == AMOUNT_MAX else t.amount == e.amount
            if not same:
                return different + "amount", at
            for name in ("user_data_128", "user_data_64", "user_data_32"):
                if getattr(e, name) != (getattr(t, name) or getattr(p, name)):
                    return different + name, at
            for name in ("ledger", "code"):
                if getattr(t, name) not in (0, getattr(e, name)):
                    return different + name, at
            return "exists", e.timestamp
        for name in ("debit_account_id", "credit_account_id"):
            if getattr(t, name) != getattr(e, name):
                return different + name, at
        balancing = t.flags & (T.BALANCING_DEBIT | T.BALANCING_CREDIT)
        if t.amount < e.amount if balancing else t.amount != e.amount:
            return different + "amount", at
        for name in ("user_data_128", "user_data_64", "user_data_32", "ledger", "code"):
            if getattr(t, name) != getattr(e, name):
                return different + name, at
        return "exists", e.timestamp

    def _move(self, t: Transfer, at: int, log: list | None) -> str:
        for side, i in (("debit", t.debit_account_id), ("credit", t.credit_account_id)):
            if i == 0 or i == U128_MAX:
                return f"{side}_account_id_must_not_be_{'zero' if i == 0 else 'int_max'}"
        flags = t.flags
        pending = bool(flags & T.PENDING)
        if t.debit_account_id == t.credit_account_id:
            return "accounts_must_be_different"
        if t.pending_id:
            return "pending_id_must_be_zero"
        if t.timeout and not pending:
            return "timeout_reserved_for_pending_transfer"
        if flags & (T.CLOSING_DEBIT | T.CLOSING_CREDIT) and not pending:
            return "closing_transfer_must_be_pending"
        if not t.ledger:
            return "ledger_must_not_be_zero"
        if not t.code:
            return "code_must_not_be_zero"
        dr, cr = self.accounts.get(t.debit_account_id), self.accounts.get(t.credit_account_id)
        if dr is None:
            return "debit_account_not_found"
        if cr is None:
            return "credit_account_not_found"
        if dr.ledger != cr.ledger:
            return "accounts_must_have_the_same_ledger"
        if t.ledger != dr.ledger:
            return "transfer_must_have_the_same_ledger_as_accounts"
        if t.has(T.IMPORTED):
            if at <= self.last_transfer or at in self.account_times:
                return "imported_event_timestamp_must_not_regress"
            if at <= dr.timestamp:
                return "imported_event_timestamp_must_postdate_debit_account"
            if at <= cr.timestamp:
                return "imported_event_timestamp_must_postdate_credit_account"
            if t.timeout:
                return "imported_event_timeout_must_be_zero"
        if dr.has(A.CLOSED):
            return "debit_account_already_closed"
        if cr.has(A.CLOSED):
            return "credit_account_already_closed"
        amount = t.amount
        if t.has(T.BALANCING_DEBIT):
            amount = min(amount, max(0, dr.credits_posted - dr.debits_posted - dr.debits_pending))
        if t.has(T.BALANCING_CREDIT):
            amount = min(amount, max(0, cr.debits_posted - cr.credits_posted - cr.credits_pending))
        debits, credits = dr.debits_pending + dr.debits_posted, cr.credits_pending + cr.credits_posted
        if debits + amount > U128_MAX or credits + amount > U128_MAX:  # else no part of them overflows
            sums = [("debits_posted", dr.debits_posted), ("credits_posted", cr.credits_posted)]
            if pending:
                sums = [("debits_pending", dr.debits_pending), ("credits_pending", cr.credits_pending), *sums]
            for name, s in [*sums, ("debits", debits), ("credits", credits)]:
                if s + amount > U128_MAX:
                    return f"overflows_{name}"
        if at + t.timeout * NS > U63_MAX:
            return "overflows_timeout"
        if dr.flags & A.DEBITS_MUST_NOT_EXCEED_CREDITS and debits + amount > dr.credits_posted:
            return "exceeds_credits"
        if cr.flags & A.CREDITS_MUST_NOT_EXCEED_DEBITS and credits + amount > cr.debits_posted:
            return "exceeds_debits"
        kept = replace(t, amount=amount, timestamp=at)
        if pending:
            dr, cr = replace(dr, debits_pending=dr.debits_pending + amount), replace(cr, credits_pending=cr.credits_pending + amount)
        else:
            dr, cr = replace(dr, debits_posted=dr.debits_posted + amount), replace(cr, credits_posted=cr.credits_posted + amount)
        if flags & T.CLOSING_DEBIT:
            dr = replace(dr, flags=dr.flags | A.CLOSED)
        if flags & T.CLOSING_CREDIT:
            cr = replace(cr, flags=cr.flags | A.CLOSED)
        self._book(log, kept, dr, cr, PendingStatus.PENDING if pending else PendingStatus.NONE, None, t.amount)
        if pending:
            self._set(log, self.pending, t.id, PendingStatus.PENDING)
            if t.timeout:
                heapq.heappush(self.due, (kept.expires_at(), at, t.id))
        return "created"

    def _book(self, log: list | None, t: Transfer, dr: Account, cr: Account, status: PendingStatus, p: Transfer | None, requested: int) -> None:
        self._set(log, self.transfers, t.id, t)
        self._set(log, self.accounts, dr.id, dr)
        self._set(log, self.accounts, cr.id, cr)
        self._stamp(log, "transfer", t.timestamp)
        self.events.append(Event(t.timestamp, status, t, p, t.amount, requested, dr, cr))
        if log is not None:
            log.append(lambda: self.events.pop())

    def _resolve(self, t: Transfer, at: int, log: list | None) -> str:
        post, void = t.has(T.POST_PENDING_TRANSFER), t.has(T.VOID_PENDING_TRANSFER)
        if post and void or t.flags & (T.PENDING | T.BALANCING_DEBIT | T.BALANCING_CREDIT | T.CLOSING_DEBIT | T.CLOSING_CREDIT):
            return "flags_are_mutually_exclusive"
        if t.pending_id == 0:
            return "pending_id_must_not_be_zero"
        if t.pending_id == U128_MAX:
            return "pending_id_must_not_be_int_max"
        if t.pending_id == t.id:
            return "pending_id_must_be_different"
        if t.timeout:
            return "timeout_reserved_for_pending_transfer"
        p = self.transfers.get(t.pending_id)
        if p is None:
            return "pending_transfer_not_found"
        if not p.has(T.PENDING):
            return "pending_transfer_not_pending"
        for name in ("debit_account_id", "credit_account_id", "ledger", "code"):
            if getattr(t, name) not in (0, getattr(p, name)):
                return f"pending_transfer_has_different_{name}"
        full = t.amount == (AMOUNT_MAX if post else 0)
        amount = p.amount if full else t.amount
        if amount > p.amount:
            return "exceeds_pending_transfer_amount"
        if void and amount < p.amount:
            return "pending_transfer_has_different_amount"
        status = self.pending[p.id]
        if status != PendingStatus.PENDING:
            return {PendingStatus.POSTED: "pending_transfer_already_posted", PendingStatus.VOIDED: "pending_transfer_already_voided", PendingStatus.EXPIRED: "pending_transfer_expired"}[status]
        if p.timeout and p.expires_at() <= at:
            return "pending_transfer_expired"
        if t.has(T.IMPORTED) and (at <= self.last_transfer or at in self.account_times):
            return "imported_event_timestamp_must_not_regress"
        dr, cr = self.accounts[p.debit_account_id], self.accounts[p.credit_account_id]
        if post:
            if dr.has(A.CLOSED):
                return "debit_account_already_closed"
            if cr.has(A.CLOSED):
                return "credit_account_already_closed"
        kept = replace(t, debit_account_id=dr.id, credit_account_id=cr.id, ledger=p.ledger, code=p.code, amount=amount, timeout=0, timestamp=at)
        kept = replace(kept, **{n: getattr(t, n) or getattr(p, n) for n in ("user_data_128", "user_data_64", "user_data_32")})
        dr, cr = self._released(p, dr, cr, reopen=void)
        if post:
            dr, cr = replace(dr, debits_posted=dr.debits_posted + amount), replace(cr, credits_posted=cr.credits_posted + amount)
        now = PendingStatus.POSTED if post else PendingStatus.VOIDED
        self._book(log, kept, dr, cr, now, p, t.amount)
        self._set(log, self.pending, p.id, now)
        return "created"

    @staticmethod
    def _released(p: Transfer, dr: Account, cr: Account, reopen: bool) -> tuple[Account, Account]:
        dr, cr = replace(dr, debits_pending=dr.debits_pending - p.amount), replace(cr, credits_pending=cr.credits_pending - p.amount)
        if reopen and p.has(T.CLOSING_DEBIT):
            dr = replace(dr, flags=dr.flags & ~A.CLOSED)
        if reopen and p.has(T.CLOSING_CREDIT):
            cr = replace(cr, flags=cr.flags & ~A.CLOSED)
        return dr, cr

    # --- between runs

    def to_plain(self) -> tuple:
        """The state without its events, in plain tuples."""
        rows = lambda d: [tuple(vars(x).values()) for x in d.values()]
        pending = [(k, int(v)) for k, v in self.pending.items()]
        return rows(self.accounts), rows(self.transfers), pending, sorted(self.orphans), sorted(self.account_times), sorted(self.transfer_times), self.last_account, self.last_transfer, list(self.due)

    @staticmethod
    def from_plain(x: tuple) -> State:
        accounts, transfers = ([kind(*r) for r in rows] for kind, rows in ((Account, x[0]), (Transfer, x[1])))
        pending = {k: PendingStatus(v) for k, v in x[2]}
        return State({a.id: a for a in accounts}, {t.id: t for t in transfers}, pending, set(x[3]), [], set(x[4]), set(x[5]), x[6], x[7], [tuple(d) for d in x[8]])

    # --- time

    def next_expiry(self) -> int | None:
        return self.due[0][0] if self._waiting() else None

    def _waiting(self) -> bool:
        """Whether anything is still to expire. Entries of transfers that were resolved or taken back are dropped when they come up."""
        while self.due:
            expires, at, key = self.due[0]
            t = self.transfers.get(key)
            if t is not None and t.timestamp == at and self.pending.get(key) == PendingStatus.PENDING:
                return True
            heapq.heappop(self.due)
        return False

    def pulse(self, timestamp: int, most: int = BATCH_MAX) -> int:
        """Expire what is due, in order of expiry and then creation, most at a time; the number of expired transfers."""
        return sum(self.pulses(timestamp, most))

    def pulses(self, timestamp: int, most: int = BATCH_MAX) -> Iterator[int]:
        """pulse(), and the number after each so many."""
        while True:
            keys = []
            while len(keys) < most and self._waiting() and self.due[0][0] <= timestamp:
                keys.append(heapq.heappop(self.due)[2])
            for i, key in enumerate(keys):
                p = self.transfers[key]
                dr, cr = self._released(p, self.accounts[p.debit_account_id], self.accounts[p.credit_account_id], True)
                self.accounts[dr.id], self.accounts[cr.id] = dr, cr
                self.pending[key] = PendingStatus.EXPIRED
                self.events.append(Event(timestamp - len(keys) + i + 1, PendingStatus.EXPIRED, None, p, p.amount, 0, dr, cr))
            yield len(keys)
            if len(keys) < most:
                return

    def integrity(self) -> list[str]:
        """What is wrong with the books, if anything."""
        found = []
        for kind in ("posted", "pending"):
            sums: dict[int, int] = {}
            for a in self.accounts.values():
                sums[a.ledger] = sums.get(a.ledger, 0) + getattr(a, f"debits_{kind}") - getattr(a, f"credits_{kind}")
            found += [f"ledger {k}: {kind} debits and credits differ" for k, v in sums.items() if v]
        if self.account_times & self.transfer_times:
            found.append("a timestamp is used twice")
        held = sum(self.transfers[k].amount for k, s in self.pending.items() if s == PendingStatus.PENDING)
        if held != sum(a.debits_pending for a in self.accounts.values()):
            found.append("pending amounts differ from pending balances")
        return found
