"""The ledger's requests as methods, over tables that grow by a step for each batch.

Ids and amounts have 128 bits: columns of 16 bytes, which sort as numbers. A request brings as many
rows to the driver as its limit allows; of the stored tables only the rows that its events name.
Bulk loads are for ``operators.engine`` and ``plans.fast``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import fields
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.types import BATCH_MAX, WIDE, Account, AccountFlags, PendingStatus, Transfer, TransferFlags, from_bytes, schema, to_bytes
from .operators import reads
from .operators.kernel import SIDES, Event, State
from .operators.reads import AccountFilter, ChangeEventsFilter, QueryFilter
from .plans.checks import violations
from .sources.journal import Journal
from .sources.statement import Statement, parse, shown

EVENT = (
    "timestamp long, kind int, transfer_key binary, debit_account_id binary, credit_account_id binary, amount binary, amount_requested binary, "
    "ledger long, user_data_128 binary, user_data_64 decimal(20,0), user_data_32 long, code long, dr_flags long, cr_flags long, "
    + ", ".join(f"{s}_{b} binary" for s in ("dr", "cr") for b in SIDES)
)
SCHEMAS = {"accounts": schema(Account, True), "transfers": schema(Transfer, True), "statuses": "id binary, status int, expires_at long", "orphans": "id binary", "events": EVENT}
START = {"time": 0, "last_account": 0, "last_transfer": 0, "next_expiry": None}


def cells(record: Account | Transfer) -> tuple:
    return tuple(to_bytes(v) if n in WIDE else Decimal(v) if n == "user_data_64" else int(v) for n, v in vars(record).items())


def record(kind: type, row) -> Account | Transfer:
    return kind(**{f.name: from_bytes(bytes(row[f.name])) if f.name in WIDE else int(row[f.name]) for f in fields(kind)})


def event_cells(e: Event) -> tuple:
    t = e.transfer or e.pending
    balances = [to_bytes(getattr(a, b)) for a in (e.debit, e.credit) for b in SIDES]
    wide = map(to_bytes, (t.id, e.debit.id, e.credit.id, e.amount, e.amount_requested))
    return (e.timestamp, int(e.status), *wide, e.debit.ledger, to_bytes(t.user_data_128), Decimal(t.user_data_64), t.user_data_32, t.code, int(e.debit.flags), int(e.credit.flags), *balances)


def latest(df: DataFrame, key: str = "id") -> DataFrame:
    """Of the rows of each key the one of the last step."""
    columns = [c for c in df.columns if c not in (key, "step")]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), "step").alias("r")).select(*[key if c == key else f"r.{c}" for c in df.columns if c != "step"])


def failures(results: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [(i, status) for i, (_, status) in enumerate(results) if status != "created"]


class Ledger:
    """Accounts and transfers under a folder. clock gives nanoseconds; a batch never goes back behind the one before."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = time.time_ns):
        self.spark, self.clock = spark, clock
        self.journal = Journal(spark, root.rstrip("/"), SCHEMAS)

    # --- tables

    def accounts(self) -> DataFrame:
        return latest(self.journal.read("accounts"))

    def transfers(self) -> DataFrame:
        return self.journal.read("transfers").drop("step")

    def events(self) -> DataFrame:
        return self.journal.read("events").drop("step")

    def statuses(self) -> DataFrame:
        return latest(self.journal.read("statuses"))

    def _facts(self) -> dict:
        steps = self.journal.steps()
        return steps[-1]["facts"] if steps else START

    # --- writes

    def create_accounts(self, batch: list[Account]) -> list[tuple[int, str]]:
        """(timestamp, status) for each account, in order."""
        return self._create(batch, "create_accounts")

    def create_transfers(self, batch: list[Transfer]) -> list[tuple[int, str]]:
        """(timestamp, status) for each transfer, in order."""
        return self._create(batch, "create_transfers")

    def create_accounts_sparse(self, batch: list[Account]) -> list[tuple[int, str]]:
        """(place, status) of those accounts only that weren't made."""
        return failures(self.create_accounts(batch))

    def create_transfers_sparse(self, batch: list[Transfer]) -> list[tuple[int, str]]:
        """(place, status) of those transfers only that weren't made."""
        return failures(self.create_transfers(batch))

    def create_many(self, batches: list[list], operation: str | None = None) -> list[list[tuple[int, str]]]:
        """Several batches of one kind in a request: each its own, with timestamps that follow on."""
        if sum(map(len, batches)) > BATCH_MAX:
            raise ValueError(f"more than {BATCH_MAX} events")
        events = [e for b in batches for e in b]
        if not events:
            return [[] for _ in batches]
        operation = operation or ("create_accounts" if isinstance(events[0], Account) else "create_transfers")
        self.expire()
        facts = self._facts()
        now = max(self.clock(), facts["time"] + len(events))
        state = self._load(events, facts)

        def run() -> list[list[tuple[int, str]]]:
            out, time = [], now - len(events)
            for b in batches:
                time += len(b)
                out.append(getattr(state, operation)(b, time) if b else [])
            return out

        return self._run(state, facts, now, run)

    def _create(self, batch: list, operation: str) -> list[tuple[int, str]]:
        return self.create_many([batch], operation)[0]

    def expire(self) -> int:
        """Release the pending transfers that are due by now, a request's worth at a time; the number of them."""
        total = 0
        while (facts := self._facts())["next_expiry"] is not None and facts["next_expiry"] <= self.clock():
            due = self.statuses().where((F.col("status") == int(PendingStatus.PENDING)) & (F.col("expires_at") > 0))
            ids = [from_bytes(bytes(r.id)) for r in due.where(F.col("expires_at") <= self.clock()).join(self.transfers().select("id", "timestamp"), "id").orderBy("expires_at", "timestamp").limit(BATCH_MAX).select("id").collect()]
            state = self._state(set(), set(ids), set(), facts)
            now = max(self.clock(), facts["time"] + len(ids))
            # what is due next is looked up anew, as resolved transfers leave the mark too early
            rest = due.where(~F.col("id").isin([bytearray(to_bytes(i)) for i in ids])) if ids else due
            facts = {**facts, "next_expiry": rest.agg(F.min("expires_at")).first()[0]}
            self._run(state, facts, now, lambda state=state, now=now: state.pulse(now, BATCH_MAX))
            total += len(ids)
        return total

    def _load(self, batch: list, facts: dict) -> State:
        if isinstance(batch[0], Account):
            return self._state({a.id for a in batch}, set(), {a.timestamp for a in batch if a.timestamp}, facts)
        sides = {i for t in batch for i in (t.debit_account_id, t.credit_account_id)}
        return self._state(sides, {i for t in batch for i in (t.id, t.pending_id)}, {t.timestamp for t in batch if t.timestamp}, facts)

    def _named(self, df: DataFrame, ids: Iterable[int], name: str = "id") -> DataFrame:
        """The rows of so many ids, at most some thousands, which are sent along."""
        wanted = self.spark.createDataFrame([(to_bytes(i),) for i in ids], f"{name} binary")
        return df.join(F.broadcast(wanted), name, "left_semi")

    def _state(self, accounts: set[int], transfers: set[int], times: set[int], facts: dict) -> State:
        """What the events of a request can meet."""
        s = State(last_account=facts["last_account"], last_transfer=facts["last_transfer"])
        if transfers:
            for r in self._named(self.transfers(), transfers).collect():
                t = record(Transfer, r)
                s.transfers[t.id] = t
                accounts |= {t.debit_account_id, t.credit_account_id}
            for r in latest(self._named(self.journal.read("statuses"), transfers)).collect():
                key = from_bytes(bytes(r.id))
                s.pending[key] = PendingStatus(r.status)
                if r.status == PendingStatus.PENDING and r.expires_at:
                    s.due.append((r.expires_at, s.transfers[key].timestamp, key))
            s.due.sort()
            s.orphans = {from_bytes(bytes(r.id)) for r in self._named(self.journal.read("orphans"), transfers).collect()}
        for r in latest(self._named(self.journal.read("accounts"), accounts)).collect() if accounts else ():
            a = record(Account, r)
            s.accounts[a.id] = a
        if times:
            used = lambda df: {r.timestamp for r in df.where(F.col("timestamp").isin(list(times))).select("timestamp").collect()}
            s.account_times, s.transfer_times = used(self.journal.read("accounts")), used(self.transfers())
        return s

    def _run(self, state: State, facts: dict, now: int, step: Callable):
        """Run a step and publish what it changed."""
        accounts, transfers, pending, orphans = dict(state.accounts), set(state.transfers), dict(state.pending), set(state.orphans)
        out = step()
        due = [t.expires_at() for k, t in state.transfers.items() if k not in transfers and t.expires_at()]
        rows = {
            "accounts": [cells(a) for k, a in state.accounts.items() if accounts.get(k) != a],
            "transfers": [cells(t) for k, t in state.transfers.items() if k not in transfers],
            "statuses": [(to_bytes(k), int(v), state.transfers[k].expires_at()) for k, v in state.pending.items() if pending.get(k) != v],
            "orphans": [(to_bytes(i),) for i in state.orphans - orphans],
            "events": [event_cells(e) for e in state.events],
        }
        tables = {n: self.spark.createDataFrame(r, SCHEMAS[n]).coalesce(1) for n, r in rows.items() if r}
        next_expiry = min([*due, *([facts["next_expiry"]] if facts["next_expiry"] is not None else [])], default=None)
        self.journal.publish(tables, {"time": now, "last_account": state.last_account, "last_transfer": state.last_transfer, "next_expiry": next_expiry})
        return out

    # --- reads

    def lookup_accounts(self, ids: list[int]) -> DataFrame:
        return reads.lookup(latest(self._named(self.journal.read("accounts"), ids)), ids)

    def lookup_transfers(self, ids: list[int]) -> DataFrame:
        return reads.lookup(self.transfers(), ids)

    def get_account_transfers(self, f: AccountFilter) -> DataFrame:
        return reads.account_transfers(self.transfers(), f)

    def get_account_balances(self, f: AccountFilter) -> DataFrame:
        return reads.account_balances(latest(self._named(self.journal.read("accounts"), [f.account_id])), self.events(), f)

    def query_accounts(self, f: QueryFilter) -> DataFrame:
        return reads.scan(self.accounts(), f)

    def query_transfers(self, f: QueryFilter) -> DataFrame:
        return reads.scan(self.transfers(), f)

    def get_change_events(self, f: ChangeEventsFilter) -> DataFrame:
        return reads.change_events(self.events(), self.transfers(), self.accounts(), f)

    def execute(self, text: str) -> list:
        """The answer to each statement of a text: results of a create, a DataFrame of a read, the operations of help."""
        return [self._answer(s) for s in parse(text)]

    def show(self, text: str) -> list[str]:
        """The answers to a text's statements as the console shows them, an object each."""
        out = []
        for s in parse(text):
            answer, flags = self._answer(s), AccountFlags if "accounts" in s.operation else TransferFlags
            if s.operation.startswith("create"):
                out += [shown(SimpleNamespace(timestamp=at, status=status)) for at, status in answer]
            else:
                out += answer if s.operation == "help" else [shown(r, flags) for r in answer.collect()]
        return out

    def _answer(self, s: Statement):
        if s.operation == "help":
            return ["create_accounts", "create_transfers", "lookup_accounts", "lookup_transfers", "get_account_transfers", "get_account_balances", "query_accounts", "query_transfers"]
        single = s.operation.startswith(("get", "query"))
        return getattr(self, s.operation)(s.arguments[0] if single else s.arguments)

    # --- upkeep

    def check(self) -> DataFrame:
        """invariant, broken: see plans.checks."""
        return violations(self.accounts(), self.transfers(), self.events(), self.statuses())

    def inspect(self) -> DataFrame:
        """name, rows, steps: how many rows each table holds, and how many steps they come from."""
        parts = [self.journal.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.countDistinct("step").alias("steps")) for n in SCHEMAS]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self, events_from: int = 0) -> int:
        """Write all rows as one full step, sorted by time: of accounts and statuses the latest only.

        Events before events_from are left out, but for those of accounts that keep history.
        """
        steps = self.journal.steps()
        if not steps:
            return 0
        tables = {}
        for name in SCHEMAS:
            rows = self.journal.read(name, steps)
            if name in ("accounts", "statuses"):
                rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("step")))).where("nth = 1").drop("nth")
            elif name == "events":
                kept = (F.col("dr_flags").bitwiseOR(F.col("cr_flags"))).bitwiseAND(int(AccountFlags.HISTORY)) != 0
                rows = rows.where((F.col("timestamp") >= events_from) | kept)
            tables[name] = rows.repartitionByRange("timestamp").sortWithinPartitions("timestamp") if "timestamp" in rows.columns else rows
        return self.journal.publish(tables, steps[-1]["facts"], full=True)
