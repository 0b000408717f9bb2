"""Requests as a stream: each group of ledgers keeps its state between batches, an entry for each account and transfer."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.types import AMOUNT_MAX, Account, PendingStatus, Transfer
from ..operators.kernel import State
from ..plans.accept import BALANCES

OUT = "what string, batch long, idx long, timestamp long, status string, kind int, transfer_key string, debit_account_id string, credit_account_id string, amount string, " + ", ".join(f"{s}_{b} string" for s in ("dr", "cr") for b in BALANCES)
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def records(kind: type, part: pd.DataFrame) -> list:
    out = []
    for r in part.to_dict("records"):
        values = {f: 0 if r[f] is None or r[f] != r[f] else int(r[f]) for f in kind.__dataclass_fields__}
        if values.get("amount") == -1:
            values["amount"] = AMOUNT_MAX
        out.append(kind(**values))
    return out


class Requests(StatefulProcessor):
    """Runs the requests of a group in order. A batch reads and writes the entries that its events name, and no others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = lambda name: handle.getMapState(name, "id string", "value binary")
        self.accounts, self.transfers, self.statuses, self.orphans, self.times = map(entry, ("accounts", "transfers", "statuses", "orphans", "times"))
        self.facts = handle.getValueState("facts", "value binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        frame = pd.concat(list(rows)).sort_values(["batch", "idx"], kind="stable")
        last_account, last_transfer, due = pickle.loads(self.facts.get()[0]) if self.facts.exists() else (0, 0, [])
        out: list[tuple] = []
        for (batch, what), part in frame.groupby(["batch", "what"], sort=False):
            time = int(part.batch_time.iloc[0])
            todo = [] if what == "tick" else records(Account if what == "account" else Transfer, part)
            state = self.load(todo, due, last_account, last_transfer, time if what == "tick" else None)
            before = dict(state.accounts), dict(state.transfers), dict(state.pending), set(state.orphans), set(state.account_times), set(state.transfer_times)
            if what == "tick":
                state.pulse(time)
            else:
                run = state.create_accounts if what == "account" else state.create_transfers
                out += [("result", batch, i, at, s, *[None] * (len(COLUMNS) - 5)) for i, (at, s) in zip(part.idx, run(todo, time), strict=True)]
            for e in state.events:
                t = e.transfer or e.pending
                balances = [str(getattr(a, b)) for a in (e.debit, e.credit) for b in BALANCES]
                out.append(("event", batch, None, e.timestamp, None, int(e.status), str(t.id), str(e.debit.id), str(e.credit.id), str(e.amount), *balances))
            self.store(state, before)
            last_account, last_transfer, due = state.last_account, state.last_transfer, state.due
        self.facts.update((pickle.dumps((last_account, last_transfer, due), 5),))
        yield pd.DataFrame(out, columns=COLUMNS).astype(object)

    def close(self) -> None:
        pass

    def load(self, todo: list, due: list, last_account: int, last_transfer: int, until: int | None) -> State:
        """What the events can meet; for a tick, the transfers that run out by then."""
        state = State(last_account=last_account, last_transfer=last_transfer, due=due)
        read = lambda m, i: pickle.loads(m.getValue((str(i),))[0]) if m.containsKey((str(i),)) else None
        accounts, transfers, times = set(), set(), {x.timestamp for x in todo if x.timestamp}
        for x in todo:
            if isinstance(x, Account):
                accounts.add(x.id)
            else:
                accounts |= {x.debit_account_id, x.credit_account_id}
                transfers |= {x.id, x.pending_id}
        if until is not None:
            transfers |= {i for expires, _, i in due if expires <= until}
        for i in transfers:
            if (plain := read(self.transfers, i)) is not None:
                state.transfers[i] = t = Transfer(*plain)
                accounts |= {t.debit_account_id, t.credit_account_id}
            if (status := read(self.statuses, i)) is not None:
                state.pending[i] = PendingStatus(status)
            if self.orphans.containsKey((str(i),)):
                state.orphans.add(i)
        for i in accounts:
            if (plain := read(self.accounts, i)) is not None:
                state.accounts[i] = Account(*plain)
        for at in times:
            if (kind := read(self.times, at)) is not None:
                (state.account_times if kind == "account" else state.transfer_times).add(at)
        return state

    def store(self, state: State, before: tuple) -> None:
        accounts, transfers, pending, orphans, account_times, transfer_times = before
        put = lambda m, i, x: m.updateValue((str(i),), (pickle.dumps(x, 5),))
        for i, a in state.accounts.items():
            if accounts.get(i) != a:
                put(self.accounts, i, tuple(vars(a).values()))
        for i, t in state.transfers.items():
            if i not in transfers:
                put(self.transfers, i, tuple(vars(t).values()))
        for i, s in state.pending.items():
            if pending.get(i) != s:
                put(self.statuses, i, int(s))
        for i in state.orphans - orphans:
            put(self.orphans, i, True)
        for kind, now, then in (("account", state.account_times, account_times), ("transfer", state.transfer_times, transfer_times)):
            for at in now - then:
                put(self.times, at, kind)


def answers(requests: DataFrame) -> DataFrame:
    """Results and events of the requests of a stream (see engine.fold for its columns; component: its group); wide numbers are their digits.

    Ticks are rows like others, so a replay expires the same transfers at the same places. Needs the state store
    that keeps entries apart (spark.sql.streaming.stateStore.providerClass: RocksDBStateStoreProvider). What waits to run out is kept as one value.
    """
    return requests.groupBy("component").transformWithStateInPandas(Requests(), OUT, "append", "none")


def results(requests: DataFrame) -> DataFrame:
    """The result of each request event."""
    return answers(requests).where("what = 'result'").select("batch", "idx", "timestamp", "status")
