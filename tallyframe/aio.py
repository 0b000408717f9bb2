"""The ledger for coroutines: requests that come while one is under way go out together."""

from __future__ import annotations

import asyncio
from typing import Any

from .client import Ledger
from .functions.types import BATCH_MAX


class AsyncLedger:
    """The methods of a Ledger as coroutines.

    Creates of one kind that wait for a request under way share the next one, each as a batch of its own, up to a
    request's size: chains and timestamps stay apart, and each caller gets its own results.
    """

    def __init__(self, ledger: Ledger):
        self.ledger = ledger
        self._waiting: list[tuple[str, list, asyncio.Future]] = []
        self._sending: asyncio.Task | None = None

    async def create_accounts(self, batch: list) -> list[tuple[int, str]]:
        return await self._join("create_accounts", batch)

    async def create_transfers(self, batch: list) -> list[tuple[int, str]]:
        return await self._join("create_transfers", batch)

    async def _join(self, operation: str, batch: list) -> list[tuple[int, str]]:
        if len(batch) > BATCH_MAX:
            raise ValueError(f"more than {BATCH_MAX} events")
        done = asyncio.get_running_loop().create_future()
        self._waiting.append((operation, batch, done))
        if self._sending is None or self._sending.done():
            self._sending = asyncio.create_task(self._send())
        return await done

    async def _send(self) -> None:
        while self._waiting:
            operation, size, taken = self._waiting[0][0], 0, []
            while self._waiting and self._waiting[0][0] == operation and size + len(self._waiting[0][1]) <= BATCH_MAX:
                taken.append(self._waiting.pop(0))
                size += len(taken[-1][1])
            try:
                results = await asyncio.to_thread(self.ledger.create_many, [b for _, b, _ in taken], operation)
            except Exception as error:  # noqa: BLE001  whoever waits has to hear of it
                for _, _, done in taken:
                    done.set_exception(error)
                continue
            for (_, _, done), r in zip(taken, results, strict=True):
                done.set_result(r)

    def __getattr__(self, name: str) -> Any:
        """Reads: rows of the answer's DataFrame."""
        read = getattr(self.ledger, name)

        async def run(*arguments):
            return await asyncio.to_thread(lambda: read(*arguments).collect())

        return run
