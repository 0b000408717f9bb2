"""Statements such as ``create_accounts id=1 code=10 ledger=700, id=2 code=10 ledger=700;``"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.types import U64_MAX, U128_MAX, Account, AccountFilterFlags, AccountFlags, QueryFilterFlags, Transfer, TransferFlags, from_bytes
from ..operators.reads import AccountFilter, QueryFilter

WIDTHS = {"user_data_64": 64, "timestamp_min": 64, "timestamp_max": 64, "timestamp": 64, "user_data_32": 32, "timeout": 32, "ledger": 32, "limit": 32, "code": 16}
OPERATIONS = {
    "create_accounts": (Account, AccountFlags), "create_transfers": (Transfer, TransferFlags), "lookup_accounts": (int, None), "lookup_transfers": (int, None),
    "get_account_transfers": (AccountFilter, AccountFilterFlags), "get_account_balances": (AccountFilter, AccountFilterFlags),
    "query_accounts": (QueryFilter, QueryFilterFlags), "query_transfers": (QueryFilter, QueryFilterFlags),
}


@dataclass(frozen=True)
class Statement:
    operation: str
    arguments: list


class StatementError(ValueError):
    pass


def number(text: str, bits: int) -> int:
    """Decimal, 0x, 0o or 0b; -N counts down from the largest number, so -0 is that."""
    body = text.removeprefix("-").replace("_", "")
    try:
        n = int(body, 0) if body[:2].lower() in ("0x", "0o", "0b") else int(body, 10)
    except ValueError:
        raise StatementError(f"not a number: {text}") from None
    top = (1 << bits) - 1
    if not 0 <= n <= top:
        raise StatementError(f"{text} does not fit {bits} bits")
    return top - n if text.startswith("-") else n


def parse(text: str) -> list[Statement]:
    return [parse_one(s) for s in text.split(";") if s.strip()]


def parse_one(text: str) -> Statement:
    words = text.split(None, 1)
    if words[0] == "help":
        return Statement("help", [])
    if words[0] not in OPERATIONS:
        raise StatementError(f"no such operation: {words[0]}")
    kind, flags = OPERATIONS[words[0]]
    objects = [x for x in (words[1] if len(words) > 1 else "").split(",")]
    arguments = []
    for o in objects:
        values: dict[str, int] = {}
        for pair in re.sub(r"\s*([=|])\s*", r"\1", o).split():
            name, sep, value = pair.partition("=")
            if not sep or not value:
                raise StatementError(f"expected name=value: {pair}")
            if kind is int:
                if name != "id":
                    raise StatementError(f"no such field: {name}")
            elif name not in kind.__dataclass_fields__ or name in ("reserved",):
                raise StatementError(f"no such field: {name}")
            if name == "flags":
                values[name] = 0
                for f in value.split("|"):
                    try:
                        values[name] |= flags[f.upper()]
                    except KeyError:
                        raise StatementError(f"no such flag: {f}") from None
            else:
                values[name] = number(value, WIDTHS.get(name, 128))
        if kind is int:
            if not values:
                raise StatementError("an id is needed")
            arguments.append(values["id"])
        else:
            if kind is AccountFilter and "account_id" not in values:
                raise StatementError("account_id is needed")
            if values or kind is QueryFilter:
                arguments.append(kind(**values))
    if kind in (AccountFilter, QueryFilter) and len(arguments) != 1:
        raise StatementError("one filter is needed")
    return Statement(words[0], arguments)


def shown(record, flags: type | None = None) -> str:
    """A record or row as the console shows it: every value as text, flags by their names."""
    values = record.asDict() if hasattr(record, "asDict") else vars(record)
    lines = []
    for name, value in values.items():
        if name == "reserved":
            continue
        if name == "flags" and flags:
            names = ",".join(f'"{f.name.lower()}"' for f in flags if value & f)
            lines.append(f'  "flags": [{names}]')
        else:
            number = from_bytes(bytes(value)) if isinstance(value, (bytes, bytearray)) else value
            lines.append(f'  "{name}": "{number}"')
    return "{\n" + ",\n".join(lines) + "\n}"


__all__ = ["shown", "Statement", "StatementError", "parse", "number", "U64_MAX", "U128_MAX"]
