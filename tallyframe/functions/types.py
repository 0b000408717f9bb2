"""Records, flags, statuses and codecs of the ledger."""

from __future__ import annotations

import hashlib
import os
import time
from dataclasses import dataclass, fields
from enum import IntEnum, IntFlag

U128_MAX = 2**128 - 1
U64_MAX = 2**64 - 1
U63_MAX = 2**63 - 1
NS = 1_000_000_000
#: Posting or balancing "as much as there is".
AMOUNT_MAX = U128_MAX
#: Most results of a request, and of a change events request.
BATCH_MAX, CHANGE_EVENTS_MAX = 8189, 2730


class AccountFlags(IntFlag):
    LINKED = 1
    DEBITS_MUST_NOT_EXCEED_CREDITS = 2
    CREDITS_MUST_NOT_EXCEED_DEBITS = 4
    HISTORY = 8
    IMPORTED = 16
    CLOSED = 32


class TransferFlags(IntFlag):
    LINKED = 1
    PENDING = 2
    POST_PENDING_TRANSFER = 4
    VOID_PENDING_TRANSFER = 8
    BALANCING_DEBIT = 16
    BALANCING_CREDIT = 32
    CLOSING_DEBIT = 64
    CLOSING_CREDIT = 128
    IMPORTED = 256


class AccountFilterFlags(IntFlag):
    DEBITS = 1
    CREDITS = 2
    REVERSED = 4


class QueryFilterFlags(IntFlag):
    REVERSED = 1


class PendingStatus(IntEnum):
    NONE = 0
    PENDING = 1
    POSTED = 2
    VOIDED = 3
    EXPIRED = 4


#: Change event types by pending status.
EVENT_TYPES = ["single_phase", "two_phase_pending", "two_phase_posted", "two_phase_voided", "two_phase_expired"]

CREATED = 2**32 - 1

#: Codes of account statuses.
ACCOUNT_STATUS = {
    "linked_event_failed": 1, "linked_event_chain_open": 2, "timestamp_must_be_zero": 3, "reserved_field": 4, "reserved_flag": 5,
    "id_must_not_be_zero": 6, "id_must_not_be_int_max": 7, "flags_are_mutually_exclusive": 8, "debits_pending_must_be_zero": 9,
    "debits_posted_must_be_zero": 10, "credits_pending_must_be_zero": 11, "credits_posted_must_be_zero": 12, "ledger_must_not_be_zero": 13,
    "code_must_not_be_zero": 14, "exists_with_different_flags": 15, "exists_with_different_user_data_128": 16,
    "exists_with_different_user_data_64": 17, "exists_with_different_user_data_32": 18, "exists_with_different_ledger": 19,
    "exists_with_different_code": 20, "exists": 21, "imported_event_expected": 22, "imported_event_not_expected": 23,
    "imported_event_timestamp_out_of_range": 24, "imported_event_timestamp_must_not_advance": 25,
    "imported_event_timestamp_must_not_regress": 26, "created": CREATED,
}

#: Codes of transfer statuses.
TRANSFER_STATUS = {
    "linked_event_failed": 1, "linked_event_chain_open": 2, "timestamp_must_be_zero": 3, "reserved_flag": 4, "id_must_not_be_zero": 5,
    "id_must_not_be_int_max": 6, "flags_are_mutually_exclusive": 7, "debit_account_id_must_not_be_zero": 8,
    "debit_account_id_must_not_be_int_max": 9, "credit_account_id_must_not_be_zero": 10, "credit_account_id_must_not_be_int_max": 11,
    "accounts_must_be_different": 12, "pending_id_must_be_zero": 13, "pending_id_must_not_be_zero": 14,
    "pending_id_must_not_be_int_max": 15, "pending_id_must_be_different": 16, "timeout_reserved_for_pending_transfer": 17,
    "ledger_must_not_be_zero": 19, "code_must_not_be_zero": 20, "debit_account_not_found": 21, "credit_account_not_found": 22,
    "accounts_must_have_the_same_ledger": 23, "transfer_must_have_the_same_ledger_as_accounts": 24, "pending_transfer_not_found": 25,
    "pending_transfer_not_pending": 26, "pending_transfer_has_different_debit_account_id": 27,
    "pending_transfer_has_different_credit_account_id": 28, "pending_transfer_has_different_ledger": 29,
    "pending_transfer_has_different_code": 30, "exceeds_pending_transfer_amount": 31, "pending_transfer_has_different_amount": 32,
    "pending_transfer_already_posted": 33, "pending_transfer_already_voided": 34, "pending_transfer_expired": 35,
    "exists_with_different_flags": 36, "exists_with_different_debit_account_id": 37, "exists_with_different_credit_account_id": 38,
    "exists_with_different_amount": 39, "exists_with_different_pending_id": 40, "exists_with_different_user_data_128": 41,
    "exists_with_different_user_data_64": 42, "exists_with_different_user_data_32": 43, "exists_with_different_timeout": 44,
    "exists_with_different_code": 45, "exists": 46, "overflows_debits_pending": 47, "overflows_credits_pending": 48,
    "overflows_debits_posted": 49, "overflows_credits_posted": 50, "overflows_debits": 51, "overflows_credits": 52,
    "overflows_timeout": 53, "exceeds_credits": 54, "exceeds_debits": 55, "imported_event_expected": 56,
    "imported_event_not_expected": 57, "imported_event_timestamp_out_of_range": 58, "imported_event_timestamp_must_not_advance": 59,
    "imported_event_timestamp_must_not_regress": 60, "imported_event_timestamp_must_postdate_debit_account": 61,
    "imported_event_timestamp_must_postdate_credit_account": 62, "imported_event_timeout_must_be_zero": 63,
    "closing_transfer_must_be_pending": 64, "debit_account_already_closed": 65, "credit_account_already_closed": 66,
    "exists_with_different_ledger": 67, "id_already_failed": 68, "created": CREATED,
}

#: A transfer that fails with one of these may not try again under its id.
TRANSIENT = {
    "debit_account_not_found", "credit_account_not_found", "pending_transfer_not_found", "exceeds_credits", "exceeds_debits",
    "debit_account_already_closed", "credit_account_already_closed",
}


@dataclass
class Account:
    id: int = 0
    debits_pending: int = 0
    debits_posted: int = 0
    credits_pending: int = 0
    credits_posted: int = 0
    user_data_128: int = 0
    user_data_64: int = 0
    user_data_32: int = 0
    reserved: int = 0
    ledger: int = 0
    code: int = 0
    flags: int = 0
    timestamp: int = 0

    def has(self, flag: AccountFlags) -> bool:
        return bool(self.flags & flag)


@dataclass
class Transfer:
    id: int = 0
    debit_account_id: int = 0
    credit_account_id: int = 0
    amount: int = 0
    pending_id: int = 0
    user_data_128: int = 0
    user_data_64: int = 0
    user_data_32: int = 0
    timeout: int = 0
    ledger: int = 0
    code: int = 0
    flags: int = 0
    timestamp: int = 0

    def has(self, flag: TransferFlags) -> bool:
        return bool(self.flags & flag)

    def expires_at(self) -> int:
        return self.timestamp + self.timeout * NS if self.has(TransferFlags.PENDING) and self.timeout else 0


#: Compact profile: ids and amounts that fit a signed long. Exact profile: 16 bytes, big-endian, which sort as numbers.
WIDE = {"id", "debits_pending", "debits_posted", "credits_pending", "credits_posted", "user_data_128", "debit_account_id", "credit_account_id", "amount", "pending_id"}


def schema(record: type, exact: bool = False) -> str:
    return ", ".join(f"{f.name} {'binary' if exact and f.name in WIDE else 'decimal(20,0)' if f.name == 'user_data_64' and exact else 'long'}" for f in fields(record))


def to_bytes(n: int) -> bytes:
    return n.to_bytes(16, "big")


def from_bytes(b: bytes) -> int:
    return int.from_bytes(b, "big")


_last = [0, 0]


def time_id() -> int:
    """A new id that grows with time: milliseconds, then 80 random bits, one more each time within a millisecond."""
    now = time.time_ns() // 1_000_000
    if now > _last[0]:
        _last[:] = [now, int.from_bytes(os.urandom(10), "big")]
    else:
        _last[1] += 1
    return _last[0] << 80 | _last[1] & (1 << 80) - 1


def scattered(number: int, how: str, seed: int = 0) -> int:
    """An id for a number under 2 ** 64 that gathered() leads back from: ascending, descending, from both ends, or with random bits around it."""
    if how == "descending" or how == "both" and number % 2:
        return U128_MAX - number - (how == "both")
    if how == "random":
        noise = int.from_bytes(hashlib.blake2b(f"{seed}:{number}".encode(), digest_size=8).digest(), "big")
        return noise >> 32 << 96 | number << 32 | noise & 0xFFFFFFFF
    return number


def gathered(id_: int, how: str) -> int:
    if how == "descending" or how == "both" and id_ % 2:
        return U128_MAX - id_ - (how == "both")
    return id_ >> 32 & U64_MAX if how == "random" else id_
