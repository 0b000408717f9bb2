"""The rules of accounts and transfers as plans, for batches in which nothing hangs on a running balance.

Without chains, limits, balancing, closing and imports a transfer's status depends on its own
fields, its accounts, and the events that name the same transfer id. All of those meet in one
shuffle: a transfer goes to its id, a post or void to that of its pending transfer, and
windows over that key answer which came first, what is pending and who resolved it.
Columns are those of the compact profile, with `at` for the time that a transfer is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import NS, TRANSIENT, U63_MAX, PendingStatus, TransferFlags

T = TransferFlags
DATA = ("user_data_128", "user_data_64", "user_data_32")
BALANCES = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")
SHAPE = ("flags", "pending_id", "timeout", "debit_account_id", "credit_account_id", "amount", *DATA, "ledger", "code")
#: What the compact profile holds for "as much as there is".
ALL = -1


def first_of(*rules: tuple[Column, str]) -> Column:
    """The status of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for test, status in reversed(rules):
        out = F.when(test, F.lit(status)).otherwise(out)
    return out


def has(flags: Column, wanted: int) -> Column:
    return flags.bitwiseAND(int(wanted)) != 0


def account_rules() -> tuple[Column, Column]:
    """Statuses of a new account by its own fields: those found before its id is looked up, and those after."""
    c = F.col
    early = first_of((c("reserved") != 0, "reserved_field"), (c("flags").bitwiseAND(~0x3F) != 0, "reserved_flag"), (c("id") == 0, "id_must_not_be_zero"))
    late = first_of(
        (c("flags").bitwiseAND(6) == 6, "flags_are_mutually_exclusive"), *[(c(b) != 0, f"{b}_must_be_zero") for b in BALANCES],
        (c("ledger") == 0, "ledger_must_not_be_zero"), (c("code") == 0, "code_must_not_be_zero"),
    )
    return early, late


def transfer_rules() -> tuple[Column, Column]:
    """The same of an ordinary transfer; what follows is looked up in its accounts."""
    c = F.col
    pending = has(c("flags"), T.PENDING)
    early = first_of((c("flags").bitwiseAND(~0x1FF) != 0, "reserved_flag"), (c("id") == 0, "id_must_not_be_zero"))
    late = first_of(
        (c("debit_account_id") == 0, "debit_account_id_must_not_be_zero"), (c("credit_account_id") == 0, "credit_account_id_must_not_be_zero"),
        (c("debit_account_id") == c("credit_account_id"), "accounts_must_be_different"), (c("pending_id") != 0, "pending_id_must_be_zero"),
        ((c("timeout") != 0) & ~pending, "timeout_reserved_for_pending_transfer"), (has(c("flags"), T.CLOSING_DEBIT | T.CLOSING_CREDIT) & ~pending, "closing_transfer_must_be_pending"),
        (c("ledger") == 0, "ledger_must_not_be_zero"), (c("code") == 0, "code_must_not_be_zero"),
    )
    return early, late


def same_or(names: tuple[str, ...], other: str) -> list[tuple[Column, str]]:
    """exists_with_different_* for each of the fields that isn't the other row's."""
    return [(F.col(n) != F.col(f"{other}.{n}"), f"exists_with_different_{n}") for n in names]


def accept_accounts(accounts: DataFrame) -> DataFrame:
    """The rows with status, and stamped, the time the answer names. The first good row of an id creates the account."""
    early, late = account_rules()
    rows = accounts.withColumn("early_", F.coalesce(first_of((F.col("timestamp") != 0, "timestamp_must_be_zero")), early)).withColumn("late_", late)
    key = F.when(F.col("early_").isNotNull(), -F.col("at")).otherwise(F.col("id"))  # broken rows meet nobody
    names = ("flags", *DATA, "ledger", "code")
    good = F.col("early_").isNull() & F.col("late_").isNull()
    rows = rows.withColumn("key_", key)
    rows = rows.withColumn("won_", F.min(F.when(good, F.struct("at", *names))).over(Window.partitionBy("key_")))
    later = F.col("won_.at") < F.col("at")
    status = F.when(F.col("early_").isNotNull(), F.col("early_")).when(later, F.coalesce(first_of(*same_or(names, "won_")), F.lit("exists"))).otherwise(F.coalesce("late_", F.lit("created")))
    rows = rows.withColumn("status", status)
    return rows.withColumn("stamped", F.when(F.col("status") == "exists", F.col("won_.at")).otherwise(F.col("at"))).drop("early_", "late_", "key_", "won_")


def with_accounts(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """transfers with the status that their accounts give them, where one is missing, not made yet, or of another ledger, and the accounts' flags."""
    side = lambda s: accounts.select(F.col("id").alias(f"{s}_account_id"), F.col("ledger").alias(f"{s}_ledger"), F.col("at").alias(f"{s}_at"), F.col("flags").alias(f"{s}_flags"))
    rows = transfers.join(side("debit"), "debit_account_id", "left").join(side("credit"), "credit_account_id", "left")
    missing = lambda s: F.col(f"{s}_at").isNull() | (F.col(f"{s}_at") >= F.col("at"))
    status = first_of(
        (missing("debit"), "debit_account_not_found"), (missing("credit"), "credit_account_not_found"),
        (F.col("debit_ledger") != F.col("credit_ledger"), "accounts_must_have_the_same_ledger"), (F.col("ledger") != F.col("debit_ledger"), "transfer_must_have_the_same_ledger_as_accounts"),
    )
    return rows.withColumn("accounts_", status).drop("debit_ledger", "debit_at", "credit_ledger", "credit_at")


def accept(transfers: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The rows with status, stamped, kind (a PendingStatus), taken (the amount that counts), and p_*, the pending transfer's fields.

    accounts: those that exist (id, ledger, at, flags); without them every account is taken to be there.
    done_: for created pending transfers, whether a post or void came through. Posts and voids
    that repeat an id have to name the same pending transfer, and no pending_id may be a post's or
    void's own id; the engine sends what doesn't fit to the kernel.
    """
    c = F.col
    flags = c("flags")
    post, void = has(flags, T.POST_PENDING_TRANSFER), has(flags, T.VOID_PENDING_TRANSFER)
    if accounts is not None:
        rows, sides = with_accounts(transfers, accounts), ["debit_flags", "credit_flags"]
    else:
        rows, sides = transfers.withColumn("accounts_", F.lit(None).cast("string")), []
    rows = rows.withColumn("resolves_", post | void)
    resolves = c("resolves_")
    early, late = transfer_rules()
    rows = rows.withColumn("early_", F.coalesce(first_of((c("timestamp") != 0, "timestamp_must_be_zero")), early))
    expiry = first_of((c("timeout") > F.expr(f"({U63_MAX} - at) div {NS}"), "overflows_timeout"))
    rows = rows.withColumn("fresh_", F.when(~resolves & c("early_").isNull(), F.coalesce(late, c("accounts_"), expiry, F.lit("created"))))
    key = F.when(c("early_").isNotNull(), -c("at")).when(resolves & (c("pending_id") != 0), c("pending_id")).otherwise(c("id"))
    rows = rows.withColumn("key_", key)
    by_key = Window.partitionBy("key_")
    blocks = c("fresh_").isin("created", *sorted(TRANSIENT))
    rows = rows.withColumn("first_", F.min(F.when(blocks, F.struct("at", "fresh_", "id", *SHAPE, *sides))).over(by_key))
    p = lambda n: c(f"first_.{n}")
    there = (p("fresh_") == "created") & (p("at") < c("at"))

    # ordinary transfers: the first of an id that is made, or fails for a passing reason, decides
    again = F.when(p("fresh_") == "created", F.coalesce(first_of(*same_or(SHAPE, "first_")), F.lit("exists"))).otherwise("id_already_failed")
    plain = F.when(p("at") < c("at"), again).otherwise(c("fresh_"))

    # posts and voids: what their own fields and the pending transfer say
    full = c("amount") == F.when(post, F.lit(ALL)).otherwise(F.lit(0))
    taken = F.when(resolves & full, p("amount")).otherwise(c("amount"))
    named = ("debit_account_id", "credit_account_id", "ledger", "code")
    early = first_of(
        ((post & void) | has(flags, T.PENDING | T.BALANCING_DEBIT | T.BALANCING_CREDIT | T.CLOSING_DEBIT | T.CLOSING_CREDIT), "flags_are_mutually_exclusive"),
        (c("pending_id") == 0, "pending_id_must_not_be_zero"), (c("pending_id") == c("id"), "pending_id_must_be_different"),
        (c("timeout") != 0, "timeout_reserved_for_pending_transfer"), (~F.coalesce(there, F.lit(False)), "pending_transfer_not_found"),
        (~has(p("flags"), T.PENDING), "pending_transfer_not_pending"),
        *[((c(n) != 0) & (c(n) != p(n)), f"pending_transfer_has_different_{n}") for n in named],
        ((c("taken") > p("amount")) | (c("taken") < 0), "exceeds_pending_transfer_amount"), (void & (c("taken") < p("amount")), "pending_transfer_has_different_amount"),
    )
    rows = rows.withColumn("taken", taken).withColumn("own_", F.when(resolves & c("early_").isNull(), early))
    lost = F.min(F.when(c("own_") == "pending_transfer_not_found", c("at"))).over(Window.partitionBy("key_", "id"))
    rows = rows.withColumn("lost_", F.coalesce(lost < c("at"), F.lit(False)) & resolves)
    expires = F.when(p("timeout") > 0, p("at") + p("timeout") * NS)
    alive = F.coalesce(c("at") < expires, F.lit(True))
    able = resolves & c("early_").isNull() & c("own_").isNull() & ~c("lost_") & alive
    rows = rows.withColumn("won_", F.min(F.when(able, F.struct("at", "id", *SHAPE, "taken"))).over(by_key))
    w = lambda n: c(f"won_.{n}")
    kept = lambda n: F.when(w(n) != 0, w(n)).otherwise(p(n))
    mine = lambda n: F.when(c(n) != 0, c(n)).otherwise(p(n))
    amount = F.when(full, w("taken") == p("amount")).otherwise(c("amount") == w("taken"))
    repeat = first_of(
        (flags != w("flags"), "exists_with_different_flags"), (c("timeout") != 0, "exists_with_different_timeout"),
        *[((c(n) != 0) & (c(n) != p(n)), f"exists_with_different_{n}") for n in named[:2]], (~amount, "exists_with_different_amount"),
        *[(mine(n) != kept(n), f"exists_with_different_{n}") for n in DATA], *[((c(n) != 0) & (c(n) != p(n)), f"exists_with_different_{n}") for n in named[2:]],
    )
    behind = w("at") < c("at")
    resolved = (
        F.when(behind & (w("id") == c("id")), F.coalesce(repeat, F.lit("exists"))).when(c("lost_"), "id_already_failed").when(c("own_").isNotNull(), c("own_"))
        .when(behind, F.when(has(w("flags"), T.POST_PENDING_TRANSFER), "pending_transfer_already_posted").otherwise("pending_transfer_already_voided")).when(~alive, "pending_transfer_expired").otherwise("created")
    )
    rows = rows.withColumn("status", F.when(c("early_").isNotNull(), c("early_")).when(resolves, resolved).otherwise(plain))
    made = c("status") == "created"
    pending = has(flags, T.PENDING)
    out = {
        "stamped": F.when(c("status") == "exists", F.when(resolves, w("at")).otherwise(p("at"))).otherwise(c("at")),
        "kind": F.when(resolves, F.when(post, int(PendingStatus.POSTED)).otherwise(int(PendingStatus.VOIDED))).otherwise(F.when(pending, int(PendingStatus.PENDING)).otherwise(int(PendingStatus.NONE))),
        "p_id": F.when(resolves & there, p("id")), "p_timestamp": F.when(resolves & there, p("at")), "p_expires": F.when(resolves & there, expires), "p_flags": F.when(resolves & there, p("flags")),
        **{f"p_{n}": F.when(resolves & there, p(n)) for n in (*named, "amount", "timeout", *DATA)},
        **{n: F.when(resolves & there, p(n)).otherwise(c(n)) for n in sides},
        "done_": made & pending & ~resolves & w("at").isNotNull(),
    }
    return rows.withColumns(out).drop("early_", "fresh_", "key_", "first_", "own_", "lost_", "won_", "resolves_", "accounts_")
