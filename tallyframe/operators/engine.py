"""Logs of requests on Spark: what hangs on no order runs as a plan, the rest in order, by groups of ledgers that depend on each other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.types import AMOUNT_MAX, EVENT_TYPES, NS, U63_MAX, WIDE, Account, AccountFlags, PendingStatus, Transfer, TransferFlags, to_bytes
from ..plans import fast
from ..plans.accept import BALANCES, accept, accept_accounts
from ..plans.imports import accept_imports
from ..plans.links import around, connected, members, settled
from ..sources.scratch import materialize
from .folding import Fold

A, T = AccountFlags, TransferFlags
NAMES = list(dict.fromkeys([f.name for f in fields(Account)] + [f.name for f in fields(Transfer)]))
OUT = (
    "what string, batch long, idx long, timestamp long, status string, kind int, transfer_key {w}, debit_account_id {w}, credit_account_id {w}, amount {w}, "
    "amount_requested {w}, ledger long, transfer_flags long, dr_flags long, cr_flags long, "
    + ", ".join(f"{s}_{b} {{w}}" for s in ("dr", "cr") for b in BALANCES)
)
RESOLVES = T.POST_PENDING_TRANSFER | T.VOID_PENDING_TRANSFER
#: In logs of more events than this an account's legs are summed up by stretches of time.
MANY, SLICE_NS = 10_000_000, 3600 * NS
#: Times of ticks are cut into so many stretches to find the one that follows a time.
STRETCHES = 1024
#: Logs that make more accounts than this are grouped by accounts that depend on each other instead of by ledgers.
CLOSE = 100_000
#: Groups by accounts have to be found in so many rounds: where accounts form long paths, ledgers are the groups.
ROUNDS = 5
#: After so many, only groups are looked for that run in order.
FIRST = 2
#: A stretch of places in a batch holds some so many events, to find what follows a linked one.
STRETCH = 4096
#: A task of the kernel takes some so many events of a large log, as far as groups allow.
EVENTS = 400_000
#: What is to be released is dealt out so many ways to find its tick.
WAYS = 16


def given(name: str, exact: bool) -> Column:
    """Whether an id is there: zero is none."""
    return F.col(name) != (F.lit(bytearray(16)) if exact else F.lit(0))


def is_a(what: str, flags: int) -> Column:
    return (F.col("what") == what) & (F.col("flags").bitwiseAND(int(flags)) != 0)


def placed(events: DataFrame) -> DataFrame:
    """The log with size (of the batch, if it hasn't any) and at, the time that each event is given."""
    if "size" not in events.columns:
        events = events.withColumn("size", F.count("*").over(Window.partitionBy("batch", "what")))
    return events.withColumn("at", F.when(F.col("what") == "tick", F.col("batch_time")).otherwise(F.col("batch_time") - F.col("size") + F.col("idx") + 1))


def at_home(events: DataFrame, exact: bool) -> DataFrame:
    """The events that aren't ticks with home: their ledger, or that of the pending transfer where a post or void leaves it out, else 0."""
    rows = events.where("what <> 'tick'")
    open_ = (F.col("what") == "transfer") & (F.col("ledger") == 0) & given("pending_id", exact)
    own = rows.where("what = 'transfer' and ledger <> 0").groupBy(F.col("id").alias("pending_id")).agg(F.min("ledger").alias("home"))
    found = rows.where(open_).join(own, "pending_id", "left").withColumn("home", F.coalesce("home", F.lit(0).cast("long")))
    return rows.where(~F.coalesce(open_, F.lit(False))).withColumn("home", F.coalesce("ledger", F.lit(0).cast("long"))).unionByName(found)


def shared(keyed: DataFrame, needed: Column) -> DataFrame:
    """(a, b) for the homes that meet at a key which needed, an aggregate, holds for."""
    met = keyed.groupBy("key").agg(F.min("home").alias("a"), F.max("home").alias("last"), needed.alias("needed")).where("needed and a < last").select("key", "a")
    return keyed.join(met, "key").select("a", F.col("home").alias("b"))


def ties(rows: DataFrame, exact: bool, linked: bool, imports: tuple[int, int] | None) -> DataFrame:
    """Pairs of ledgers (a, b) that depend on each other, by homes.

    They share an account (one that is made in the log; transfers of one ledger may name those of
    another), a transfer's id, a chain, or the order of imported times: those are compared with all
    that was given before, so ledgers with events of such times join those with imports.
    """
    t = rows.where("what = 'transfer'")
    sides = [t.where(given(s, exact)).select(F.col(s).alias("key"), "home", F.lit(False).alias("made")) for s in ("debit_account_id", "credit_account_id")]
    named = rows.where("what = 'account'").select(F.col("id").alias("key"), "home", F.lit(True).alias("made"))
    out = shared(named.unionByName(sides[0]).unionByName(sides[1]), F.max("made"))
    ids = t.select(F.col("id").alias("key"), "home").unionByName(t.where(given("pending_id", exact)).select(F.col("pending_id").alias("key"), "home"))
    out = out.unionByName(shared(ids, F.lit(True)))
    if linked:
        chains = fast.chain_ids(rows, "idx", ("batch", "what")).select(F.struct("batch", "what", "chain").alias("key"), "home")
        out = out.unionByName(shared(chains, F.lit(True)))
    if imports:
        last_batch, first_time = imports
        early = (F.col("batch") <= last_batch) & (F.col("batch_time") >= first_time)
        met = rows.where(is_a("account", A.IMPORTED) | is_a("transfer", T.IMPORTED) | early).select(F.lit(0).alias("key"), "home").distinct()
        out = out.unionByName(shared(met, F.lit(True)))
    return out.where("a <> b").distinct()


def node(kind: int, name: str) -> Column:
    """An account (0) or a transfer (1) among those that may depend on each other. Where hashes meet, groups become one, which changes no result."""
    return F.xxhash64(F.lit(kind), F.col(name))


def at_account(events: DataFrame, exact: bool) -> DataFrame:
    """The events that aren't ticks with home: the node of an account they name, else of the pending transfer, else their own."""
    own = F.when(F.col("what") == "account", node(0, "id"))
    for name, kind in (("debit_account_id", 0), ("credit_account_id", 0), ("pending_id", 1)):
        own = own.when(given(name, exact), node(kind, name))
    return events.where("what <> 'tick'").withColumn("home", own.otherwise(node(1, "id")))


def follows(rows: DataFrame, found: dict) -> DataFrame:
    """(a, b): the homes of linked events and of those after them. Stretches of a batch are looked through apart, then what lies at their ends."""
    wide = max(1, (found["high"] - found["low"]) * STRETCH // max(1, found["n"]))
    stretch = F.expr(f"(idx - {found['low']}) div {wide}").alias("stretch")
    some = rows.select("batch", "what", stretch, "idx", (F.col("flags").bitwiseAND(1) != 0).alias("linked"), F.col("home").alias("a"))
    inside = some.withColumn("b", F.lead("a").over(Window.partitionBy("batch", "what", "stretch").orderBy("idx"))).where("linked and b is not null")
    last = F.max(F.struct("idx", "linked", "a"))
    ends = some.groupBy("batch", "what", "stretch").agg(F.min(F.struct("idx", "a"))["a"].alias("first"), last["linked"].alias("linked"), last["a"].alias("a"))
    across = ends.withColumn("b", F.lead("first").over(Window.partitionBy("batch", "what").orderBy("stretch"))).where("linked and b is not null")
    return inside.select("a", "b").unionByName(across.select("a", "b"))


def close_ties(rows: DataFrame, exact: bool, found: dict, several: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) that depend on each other, by homes of at_account(): as ties(), but for accounts. several: ids that come again."""
    t, a = rows.where("what = 'transfer'"), F.col("home").alias("a")
    out = t.where(given("debit_account_id", exact) & given("credit_account_id", exact)).select(a, node(0, "credit_account_id").alias("b"))
    out = out.unionByName(t.where(given("pending_id", exact)).select(a, node(1, "pending_id").alias("b")))
    out = out.unionByName(t.join(several, "id", "left_semi").select(a, node(1, "id").alias("b")))
    if found["linked"]:
        out = out.unionByName(follows(rows, found))
    if found["imported"]:
        early = (F.col("batch") <= found["last_import"]) & (F.col("batch_time") >= found["first_time"])
        out = out.unionByName(rows.where(is_a("account", A.IMPORTED) | is_a("transfer", T.IMPORTED) | early).select(a, F.lit(0).cast("long").alias("b")))
    return out.where("a <> b").distinct()


def closely(events: DataFrame, exact: bool, found: dict, several: DataFrame, marks: Callable[[DataFrame], DataFrame] | None) -> DataFrame | None:
    """As grouped(), with components of accounts, or None where they are not found in ROUNDS.

    marks gives the homes that have to run in order; without it all have. Of components without
    any, which run as a plan, not all need be found.
    """
    rows = at_account(events, exact)
    links, done = settled(materialize(close_ties(rows, exact, found, several), "ties"), FIRST)
    if not done:
        some = around(links, marks(rows).select(F.col("home").alias("node")), ROUNDS) if marks else None
        links, done = settled(links if some is None else some, ROUNDS)
        if not done:
            return None
    parts = members(links).withColumnRenamed("node", "home")
    return rows.join(parts, "home", "left").withColumn("component", F.coalesce("component", "home")).drop("home")


def next_ticks(rows: DataFrame, ticks: DataFrame) -> DataFrame:
    """The ticks that can release something, for each component: the first at or after a pending transfer runs out."""
    waits = rows.where(is_a("transfer", T.PENDING) & (F.col("timeout") > 0) & (F.col("timeout") <= F.expr(f"({U63_MAX} - at) div {NS}"))).withColumn("t", F.col("at") + F.col("timeout") * NS)
    found = ticks_after(waits.select("t", "component"), ticks).select("component", F.col("tick").alias("batch_time")).distinct()
    return ticks.join(found, "batch_time")


def ticks_after(waits: DataFrame, ticks: DataFrame) -> DataFrame:
    """The rows of waits with tick, the first time of a tick at or after t; those without any are left out."""
    low, high = ticks.agg(F.min("batch_time"), F.max("batch_time")).first()
    wide = (high - low) // STRETCHES + 1
    stretch = lambda t: F.greatest(F.lit(0).cast("long"), F.expr(f"({t} - {low}) div {wide}"))
    known = ticks.select(stretch("batch_time").alias("k"), F.col("batch_time").alias("t"), F.col("batch_time").alias("tick"), F.lit(False).alias("waits"))
    dealt = known.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    both = waits.where(F.col("t") <= high).withColumns({"k": stretch("t"), "tick": F.lit(None).cast("long"), "waits": F.lit(True), "way": F.pmod(F.xxhash64(*waits.columns), F.lit(WAYS)).cast("int")}).unionByName(dealt, allowMissingColumns=True)
    found = both.withColumn("tick", F.last("tick", True).over(Window.partitionBy("k", "way").orderBy(F.desc("t"), F.col("tick").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))).where("waits")
    # STRETCHES rows at most: the first tick of each stretch, for those before it
    firsts = known.groupBy("k").agg(F.min("t").alias("first"))
    every = ticks.sparkSession.range(STRETCHES + 1).select(F.col("id").alias("k")).join(firsts, "k", "left")
    after = every.withColumn("after", F.min("first").over(Window.orderBy("k").rowsBetween(1, Window.unboundedFollowing))).select("k", "after")
    return found.join(F.broadcast(after), "k").withColumn("tick", F.coalesce("tick", "after")).select(*waits.columns, "tick")


def survey(events: DataFrame) -> dict:
    """What a log holds, in one pass. names: the fields that aren't zero or null everywhere."""
    imported = is_a("account", A.IMPORTED) | is_a("transfer", T.IMPORTED)
    moves = (F.col("what") == "transfer") & ~is_a("transfer", RESOLVES)
    narrow = dict(events.dtypes)["amount"] == "bigint"
    some = lambda test: F.coalesce(F.max(test), F.lit(False))
    whole = [n for n, kind in events.dtypes if n in NAMES and kind == "bigint"]
    found = events.agg(
        *[F.bit_or(n).alias(f"any_{n}") for n in whole],
        F.count("*").alias("n"), F.count(F.when(F.col("what") == "account", 1)).alias("accounts"), F.coalesce(F.min("idx"), F.lit(0)).alias("low"), F.coalesce(F.max("idx"), F.lit(0)).alias("high"), some(F.col("what") == "tick").alias("ticks"), some(F.col("flags").bitwiseAND(1) != 0).alias("linked"), some(imported).alias("imported"),
        F.max(F.when(imported, F.col("batch"))).alias("last_import"), *[F.max(F.when(is_a(k, f), F.col("batch"))).alias(f"last_{k}_import") for k, f in (("account", A.IMPORTED), ("transfer", T.IMPORTED))],
        F.min(F.when(imported, F.col("timestamp"))).alias("first_time"),
        F.min(F.expr("nullif(ledger, 0)")).alias("least"), F.max("ledger").alias("most"), some(is_a("transfer", RESOLVES)).alias("resolves"), some(F.col("timeout") > 0).alias("timeouts"),
        some(in_order(False)).alias("ordered"), some(in_order(False, False)).alias("ordered_but_imports"), F.min(F.when(F.col("what") == "transfer", F.col("batch"))).alias("first_transfer"), F.count(F.when(F.col("what") == "transfer", 1)).alias("transfers"), (some(moves & (F.col("amount") < 0)) if narrow else F.lit(True)).alias("all_there_is"),
        F.sum(F.when(moves, F.col("amount").cast("decimal(38,0)"))).alias("moved") if narrow else F.lit(0).alias("moved"),
    ).first().asDict()
    return found | {"names": [n for n in NAMES if n not in whole or found[f"any_{n}"]]}


def in_order(ticks: bool, imports: bool = True) -> Column:
    """Whether an event's outcome can hang on a balance, or on what came before it other than its accounts and its id. imports: or on the times before it."""
    limits = A.DEBITS_MUST_NOT_EXCEED_CREDITS | A.CREDITS_MUST_NOT_EXCEED_DEBITS
    test = is_a("account", A.LINKED | A.CLOSED | (A.IMPORTED if imports else 0)) | is_a("account", limits) & (F.col("flags").bitwiseAND(int(limits)) != int(limits))  # both at once are refused
    test |= is_a("transfer", T.LINKED | T.BALANCING_DEBIT | T.BALANCING_CREDIT | T.CLOSING_DEBIT | T.CLOSING_CREDIT | (T.IMPORTED if imports else 0))
    return F.coalesce(test | (F.col("timeout") > 0) if ticks else test, F.lit(False))


def tangled(transfers: DataFrame) -> DataFrame:
    """Ids whose posts and voids the plan can't tell apart: shared with other transfers, with other pending ids, or named as pending ones."""
    resolves = is_a("transfer", RESOLVES)
    own = transfers.select(F.col("id").alias("key"), resolves.alias("r"), F.col("pending_id").alias("p"), F.lit(False).alias("named"))
    named = transfers.where(resolves).select(F.col("pending_id").alias("key"), F.lit(None).cast("boolean").alias("r"), F.lit(None).cast("long").alias("p"), F.lit(True).alias("named"))
    keys = own.unionByName(named).groupBy("key").agg(F.max("r").alias("r"), F.min("r").alias("all_r"), F.min("p").alias("p0"), F.max("p").alias("p1"), F.max("named").alias("named"))
    return keys.where("r and (named or not all_r or p0 <> p1)").select("key")


def grouped(events: DataFrame, exact: bool, found: dict) -> DataFrame:
    """The log, ticks left out, with component: events of different ones have nothing to do with each other."""
    if found["least"] is None or found["least"] == found["most"]:
        return events.where("what <> 'tick'").withColumn("component", F.lit(0).cast("long"))
    rows = at_home(events, exact)
    imports = (found["last_import"], found["first_time"]) if found["imported"] else None
    links = materialize(ties(rows, exact, found["linked"], imports), "ties")
    if links.isEmpty():
        return rows.withColumnRenamed("home", "component")
    parts = connected(links).withColumnRenamed("node", "home")
    return rows.join(parts, "home", "left").withColumn("component", F.coalesce("component", "home")).drop("home")


def fold(events: DataFrame, exact: bool = False, by: str | None = None, only: str | None = None) -> DataFrame:
    """Results and account events of a log of requests, oldest first, all of it in order.

    events: what ('account', 'transfer' or 'tick'), batch (also its order, and that of batch_time), idx, batch_time, and the
    fields of both records, null where they don't apply. In the compact profile an amount of -1
    stands for all there is; in the exact one wide numbers are 16 bytes. Returned: a row for each
    event with what = 'result', and one for each transfer made or expired with what = 'event'. Ledgers
    that depend on each other run in one group, however many there are. Output doesn't depend on how rows are partitioned.
    by: a column of small groups that the caller knows to have nothing to do with each other: no account, id or chain in common, nor imports;
    they aren't looked for then, and all transfers of a group are held. only: 'result' or 'event', if the other rows aren't wanted.
    """
    found = survey(events)
    events = placed(events)
    if by is not None:
        if found["imported"]:
            raise ValueError("imported times are compared over all groups")
        return run_groups(events.where("what <> 'tick'").withColumn("component", F.col(by)), events, found, None, only)
    several, rows = named_again(events, exact), None
    if found["accounts"] > CLOSE:
        events = materialize(events, "log")
        several = materialize(named_again(events, exact), "again")
        rows = closely(events, exact, found, several, None)
    return run_groups(grouped(events, exact, found) if rows is None else rows, events, found, several, only)


def named_again(events: DataFrame, exact: bool) -> DataFrame:
    """(id, again) of the ids that are given to several of the log's transfers, or named as pending. Only such transfers are looked up once more."""
    t = events.where("what = 'transfer'")
    names = t.select("id").unionByName(t.where(given("pending_id", exact)).select(F.col("pending_id").alias("id")))
    return names.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again"))


def run_groups(rows: DataFrame, events: DataFrame, found: dict, several: DataFrame | None, only: str | None = None) -> DataFrame:
    """The kernel over each component of rows, some of events, with the ticks that matter to it. The events of a component come sorted, and are not gathered. several: see named_again(); without it all transfers are held until their component ends. only: see fold()."""
    exact = dict(events.dtypes)["id"] == "binary"
    rows = rows.withColumn("again", F.lit(True)) if several is None else rows.join(several, "id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    if found["imported"]:  # as the first event of each batch says
        flag = F.when(F.col("what") == "account", int(A.IMPORTED)).otherwise(int(T.IMPORTED))
        firsts = events.where("what <> 'tick'").groupBy("batch", "what").agg(F.min(F.struct("idx", "flags"))["flags"].alias("first"))
        rows = rows.join(firsts.select("batch", "what", (F.col("first").bitwiseAND(flag) != 0).alias("imports")), ["batch", "what"], "left")
    else:
        rows = rows.withColumn("imports", F.lit(False))
    ticks = events.where("what = 'tick'") if found["ticks"] else None
    if ticks is not None:
        rows = rows.unionByName(next_ticks(rows, ticks).withColumns({"imports": F.lit(False), "again": F.lit(False)}), allowMissingColumns=True)
    shape = OUT.format(w="binary" if exact else "long") + ", due long, made long"
    last = found["last_account_import"], found["last_transfer_import"]
    tasks = found["n"] // EVENTS
    dealt = rows.select("component", "batch", "idx", "what", "size", "batch_time", "imports", "again", *found["names"])
    dealt = dealt.repartition(tasks, "component") if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else dealt.repartition("component")
    sorted_ = dealt.sortWithinPartitions("component", "batch", "idx", "what")
    out = sorted_.mapInArrow(lambda batches: Fold(shape, exact, last, only)(batches), shape)
    return (out if ticks is None else released(out, ticks)).drop("due", "made")


def released(out: DataFrame, ticks: DataFrame) -> DataFrame:
    """The rows with the times of a tick's expiries given out over all components: in order of expiry and then creation, up to the tick's own."""
    out = materialize(out, "released")  # read twice
    gone = F.coalesce(F.col("kind") == int(PendingStatus.EXPIRED), F.lit(False))
    tick = Window.partitionBy("batch")
    rank = F.row_number().over(tick.orderBy("due", "made")) - 1
    held = F.count("*").over(tick)
    times = ticks.select("batch", "batch_time").distinct()
    late = out.where(gone).join(times, "batch").withColumn("rank_", rank).withColumn("timestamp", F.col("batch_time") - held + F.col("rank_") + 1)
    known = {"what": F.lit("event"), "idx": F.lit(None).cast("long"), "status": F.lit(None).cast("string")}  # so that they fall out of the plan where results are asked for
    return out.where(~gone).unionByName(late.withColumns(known).select(*out.columns))


def plan(events: DataFrame, slice_ns: int | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """What fold() gives for a log in which nothing hangs on order, as a plan. slice_ns: see fast.running(). ticks: those that release what ran out."""
    accounts = accept_accounts(events.where("what = 'account'"))
    made = accounts.where("status = 'created'").select("id", "ledger", "at", "flags")
    moved = accept(events.where("what = 'transfer'"), made)
    if ticks is None:
        return answers(accounts, moved, slice_ns)
    moved = materialize(moved, "moved")  # read twice
    return answers(accounts, moved, slice_ns, pulsed(fast.expiries(fast.as_kept(moved)), ticks))


def pulsed(gone: DataFrame, ticks: DataFrame) -> DataFrame:
    """The rows of fast.expiries() that a tick releases, due at its time and in its batch, with seq, from the first (the lowest) to -1."""
    named = ticks.groupBy("batch_time").agg(F.min("batch").alias("batch"))
    found = ticks_after(gone.withColumnRenamed("due", "t"), ticks).drop("batch", "batch_time").join(named, F.col("tick") == F.col("batch_time"))
    tick = Window.partitionBy("tick")
    seq = F.row_number().over(tick.orderBy("t", "timestamp", "id")) - F.count("*").over(tick) - 1
    return found.withColumns({"seq": seq, "due": F.col("tick"), "amount_requested": F.lit(0).cast("long")})


def answers(accounts: DataFrame, moved: DataFrame, slice_ns: int | None, gone: DataFrame | None = None) -> DataFrame:
    """Results and account events out of accounts and transfers with their statuses. gone: see pulsed()."""
    answer = lambda rows: rows.select(F.lit("result").alias("what"), "batch", "idx", F.col("stamped").alias("timestamp"), "status")
    log = fast.event_log(fast.as_kept(moved), gone, slice_ns=slice_ns).withColumns({"what": F.lit("event"), "idx": F.lit(None).cast("long"), "status": F.lit(None).cast("string")})
    both = answer(accounts).unionByName(answer(moved)).unionByName(log, allowMissingColumns=True)
    return both.select(*[F.col(n).cast(t) for n, t in (c.split() for c in OUT.format(w="long").split(", "))])


def execute(events: DataFrame, exact: bool = False) -> DataFrame:
    """fold(), but as a plan where that gives the same: in a log, or in groups of its ledgers, without chains, limits, balancing, closing, imports, and, where any of that is there, timeouts that ticks release."""
    found = survey(events)
    events = placed(events)
    hard = exact or found["all_there_is"] or (found["moved"] or 0) >= 2**62
    waits = found["ticks"] and found["timeouts"]
    slices = SLICE_NS if found["n"] > MANY else None
    if not hard:
        knots = materialize(tangled(events.where("what = 'transfer'")), "tangled") if found["resolves"] else None
        if knots is not None and knots.isEmpty():
            knots = None
        if not found["ordered"] and knots is None:  # whether a tick has come or not, what ran out is found expired
            return plan(events, slices, events.where("what = 'tick'") if waits else None)
    events = materialize(events, "log")  # read several times from here on

    def marks(rows: DataFrame, key: str = "home") -> DataFrame:
        out = rows.where(in_order(waits)).select(key)
        if knots is not None:
            t = rows.where("what = 'transfer'")
            out = out.unionByName(t.join(knots, t["id"] == knots["key"], "left_semi").select(key)).unionByName(t.join(knots, t["pending_id"] == knots["key"], "left_semi").select(key))
        return out.distinct()

    several, rows = named_again(events, exact), None
    before = found["last_account_import"] is None or found["first_transfer"] is None or found["last_account_import"] < found["first_transfer"]
    if found["imported"] and before and not (hard or waits or found["resolves"] or found["ordered_but_imports"]):
        several = materialize(several, "again")
        if several.isEmpty() and events.where("what = 'account'").groupBy("id").count().where("count > 1").isEmpty():
            return answers(*accept_imports(events.where("what <> 'tick'"), (found["accounts"], found["transfers"])), slices)
    if found["accounts"] > CLOSE:
        several = materialize(several, "again")
        rows = closely(events, exact, found, several, None if hard else marks)
    rows = grouped(events, exact, found) if rows is None else rows
    if hard:
        return run_groups(rows, events, found, several)
    marked = materialize(marks(rows, "component"), "ordered")
    rest = rows.join(marked, "component", "left_anti")
    if rest.isEmpty():
        return run_groups(rows, events, found, several)
    return run_groups(rows.join(marked, "component", "left_semi"), events, found, several).unionByName(plan(rest, slices))


def requests(spark, batches: list[tuple[str, int, list]], exact: bool = False) -> DataFrame:
    """A log for fold() out of (what, time, records); a tick has no records. For requests a client holds, so of its size."""
    kinds = {"account": Account, "transfer": Transfer, "tick": None}
    narrow = lambda n, v: -1 if n == "amount" and v == AMOUNT_MAX else v
    cell = lambda n, v: v if v is None else to_bytes(v) if exact and n in WIDE else v if exact else narrow(n, v)
    rows = []
    for n, (what, time, records) in enumerate(batches):
        for i, r in enumerate(records or [None]):
            known = vars(r) if r is not None and isinstance(r, kinds[what]) else {}
            rows.append((what, n, i, len(records), time, *[cell(f, None if not (f in known) else int(known[f])) for f in NAMES]))
    shape = ", ".join(f"{f} {'binary' if exact and f in WIDE else 'long'}" for f in NAMES)
    return spark.createDataFrame(rows, f"what string, batch long, idx long, size long, batch_time long, {shape}")


def observed(out: DataFrame, name: str = "requests") -> tuple[DataFrame, Observation]:
    """The rows of execute(), and an observation that holds, once they have been computed, how many events came, failed and moved balances, by kind."""
    seen = Observation(name)
    result, event = F.col("what") == "result", F.col("what") == "event"
    counted = lambda test, n: F.count(F.when(test, 1)).alias(n)
    kinds = [counted(event & (F.col("kind") == i), n) for i, n in enumerate(EVENT_TYPES)]
    return out.observe(seen, counted(result, "events"), counted(result & (F.col("status") == "created"), "created"), counted(result & (F.col("status") != "created"), "failed"), *kinds), seen
