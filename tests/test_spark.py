"""Reads, plans, the kernel on Spark, storage and streams."""

import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyframe.functions.numbers import digits, json_number
from tallyframe.functions.types import AMOUNT_MAX, Account, Transfer, TransferFlags, to_bytes
from tallyframe.operators import engine, reads
from tallyframe.operators.kernel import State
from tallyframe.operators.reads import AccountFilter, QueryFilter
from tallyframe.plans import fast
from tallyframe.sources import mapping
from tallyframe.sources.statement import StatementError, number, parse
from tallyframe.sources.storage import Store, disagreements, faults, merged
from tallyframe.streaming import cdc
from tallyframe.streaming.ledger import answers

D = "/root/testdata/sf0.001"


def attributes(spark):
    rows = [(1000, 10, 1, 1, 1), (1000, 11, 2, 2, 2), (1000, 10, 3, 3, 3), (1000, 11, 4, 4, 4), (2000, 10, 1, 3, 5), (2000, 11, 2, 2, 6), (2000, 10, 3, 1, 7), (1000, 10, 1, 1, 1)]
    return spark.createDataFrame([(i + 1, *r, i + 1) for i, r in enumerate(rows)], "id long, user_data_128 long, user_data_64 long, user_data_32 long, ledger long, code long, timestamp long")


@pytest.mark.parametrize(
    ("f", "ids"),
    [
        (QueryFilter(user_data_128=1000), [1, 2, 3, 4, 8]), (QueryFilter(user_data_128=1000, flags=1), [8, 4, 3, 2, 1]), (QueryFilter(user_data_64=10, user_data_32=3), [3, 7]),
        (QueryFilter(user_data_64=11, user_data_32=2, ledger=2), [2, 6]), (QueryFilter(1000, 10, 1, 1, 1), [1, 8]), (QueryFilter(user_data_128=1000, timestamp_min=3), [3, 4, 8]),
        (QueryFilter(timestamp_min=2, timestamp_max=4), [2, 3, 4]), (QueryFilter(), list(range(1, 9))), (QueryFilter(limit=0), []), (QueryFilter(timestamp_max=2**63), []), (QueryFilter(flags=2), []),
    ],
)
def test_queries_f16(spark, f, ids):
    assert [r.id for r in reads.scan(attributes(spark), f).collect()] == ids


def test_pages_meet_every_row_once(spark):
    for flags in (0, 1):
        got = [r.id for p in reads.pages(attributes(spark), QueryFilter(flags=flags), 3) for r in p.collect()]
        assert sorted(got) == list(range(1, 9)) and got == sorted(got, reverse=bool(flags))


def test_lookup_keeps_order_and_repeats(spark):
    assert [r.id for r in reads.lookup(attributes(spark), [5, 99, 2, 5]).collect()] == [5, 2, 5]
    assert reads.lookup(attributes(spark), []).count() == 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_two_phase_plan_equals_kernel(spark):
    t = mapping.two_phase_transfers(spark, D)
    plan = {r.id: r.status for r in fast.two_phase(t).select("id", "status").collect()}
    s, clock = State(), 0
    users = mapping.event_accounts(spark, D).collect()
    s.create_accounts([Account(id=r.id, ledger=r.ledger, code=1) for r in users], 1000)
    for r in t.orderBy("timestamp").collect():
        values = r.asDict() | {"timestamp": 0}
        if values["amount"] == -1:
            values["amount"] = AMOUNT_MAX
        (_, status), *_ = s.create_transfers([Transfer(**values)], r.timestamp)
        assert plan[r.id] == status, r
        clock = r.timestamp
    assert clock and s.integrity() == []


def test_fold_is_the_same_for_any_partitions(spark):
    accounts = [Account(id=i, ledger=1 + i % 2, code=1) for i in range(1, 9)]
    moves = [Transfer(id=i, debit_account_id=1 + i % 8, credit_account_id=1 + (i + 2) % 8, amount=i, ledger=1 + (1 + i % 8) % 2, code=1, flags=int(TransferFlags.LINKED) if i % 5 == 0 else 0) for i in range(1, 40)]
    log = engine.requests(spark, [("account", 10**6, accounts), ("transfer", 10**7, moves), ("tick", 10**8, [])])
    outs = [sorted(map(tuple, engine.fold(log.repartition(n)).where("what = 'result'").select("batch", "idx", "timestamp", "status").collect())) for n in (1, 7)]
    s = State()
    want = [(0, i, *r) for i, r in enumerate(s.create_accounts(accounts, 10**6))] + [(1, i, *r) for i, r in enumerate(s.create_transfers(moves, 10**7))]
    assert outs[0] == outs[1] == sorted(want)


def test_store_publishes_whole_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    t = mapping.event_transfers(spark, D)
    assert store.publish({"transfers": t}) == 1
    t.limit(5).write.parquet(f"{store.root}/v=2/transfers")  # a writer that died before its marker
    assert store.current() == 1 and store.read("transfers").count() == t.count()
    assert store.publish({"transfers": t.limit(3)}) == 2 and store.inspect().first()["rows"] == 3
    store.log(engine.requests(spark, [("account", 1000, [Account(id=1, ledger=1, code=1)])]))
    assert store.replay().first()["status"] == "created"


def test_log_faults_and_merge(spark):
    log = engine.requests(spark, [("account", 1000, [Account(id=i, ledger=1, code=1) for i in (1, 2)]), ("transfer", 2000, [Transfer(id=i) for i in range(1, 6)]), ("tick", 3000, []), ("transfer", 4000, [Transfer(id=9)])])
    assert faults(log).count() == 0
    gap, late, twice = log.where("not (batch = 1 and idx = 3)"), log.withColumn("batch_time", F.expr("if(batch = 3, 2500, batch_time)")), log.unionByName(log.where("batch = 0 and idx = 1"))
    got = [[tuple(r) for r in faults(x).collect()] for x in (gap, late, twice)]
    assert got == [[(1, "events are missing or repeated")], [(3, "time does not grow")], [(0, "events are missing or repeated")]]
    copies = log.where("batch <> 0 and not (batch = 1 and idx > 2)"), log.where("batch <> 3"), log
    assert sorted(map(tuple, merged(*copies).collect()), key=str) == sorted(map(tuple, log.select(*merged(*copies).columns).collect()), key=str)
    other = log.withColumn("code", F.expr("if(batch = 1 and idx = 2, 7, code)"))
    assert disagreements(*copies).count() == 0 and [r.batch for r in disagreements(log, other).collect()] == [1]


def test_wide_numbers_have_their_digits(spark):
    rnd = random.Random(1)
    values = [0, 1, 2**53 - 1, 2**53, 10**19 - 1, 10**19, 2**64 - 1, 2**64, 2**127, 2**128 - 1, *[rnd.getrandbits(rnd.randint(1, 128)) for _ in range(300)]]
    frame = spark.createDataFrame([(i, bytearray(to_bytes(v))) for i, v in enumerate(values)], "i int, v binary")
    got = frame.select(digits(frame, "v").alias("d"), json_number(frame, "v").alias("j")).collect()
    assert [r.d for r in got] == list(map(str, values)) and [r.j for r in got] == [str(v) if v < 2**53 else f'"{v}"' for v in values]


def test_change_stream_resumes(spark, tmp_path):
    t, a = mapping.event_transfers(spark, D), mapping.event_accounts(spark, D)
    log = fast.event_log(t.withColumn("status", F.lit("created")))
    schema, seen = log.schema, []
    log.where("debit_account_id % 2 = 0").write.parquet(f"{tmp_path}/log")
    publish = lambda df, i: seen.extend(r.timestamp for r in df.select("timestamp").collect())
    for _ in range(2):
        cdc.follow(spark, f"{tmp_path}/log", schema, publish, f"{tmp_path}/state", lambda: t, lambda: a).awaitTermination()
        log.where("debit_account_id % 2 = 1").write.mode("append").parquet(f"{tmp_path}/log")
        time.sleep(0.1)
    assert sorted(set(seen)) == sorted(r.timestamp for r in log.select("timestamp").collect())


def test_request_stream_keeps_state(spark, tmp_path):
    moved = [Transfer(id=1, debit_account_id=1, credit_account_id=2, amount=3, ledger=1, code=1), Transfer(id=1), Transfer(id=2, debit_account_id=1, credit_account_id=2, amount=5, ledger=1, code=1, flags=2, timeout=1)]
    log = [("account", 1000, [Account(id=i, ledger=1, code=1) for i in (1, 2)]), ("transfer", 2000, moved), ("tick", 10**10, []), ("transfer", 2 * 10**10, [Transfer(id=3, pending_id=2, amount=AMOUNT_MAX, flags=4), Transfer(id=1)])]
    whole = engine.requests(spark, log).withColumn("component", F.lit(0))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for some in ("batch < 1", "batch = 1", "batch > 1"):
            whole.where(some).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            q = answers(spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in")).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{tmp_path}/out")
    got = sorted((r.batch, r.idx, r.timestamp, r.status) for r in out.where("what = 'result'").collect())
    s = State()
    want = [(0, i, *r) for i, r in enumerate(s.create_accounts(log[0][2], 1000))] + [(1, i, *r) for i, r in enumerate(s.create_transfers(moved, 2000))]
    s.pulse(10**10)
    want += [(3, i, *r) for i, r in enumerate(s.create_transfers(log[3][2], 2 * 10**10))]
    assert got == want
    assert sorted((r.timestamp, r.kind, r.transfer_key, r.dr_debits_pending) for r in out.where("what = 'event'").collect()) == [(e.timestamp, int(e.status), str((e.transfer or e.pending).id), str(e.debit.debits_pending)) for e in s.events]


def test_statements():
    (s,) = parse("create_accounts id=1 code=10 ledger=700 flags=linked|history, id=-0 code=0x1F;")
    assert s.operation == "create_accounts" and s.arguments[0] == Account(id=1, code=10, ledger=700, flags=9) and s.arguments[1].id == 2**128 - 1 and s.arguments[1].code == 31
    assert parse("get_account_transfers account_id=3 flags=debits|reversed limit=5")[0].arguments == [AccountFilter(3, limit=5, flags=5)]
    assert parse("lookup_accounts id=1, id=2; query_transfers ledger = 2")[0].arguments == [1, 2]
    assert number("-1", 16) == 65534
    for bad in ("drop x=1", "create_accounts id=", "create_accounts nope=1", "lookup_accounts id=9999999999999999999999999999999999999999999", "query_accounts flags=debits"):
        with pytest.raises(StatementError):
            parse(bad)
