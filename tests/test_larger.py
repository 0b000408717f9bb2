"""Queries on tables that hold more than a request, and times that repeat."""

from tallyframe import queries
from tallyframe.operators import reads


def test_q11_gives_more_than_a_request_holds(spark, tmp_path):
    spark.range(9000).selectExpr("id * 4 + 1 as c_custkey", "5 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(6).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    assert queries.QUERIES["q11_query_accounts_multi"](spark, str(tmp_path)).count() == 9000


def test_former_events_of_one_time_meet_their_own_transfers(spark):
    sides = spark.createDataFrame([(5, 1, 1, 2), (5, 2, 3, 4)], "timestamp long, transfer_key long, debit_account_id long, credit_account_id long")
    t = spark.createDataFrame([(5, 1, 2), (5, 2, 0)], "timestamp long, id long, flags long")
    found = reads.former_events(sides, t).select("transfer_key", "debit_account_id", "kind")
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1), (2, 3, 0)]


def test_paged_gives_the_pages(spark):
    df = spark.range(1, 1001).selectExpr("id", "id * 7 as timestamp", "id % 3 as user_data_32")
    for flags in (0, 1):
        f = reads.QueryFilter(user_data_32=1, flags=flags)
        want = sorted((r.id, i) for i, p in enumerate(reads.pages(df, f, 100)) for r in p.collect())
        assert sorted((r.id, r.page) for r in reads.paged(df, f, 100).collect()) == want and len(want) == 334
    assert reads.paged(df, reads.QueryFilter(limit=0), 100).count() == 0
