"""Recipes for many rows: groups that are known, one run of the kernel, and no more columns than hold something."""

import duckdb
import pytest
from pyspark.sql import functions as F

from test_close import pairs
from test_engine import in_one_state, on_spark, random_log
from test_folding import SHAPE, answered, rows_of
from tallyframe import queries
from tallyframe.operators import engine
from tallyframe.operators.folding import Fold

RECIPES = ["q53_recipe_currency_exchange", "q55_recipe_gather_by_balancing", "q56_recipe_close_account", "q59_recipe_up_to_a_limit", "q60_recipe_correcting_transfers"]


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("customers"))
    spark.range(0, 1500, 7).selectExpr("id as c_custkey").write.parquet(f"{path}/customer.parquet")
    return path


@pytest.mark.parametrize("name", RECIPES)
def test_recipes_know_their_groups(spark, monkeypatch, customers, name):
    def written(df, what, keep=False):
        raise AssertionError(f"{what} is written on the way")

    monkeypatch.setattr(engine, "CLOSE", 10)
    monkeypatch.setattr(engine, "EVENTS", 500)
    monkeypatch.setattr(engine, "materialize", written)
    got = queries.QUERIES[name](spark, customers)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS FROM '{customers}/customer.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_known_groups_equal_one_state(spark):
    log = pairs(20)
    want = in_one_state(log)
    pair = F.when(F.col("what") == "account", F.expr("(id - 1) div 2")).otherwise(F.expr("(least(debit_account_id, credit_account_id) - 1) div 2"))
    frame = engine.requests(spark, log).withColumn("pair", pair)
    assert on_spark(engine.fold(frame, by="pair")) == want
    assert on_spark(engine.fold(frame, by="pair", only="result")) == (want[0], [])
    with pytest.raises(ValueError):
        engine.fold(frame.withColumn("flags", F.lit(int(engine.T.IMPORTED)).cast("long")), by="pair")


def test_fields_without_values_stay_out(spark):
    assert engine.survey(engine.requests(spark, pairs(3)))["names"] == ["id", "ledger", "code", "flags", "debit_account_id", "credit_account_id", "amount"]
    log = random_log(11, True)
    rows = rows_of(log)
    some = [n for n in rows[0] if n not in engine.NAMES or any(r[n] for r in rows)]
    assert len(some) < len(rows[0])
    results, events = in_one_state(log)
    for only, want in ((None, (results, events)), ("result", (results, [])), ("event", ([], events))):
        assert answered([{n: r[n] for n in some} for r in rows], 7, Fold(SHAPE, False, (10**9, 10**9), only)) == want
