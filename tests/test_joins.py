"""Lookup joins give the same rows on every route."""

import pytest
from pyspark.sql import functions as F

from isoreach.operators import joins
from isoreach.operators.ordering import exact_quantiles, global_row_number


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, a sixth have none."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 6 == 1, None).otherwise(F.col("id") % 500)
    return spark.range(6000).select("id", key.cast("long").alias("k"), (F.col("id") % 4).alias("j"))


@pytest.fixture(scope="module")
def lookup(spark):
    one = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    twice = spark.range(5, 9).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v"))
    return one.unionByName(twice)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_routes_agree(skewed, lookup, how):
    plain = skewed.join(lookup, "k", how)
    for limit in (joins.BROADCAST_BYTES, 6000, 0):
        got = joins.lookup_join(skewed, lookup, "k", how, limit=limit, sample=1.0)
        assert got.columns == plain.columns
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_two_keys(spark, skewed):
    lookup = spark.range(800).select((F.col("id") % 200).alias("k"), (F.col("id") % 4).alias("j"), F.col("id").alias("v"))
    plain = skewed.join(lookup, ["k", "j"], "left")
    got = joins.lookup_join(skewed, lookup, ["k", "j"], "left", limit=0, sample=1.0)
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_hot_key_is_found_and_not_shuffled(skewed, lookup):
    hot = [r["k"] for r in joins.hot_keys(skewed, ["k"], 1.0).collect()]
    assert 7 in hot and len(hot) <= 1 / joins.HOT_SHARE
    plan = joins.lookup_join(skewed, lookup, "k", "left", limit=6000, sample=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan


def test_lookup_that_would_fill_a_driver_is_not_broadcast(spark):
    lookup = spark.range(700_000).select(F.col("id").alias("k"), *[(F.col("id") * i).alias(f"v{i}") for i in (1, 2, 3)])
    plan = joins.lookup_join(spark.range(10).withColumnRenamed("id", "k"), lookup, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_beyond_the_limit_is_shuffled_however_small_its_source_looks(spark, how):
    few = spark.range(40).withColumnRenamed("id", "k")
    lookup = few.select("k", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("v"))
    got = joins.lookup_join(few, lookup, "k", how, limit=1000, sample=1.0)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    plain = few.join(lookup, "k", how)
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_tasks_of_a_shuffled_lookup_follow_the_rows(spark, skewed, lookup, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    for how in ("left", "inner", "left_semi", "left_anti"):
        got, plain = joins.lookup_join(skewed, lookup, "k", how, limit=0, sample=1.0), skewed.join(lookup, "k", how)
        # 5,000 rows have a key.
        assert "hashpartitioning(k" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 100)" in plan
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_a_large_side_is_sampled_in_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    big = spark.range(3000).select((F.col("id") % 100).alias("k")).mapInArrow(read, "k long")
    joins.hot_keys(big, ["k"], 1.0)
    assert seen.value == 3000


def test_measured_size(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2)], "t string, n int")
    assert joins.measured_bytes(df) == 2 * 16 + 3


def test_global_row_number(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("v"))
    ranked = global_row_number(df, [F.desc("v"), F.asc("id")], "r", slices=7)
    expected = sorted(((-(i % 10), i) for i in range(1000)))
    got = {r["id"]: r["r"] for r in ranked.collect()}
    assert all(got[i] == n for n, (_, i) in enumerate(expected, start=1))


def test_quantiles_over_slices(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 97).alias("v"))
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}, slices=13).collect()}
    expected = df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("p")).collect()
    for r in expected:
        assert [got[r["k"]][c] for c in "abc"] == pytest.approx(r["p"])


def test_quantiles_without_keys_and_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 5.0)], "k string, v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0
    assert {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()} == {None: 1.5, "x": 5.0}
