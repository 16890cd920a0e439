"""Scalable operators against their plain forms on awkward data."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetgauge.operators.asof import asof_join
from fleetgauge.operators import ordered
from fleetgauge.operators.ordered import average_ranks, previous_row, quantiles, quantiles_of, running_totals
from fleetgauge.operators.ranges import Slots
from fleetgauge.operators.pairs import blocked_pairs, pair_support


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def numbers(spark):
    """Half the rows share one value; the rest spread over signs and magnitudes."""
    rng = random.Random(3)
    data = [("a", 0.5)] * 500
    data += [("a", rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9)) for _ in range(300)]
    data += [("b", float(rng.randint(-5, 5))) for _ in range(200)] + [("b", 0.0), ("b", -0.0)]
    data += [("b", 1 + i * 2.0**-50) for i in range(40)]
    return data, spark.createDataFrame(data, "g string, v double").cache()


def test_quantiles_equal_numpy(numbers):
    data, df = numbers
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    for r in quantiles(df, "v", qs, by=["g"]).collect():
        expected = np.quantile([v for g, v in data if g == r.g], r.q)
        assert r.value == pytest.approx(expected, rel=1e-12, abs=1e-15)
    whole = {r.q: r.value for r in quantiles(df, "v", qs).collect()}
    for q in qs:
        assert whole[q] == pytest.approx(np.quantile([v for _, v in data], q), rel=1e-12, abs=1e-15)


def test_quantiles_skip_null_and_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "v double")
    assert quantiles(df, "v", [0.5]).first().value == 1.5
    assert quantiles(df.where("v > 5 and not isnan(v)"), "v", [0.5]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_window(numbers, descending):
    _, df = numbers
    counts = df.groupBy("g", "v").agg(F.count("v").alias("n"))
    key = F.desc("v") if descending else F.asc("v")
    before = W.partitionBy("g").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    plain = counts.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    assert rows(running_totals(counts, "v", ["n"], ["g"], descending)) == rows(plain)


def test_average_ranks_equal_pandas(numbers):
    data, df = numbers
    pdf = pd.DataFrame(data, columns=["g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank()
    expected = {(g, v): r for g, v, r in pdf.itertuples(index=False)}
    for r in average_ranks(df, "v", ["g"]).collect():
        assert expected[(r.g, r.v)] == r.avg_rank


def test_previous_row_equals_lag(spark):
    rng = random.Random(5)
    day = dt.date(2024, 1, 1)
    seqs = rng.sample(range(5000), 600)
    data = [(rng.choice("xxxy"), day + dt.timedelta(days=rng.choice([0, 0, 0, 3, 9])), s) for s in seqs]
    df = spark.createDataFrame(data, "line string, d date, seq bigint")
    plain = df.withColumn("p", F.lag("seq").over(W.partitionBy("line").orderBy("d", "seq")))
    found = previous_row(df, "line", "d", "seq", ["seq"], block=64)
    assert rows(found.select("line", "d", "seq", "_previous.seq")) == rows(plain)


def _asof_data(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 3, 1)
    keys = ["k1"] * 6 + ["k2", "k3"]
    right = [(rng.choice(keys), start + dt.timedelta(seconds=rng.randint(0, 4000)), i, f"v{i}") for i in range(800)]
    right += [("k1", start, i, f"v{i}") for i in range(800, 1000)]
    left = [(i, rng.choice([*keys, "none"]), start + dt.timedelta(seconds=rng.randint(-300, 9000))) for i in range(500)]
    left += [(500, None, start), (501, "k1", None), (502, "k1", start)]
    return (
        spark.createDataFrame(left, "id bigint, k string, at timestamp_ntz"),
        spark.createDataFrame(right, "k string, ts timestamp_ntz, eid bigint, v string"),
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_equals_join_and_row_number(spark, how):
    left, right = _asof_data(spark)
    found = asof_join(left, right, ["k"], "at", "ts", "eid", ["v"], how).select("id", "eid", "v")
    pairs = left.join(right, (left.k == right.k) & (right.ts <= left.at), how)
    newest = W.partitionBy("id").orderBy(F.desc("ts"), F.desc("eid"))
    plain = pairs.withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("id", "eid", "v")
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_pair_support_equals_self_join(spark):
    rng = random.Random(9)
    data = [(f"d{rng.randint(0, 30)}", f"e{rng.randint(0, 12)}") for _ in range(250)]
    data += [(None, "e1"), (None, "e2"), ("d1", None)]
    df = spark.createDataFrame(data, "d string, e string")
    distinct = df.distinct()
    a, b = distinct.alias("a"), distinct.alias("b")
    plain = (
        a.join(b, (F.col("a.d") == F.col("b.d")) & (F.col("a.e") < F.col("b.e")))
        .groupBy("a.e", "b.e")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 5")
    )
    assert rows(pair_support(df, "d", "e", 5)) == rows(plain)


def test_blocked_pairs_equal_theta_join(spark):
    df = spark.range(40).select(F.col("id").alias("a"))
    other = spark.range(25).select((F.col("id") * 2).alias("b"))
    found = blocked_pairs(df, other, "a", "b", F.col("a") > F.col("b"), blocks=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(found.select("a", "b")) == rows(df.join(other, F.col("a") > F.col("b")).select("a", "b"))


def test_one_holder_of_every_item(spark):
    rows = [("all", f"i{k:03d}") for k in range(60)] + [(f"h{k}", f"i{k:03d}") for k in range(60)]
    found = pair_support(spark.createDataFrame(rows, "holder string, item string"), "holder", "item", 1)
    assert found.count() == 60 * 59 // 2 and {r.holders for r in found.collect()} == {1}


def test_quantiles_of_any_double(spark):
    values = [float("-inf"), -1e300, -1.0, 0.0, 1e-300, 1.0, 1e300, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {r.q: r.value for r in quantiles(df, "v", [0.0, 0.125, 0.5, 0.75, 1.0]).collect()}
    assert found == {0.0: float("-inf"), 0.125: -1e300, 0.5: 1e-300, 0.75: 1e300, 1.0: float("inf")}
    ranks = {r.v: r.avg_rank for r in average_ranks(df, "v").collect()}
    assert ranks[float("inf")] == 8.5 and ranks[-1e300] == 2.0


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("REPARTITION_BY_COL" in line for line in plan.splitlines()), plan


def test_scans_deal_rows_out_once(spark):
    left, right = _asof_data(spark)
    numbers = spark.range(100).select((F.col("id") / 7).alias("v"), F.col("id").alias("n"))
    for df in (asof_join(left, right, ["k"], "at", "ts", "eid", ["v"]), running_totals(numbers, "v", ["n"])):
        dealt, plan = shuffles(df)
        assert dealt == 1 and "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_a_hot_key_goes_through_many_slots(spark):
    """A third of all rows under one key, and as many under one time of it."""
    start = dt.datetime(2024, 3, 1)
    many = spark.range(30_000)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    at = F.lit(start) + F.make_dt_interval(secs=F.when(F.col("id") % 6 == 0, 500).otherwise(F.col("id") % 1000))
    right = many.where("id % 5 < 3").select(key.alias("k"), at.cast("timestamp_ntz").alias("ts"), F.col("id").alias("eid"))
    left = many.where("id % 5 >= 3").select(key.alias("k"), at.cast("timestamp_ntz").alias("at"), F.col("id"))
    found = asof_join(left, right, ["k"], "at", "ts", "eid", [], "left")
    slots = Slots(right, ["k"], [F.col("ts"), F.col("eid")])
    sizes = [r["count"] for r in slots.add(right).groupBy("_slot").count().collect()]
    assert len(sizes) == slots.number and max(sizes) < 2.5 * 18_000 / slots.number
    plain, newest = {}, {}
    sides = [(r.k, r.ts, 0, r.eid) for r in right.collect()] + [(r.k, r["at"], 1, r.id) for r in left.collect()]
    for k, _, probe, i in sorted(sides):
        if probe:
            plain[i] = newest.get(k)
        else:
            newest[k] = i
    assert {r.id: r.eid for r in found.collect()} == plain


def test_scans_of_no_rows_and_of_one_value(spark):
    none = spark.range(0).select(F.col("id").cast("double").alias("v"), F.col("id").alias("n"))
    assert running_totals(none, "v", ["n"]).collect() == [] and average_ranks(none, "v").collect() == []
    one = spark.createDataFrame([(1.0, 3), (float("nan"), 5), (None, 7)], "v double, n bigint")
    assert [tuple(r) for r in running_totals(one, "v", ["n"]).collect()] == [(1.0, 3, 0)]
    empty = spark.createDataFrame([], "line string, d date, seq bigint")
    assert previous_row(empty, "line", "d", "seq", ["seq"]).collect() == []
    rows_ = spark.createDataFrame([(None, dt.date(2024, 1, 1), 1), ("a", None, 2), ("a", dt.date(2024, 1, 1), None), ("a", dt.date(2024, 1, 1), 4)], "line string, d date, seq bigint")
    assert [r._previous for r in previous_row(rows_, "line", "d", "seq", ["seq"]).collect()] == [None] * 4


def test_quantiles_of_many_columns_in_two_reads(spark, monkeypatch):
    """With a coarse sketch, so that brackets leave most values out."""
    monkeypatch.setattr(ordered, "SKETCH", 100)
    rng = np.random.default_rng(8)
    data = [(rng.choice(["a", "a", "b"]), float(rng.normal()), float(rng.integers(5)), None if rng.random() < 0.2 else float(rng.exponential())) for _ in range(6000)]
    df = spark.createDataFrame([(str(r[0]), *r[1:]) for r in data], "g string, x double, y double, z double").repartition(7)
    qs = [0.0, 0.05, 0.5, 0.751, 1.0]
    for by in ([], ["g"]):
        found = quantiles_of(df, ["x", "y", "z"], qs, by)
        groups = {r.column: 0 for r in found.collect()}
        assert set(groups) == {"x", "y", "z"} and found.count() == 15 * (2 if by else 1)
        for r in found.collect():
            own = [v for g, *vs in data if not by or g == r.g for v in [vs["xyz".index(r.column)]] if v is not None]
            assert r.value == pytest.approx(np.quantile(own, r.q), rel=1e-12, abs=1e-15)
    plan = quantiles_of(df, ["x", "y", "z"], qs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2
    assert quantiles_of(df.limit(0), ["x"], qs).collect() == [] and quantiles_of(df.limit(0), ["x"], qs, ["g"]).collect() == []
