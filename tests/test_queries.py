"""Every registered query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from fleetgauge.sources import roundtrips

TABLES = ["region", "nation", "customer", "orders", "lineitem", "events"]
ORACLES = {k: v for k, v in entry_point.oracle_sql().items() if not k.startswith("op")}
# These fit, or write tables that several of their passes read.
EAGER = {"gbt_regressor", "gbt_classifier", "cross_validation", "retrained", "rf_regressor", "rf_classifier", "feature_importance", "scored_by_model"}
EAGER |= {"signal_audit", "signal_audit_pairwise", *roundtrips.QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = entry_point.queries()[name](spark, sf)
    found = table(df.columns, df.collect())
    relation = duck.sql(ORACLES[name])
    assert found == table(relation.columns, relation.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_building_a_query_runs_no_job(spark, sf):
    skipped = EAGER | {n for n in entry_point.queries() if n.startswith("op") or n == "pipeline"}
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name, query in entry_point.queries().items():
            if name not in skipped:
                query(spark, sf)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_gate_reads_orders_once(spark, sf):
    plan = entry_point.queries()["gate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey#") > 0 and plan.count("Relation [o_orderkey") == 1
