"""Registered queries against their SQL, and the shape of some plans."""

import math
import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from apexframe.functions import time_to_ms
from apexframe.learning import pipelines
from apexframe.operators import facts, groups
from apexframe.plans import mainrace, status
from apexframe.schemas import RACE
from starschema import mapping, queries

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def text(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return value.isoformat() if isinstance(value, datetime) else str(value)


def canonical(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert canonical(df.columns, df.collect()) == canonical(columns, result.fetchall())


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert contract.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_the_plans(spark):
    for name in ("status_training", "expand_features_mainrace", "time_to_ms", "pair_sums"):
        text = plan(QUERIES[name](spark, SF))
        assert not re.search("Python|Pandas|MapInArrow", text), name


def test_scan_reads_only_needed_columns(spark):
    lap = mapping.dump(spark, SF).lap.select("session_entry_id", time_to_ms(F.col("time")))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan(lap)


def test_small_tables_are_broadcast_without_hints(spark):
    dump = mapping.dump(spark, SF)
    wide = facts.with_names(
        spark.range(10).selectExpr("id AS driver_id", "id AS team_id", "id AS circuit_id"), dump
    )
    assert "BroadcastHashJoin" in plan(wide)


def test_filters_remove_the_outer_branches(spark):
    wide = facts.denormalize(mapping.dump(spark, SF), laps=False)
    races = wide.filter("type = 'R' AND is_classified IS NOT NULL AND is_cancelled_session = 'f'")
    optimized = races._jdf.queryExecution().optimizedPlan().toString()
    # The four joins to descriptions stay outer, and the lookups of hot keys on
    # both sides of the fan-out; the joins to sessions and entries don't.
    assert len(re.findall("Join LeftOuter", optimized)) == 6
    assert len(re.findall("Join Inner", optimized)) >= 2
    assert "Union" not in optimized
    before = wide._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Join LeftOuter", before)) > 6


def test_no_window_over_a_whole_race(spark):
    finishes = mapping.dump(spark, SF).finishes
    ranked = groups.group_rank(finishes, RACE, "score", "r")
    assert "Window" not in plan(ranked)  # the positions are staged


def test_fan_out_plans_its_inputs_once(spark):
    wide = facts.denormalize(mapping.dump(spark, SF))
    assert plan(wide).count("FileScan") <= 28


def test_sessions_are_broadcast_before_entries_are_shuffled(spark):
    for types in (facts.RACE_SESSIONS, facts.QUALIFYING_SESSIONS):
        text = plan(facts.session_entries(mapping.dump(spark, SF), types))
        assert "BroadcastHashJoin [session_id" in text and "Join [session_id" not in text.replace("BroadcastHashJoin", "")


def test_csv_laps_are_parsed_once(spark, monkeypatch):
    handed = {}
    monkeypatch.setattr(mainrace, "training", lambda dump, year_from, **more: handed.update(more, lap=dump.lap))
    QUERIES["csv_dump_training"](spark, SF)
    laps = handed["laps_table"]
    assert "FileScan csv" in plan(handed["lap"]) and "FileScan csv" not in plan(laps)
    assert laps.count() == handed["lap"].count()


def test_leaderboard_compares_full_settings(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(queries.inspect, "leaderboard", lambda train, test, task, candidates, nulls: asked.update(candidates))
    QUERIES["leaderboard"](spark, SF)
    boosted, forest, logistic = (pipelines.learner("status", e, **s) for e, s in asked.values())
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (400, 5)
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (800, 30)
    assert logistic.getMaxIter() == 100


def test_status_needs_no_laps(spark):
    assert "lineitem" not in plan(status.entries(mapping.dump(spark, SF)))
