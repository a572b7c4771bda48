"""Training tables from a small raw dump."""

from datetime import date

import pytest
from fixtures import clock, small_dump
from pyspark.sql import functions as F

from apexframe.operators import dimensions, facts, groups, quality, rollup
from apexframe.plans import build, mainrace, qualifying, status
from apexframe.session import stage

# Race 20 (first, 1985-05-01): a full field with a lapped and a retired car.
ENTRIES = [
    (1, 10, 1, "t", 3, "01:30:00", 50),  # debut in 1979
    (2, 20, 1, "t", 1, "01:30:00", 12),
    (3, 20, 2, "t", 2, None, 10),
    (4, 20, 3, "f", 3, "01:00:00.000", 11),
    (5, 20, 4, "t", 4, "00:20:00", 12),  # nationality unknown
    (6, 30, 1, "t", None, "01:30:00", 60),  # grid unknown
    (7, 30, 2, None, 1, "01:30:00", 60),  # no result
    (8, 30, 3, "t", 1, "01:30:00", 60),  # no laps: session time
    (9, 40, 1, "t", 1, "01:30:00", 60),  # cancelled
    (10, 50, 1, "t", 1, "01:30:00", 60),  # no weather
    (11, 21, 1, "t", None, None, None),
    (12, 22, 1, "t", None, None, None),
    (13, 21, 2, "t", None, None, None),
    (14, 21, 3, "t", None, None, None),
    (15, 23, 2, "t", None, None, None),  # practice
]
LAPS = (
    [(2, n, clock(5000 + n)) for n in range(12)]
    + [(3, n, clock(6000)) for n in range(3)]
    + [(3, n, clock(6000 + n)) for n in range(1, 10)]
    + [(4, n, clock(7000 + n)) for n in range(11)]
    + [(5, 1, clock(5000))]
    + [(11, 1, clock(80000)), (11, 2, clock(79000)), (12, 1, clock(78500))]
    + [(13, 1, clock(80000)), (13, 2, "bad"), (14, 1, None), (15, 1, clock(1))]
)


@pytest.fixture(scope="module")
def dump(spark):
    return small_dump(spark, ENTRIES, LAPS)


def by(rows, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]: r for r in rows}


def test_session_filters(dump):
    races = facts.session_entries(dump, facts.RACE_SESSIONS).collect()
    assert sorted(r.session_entry_id for r in races) == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    quali = facts.session_entries(dump, facts.QUALIFYING_SESSIONS).collect()
    assert sorted(r.session_entry_id for r in quali) == [11, 12, 13, 14]


def test_denormalize_keeps_everything(dump):
    wide = facts.denormalize(dump)
    assert wide.filter("session_entry_id IS NOT NULL").select("session_entry_id").distinct().count() == 15
    # Rounds x sessions x entries of the round, and every lap of an entry.
    assert wide.filter("session_entry_id = 2").count() == 12
    # A round nobody entered, an entry without laps, a session not entered.
    alone = facts.denormalize(dump.with_tables(roundentry=dump.roundentry.filter("round_id <> 4")))
    assert alone.filter("round_id = 4 AND round_entry_id IS NULL").count() == 1
    assert wide.filter("session_entry_id = 8 AND lap_time IS NULL").count() == 1
    assert wide.filter("session_id = 22 AND session_entry_id IS NULL").count() == 3


def test_race_entries(dump):
    rows = by(facts.race_entries(dump).collect(), "session_entry_id")
    assert sorted(rows) == [2, 3, 4, 5, 6, 8]
    r = rows[2]
    assert (r.date, r.first_race_date) == (date(1985, 5, 1), date(1979, 5, 1))
    assert r.days_since_first_race == (date(1985, 5, 1) - date(1979, 5, 1)).days
    assert r.age_at_gp_in_days == (date(1985, 5, 1) - date(1955, 1, 1)).days
    assert (r.rain, rows[8].rain) == (1, 0)  # labels are case sensitive
    assert (r.driver_home, r.constructor_home) == (1, 1)
    assert (rows[5].driver_home, rows[8].driver_home) == (0, 0)


def test_lap_rollup(dump):
    cars = mainrace.entries(dump)
    rolled = by(mainrace.rolled_up(dump, cars).collect(), "driver", "race_month")
    # Null grid and null nationality are left out, as a group-by on them does.
    assert sorted(rolled) == [("hamilton", 5), ("lauda", 5), ("lauda", 6), ("prost", 5)]
    assert rolled["hamilton", 5].laps_count == 12
    # Three equal laps count once.
    assert rolled["prost", 5].laps_count == 10
    assert rolled["prost", 5].milliseconds_laptime == sum(6000 + n for n in range(10))
    # No laps: one lap of zero.
    assert (rolled["lauda", 6].laps_count, rolled["lauda", 6].milliseconds_laptime) == (1, 0)
    whole = by(mainrace.rolled_up(dump, cars, keep_lap_identity=True).collect(), "driver", "race_month")
    assert whole["prost", 5].laps_count == 12
    assert whole["lauda", 6].laps_count == 1


def test_equal_entries_merge(spark):
    twice = [
        (1, 20, 1, "t", 1, "01:30:00", 12),
        (2, 20, 1, "t", 1, "01:30:00", 12),
        (3, 20, 1, "t", 2, "01:30:00", 12),
    ]
    dump = small_dump(spark, twice, [(1, 1, clock(10)), (2, 1, clock(10)), (2, 2, clock(20))])
    rolled = by(mainrace.rolled_up(dump, mainrace.entries(dump)).collect(), "qualification_position")
    assert (rolled[1].laps_count, rolled[1].milliseconds_laptime) == (2, 30)
    assert (rolled[2].laps_count, rolled[2].milliseconds_laptime) == (1, 0)
    whole = mainrace.rolled_up(dump, mainrace.entries(dump), keep_lap_identity=True)
    assert by(whole.collect(), "qualification_position")[1].milliseconds_laptime == 40


def test_rollup_with_repeated_and_missing_ids(spark):
    """An id that comes twice, in two combinations, or not at all."""
    ids = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (None, "a"), (4, None)]
    laps = [(1, 5), (1, 5), (1, 7), (2, 7), (2, 9), (2, None), (4, 3), (None, 8), (5, 6)]
    entries = spark.createDataFrame(ids, "session_entry_id long, x string")
    laps = spark.createDataFrame(laps, "session_entry_id long, lap_ms long")
    rolled = rollup.roll_up_laps(entries, laps, ["x"])
    assert rolled.columns == ["x", "milliseconds_laptime", "laps_count"]
    # "a" also has an entry without laps, whose 0 is the 0 of the missing time.
    want = [("a", 21, 4), ("b", 21, 4), ("c", 0, 1), ("d", 0, 1)]
    assert sorted(map(tuple, rolled.collect())) == want
    whole = rollup.roll_up_laps(entries, laps, ["x"], keep_lap_identity=True)
    # 17 ms and 3 laps for each row of id 1, 16 and 3 for each of id 2.
    want = [("a", 50, 10), ("b", 33, 6), ("c", 0, 2), ("d", 0, 2)]
    assert sorted(map(tuple, whole.collect())) == want


def test_rollup_shuffles_ids_once(dump, spark):
    cars = stage(mainrace.entries(dump))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rolled = mainrace.rolled_up(dump, cars)
        rows = sorted(rolled.collect())
        text = rolled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in text.split("Initial Plan")[0]
    assert rows == sorted(mainrace.rolled_up(dump, cars).collect())


def test_mainrace_training(dump):
    rows = by(mainrace.training(dump).collect(), "driver", "race_month")
    assert sorted(rows) == [("hamilton", 5), ("lauda", 6), ("prost", 5)]
    hamilton = sum(5000 + n for n in range(12))
    prost = sum(6000 + n for n in range(10))
    lauda = sum(7000 + n for n in range(11))
    # Prost did 10 of 12 laps and is extrapolated; Lauda retired and is not,
    # but counts in the median.
    prost = prost + prost / 10 * 2
    middle = sorted([hamilton, prost, lauda])[1]
    assert rows["hamilton", 5].deviation_from_median == round(hamilton - middle)
    assert rows["prost", 5].deviation_from_median == round(prost - middle)
    assert rows["hamilton", 5].final_position == 1 and rows["prost", 5].final_position == 2
    assert rows["hamilton", 5].laps == 12
    assert rows["lauda", 6].deviation_from_median == 0.0


def steps(spark, rows):
    ddl = (
        "driver string, is_classified string, laps_completed int, laps_count long, "
        "milliseconds_laptime long, milliseconds long"
    )
    race = [(*r, 1985, 5, 1, "monza") for r in rows]
    return spark.createDataFrame(race, ddl + ", race_year int, race_month int, race_day int, circuit string")


def test_step_order(spark):
    cars = steps(
        spark,
        [
            ("winner", "t", 12, 12, 60000, 0),
            ("lapped", "t", 10, 10, 60000, 0),
            ("out", "f", 11, 11, 50000, 0),
            ("short", "t", 9, 9, 40000, 0),  # below the minimum of laps
            ("counted", "t", 3, 13, 130000, 0),  # counted laps exceed the given ones
            ("untimed", "t", 50, 1, 0, 0),  # gives no maximum of laps either
            ("clocked", "t", 12, 1, 0, 65000),
            ("far", "t", 12, 12, 60000 + 612000 + 5000, 0),
        ],
    )
    rows = by(mainrace.deviations(cars).collect(), "driver")
    # Maximum 13 laps, from the car that was counted.
    final = {
        "winner": 60000 + 60000 / 12,
        "lapped": 60000 + 60000 / 10 * 3,
        "out": 50000,
        "counted": 130000,
        "clocked": 65000 + 65000 / 12,
        "far": 677000 + 677000 / 12,
    }
    ordered = sorted(final.values())
    middle = (ordered[2] + ordered[3]) / 2
    assert set(rows) == {"winner", "lapped", "counted", "clocked"}
    for name, row in rows.items():
        assert row.deviation_from_median == round(final[name] - middle), name
    assert [rows[n].final_position for n in ("winner", "clocked", "lapped", "counted")] == [1, 2, 3, 4]


@pytest.mark.parametrize("edge, kept", [(-110000, False), (-109999, True), (611999, True), (612000, False)])
def test_bounds_are_strict(spark, edge, kept):
    base = 1_000_000
    cars = steps(spark, [(n, "t", 10, 10, base, 0) for n in "abc"] + [("edge", "t", 10, 10, base + edge, 0)])
    names = {r.driver for r in mainrace.deviations(cars).collect()}
    assert ("edge" in names) == kept


def test_ties_share_the_lowest_rank(spark):
    cars = steps(spark, [("a", "t", 10, 10, 5, 0), ("b", "t", 10, 10, 5, 0), ("c", "t", 10, 10, 9, 0)])
    rows = by(mainrace.deviations(cars).collect(), "driver")
    assert [rows[n].final_position for n in "abc"] == [1, 1, 3]


def test_qualifying_training(dump):
    laps = rollup.best_lap_per_entry(rollup.lap_times(dump.lap))
    assert by(laps.collect(), "session_entry_id")[13].lap_ms == 80000
    cars = qualifying.best_laps(qualifying.entries(dump))
    best = by(cars.collect(), "driver")
    # Best over the sessions of the day; a malformed time is ignored; a lap
    # without a time does not make an entry.
    assert {d: r.milliseconds_qualification for d, r in best.items()} == {"hamilton": 78500, "prost": 80000}
    rows = by(qualifying.training(dump).collect(), "driver")
    assert rows["hamilton"].deviation_from_median == -750.0
    # Dated by session, not by round; the debut counts qualifying dates only.
    assert (rows["hamilton"].race_month, rows["hamilton"].race_day) == (4, 30)
    assert rows["hamilton"].days_since_first_race == 0
    ranked = by(qualifying.deviations(cars).collect(), "driver")
    assert ranked["prost"].final_position == 2
    assert qualifying.deviations(cars, upper=0).count() == 1


def test_status_training(dump):
    rows = status.training(dump).collect()
    assert sorted((r.driver, r.race_month, r.dnf) for r in rows) == [
        ("hamilton", 5, 0),
        ("hamilton", 6, 0),
        ("lauda", 5, 1),
        ("lauda", 6, 0),
        ("prost", 5, 0),
        ("senna", 5, 0),
    ]


def test_year_from(dump):
    assert status.training(dump, year_from=1979).filter("race_year = 1979").count() == 1
    assert status.training(dump, year_from=1986).count() == 0


def test_dimensions(dump):
    dims = {k: v.collect() for k, v in dimensions.all_dimensions(dump).items()}
    drivers = by(dims["drivers"], "driverRef")
    assert sorted(drivers) == ["hamilton", "lauda", "prost"]  # one has no nationality
    assert drivers["hamilton"].first_race_date == date(1979, 5, 1)
    assert len(dims["constructors"]) == 2 and len(dims["circuits"]) == 2
    untyped = dump.with_tables(circuit_type=dump.circuit_type.filter("circuit = 'monza'"))
    assert [r.circuitRef for r in dimensions.circuits(untyped).collect()] == ["monza"]


def test_pick_lists(dump):
    picks = dimensions.pick_lists(mainrace.entries(dump), dimensions.drivers(dump))
    # A driver that the driver table does not have becomes a row of nulls.
    refs = {r.driverRef for r in picks["drivers"].collect()}
    assert refs == {"hamilton", "prost", "lauda", None}
    assert picks["circuits"].count() == 2


def test_quality(dump):
    entries = mainrace.entries(dump)
    nulls = by(quality.null_profile(entries).collect(), "column_name")
    assert nulls["qualification_position"].nulls == 1 and nulls["circuit"].nulls == 0
    lost = by(quality.null_key_rows(entries, mainrace.ATTRIBUTES).collect(), "column_name")
    assert lost["any_key"].nulls == 2
    assert quality.several_dates(entries, ["circuit"]).count() == 0
    assert quality.several_dates(entries, ["race_year"]).collect()[0].dates == 2
    assert [r.date for r in quality.latest(entries.select("date").distinct(), ["date"], 1).collect()] == [
        date(1985, 6, 1)
    ]


def test_parents_without_a_key_are_dealt(spark):
    """They match nothing, but an outer join sends equal keys to one task."""
    parents = spark.range(4000).selectExpr("id AS parent", "if(id < 10, id, NULL) AS key")
    children = spark.range(30).selectExpr("id % 10 AS key", "id AS child")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        wide = facts.outer_fan_out(parents, children, "key", apart=("parent",))
        sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
        rows = sorted((r.parent, r.child) for r in wide.filter("parent < 10 OR child IS NOT NULL").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 30 + 3990 and max(sizes) < 2000
    assert rows == sorted((k % 10, k) for k in range(30))


def test_build_hands_race_entries_on(dump, monkeypatch):
    """Main race and status start from the same staged entries."""
    handed = []
    monkeypatch.setattr(build, "build_dimensions", lambda *args: None)
    monkeypatch.setattr(build, "build_task", lambda *args: handed.append((args[2], args[-1])))
    build.build_all(dump, "nowhere")
    assert [task for task, _ in handed] == ["mainrace", "qualifying", "status"]
    cars = handed[0][1]
    assert handed[2][1] is cars
    got, want = status.entries(dump, cars=cars), status.entries(dump)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
