"""Entry-grain facts: the join chain and the features that need no lap times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.functions import days_apart, home_flag, rain_flag
from apexframe.schemas import Dump
from apexframe.session import stage

RACE_SESSIONS = ("R",)
QUALIFYING_SESSIONS = ("Q1", "Q2", "Q3")
_ID_COLUMNS = ("driver_id", "team_id", "circuit_id")
_RACE_COLUMNS = (
    "session_entry_id",
    *_ID_COLUMNS,
    "date",
    "is_classified",
    "qualification_position",
    "session_time",
    "laps_completed",
)


def denormalize(dump: Dump, laps: bool = True) -> DataFrame:
    """All tables side by side, from rounds down to laps, nothing left out.

    Filters on the result reach the scans. One that needs a session turns the
    joins to sessions and entries into inner ones; the joins to descriptions and
    the two lookups of parents with very many children stay outer.
    """
    rounds = dump.round.select(
        F.col("id").alias("round_id"),
        "circuit_id",
        F.col("date").alias("round_date"),
        F.col("is_cancelled").alias("is_cancelled_round"),
    )
    sessions = dump.session.select(
        F.col("id").alias("session_id"),
        "round_id",
        "type",
        F.col("date").alias("session_date"),
        F.col("is_cancelled").alias("is_cancelled_session"),
    )
    wide = outer_fan_out(rounds.join(sessions, "round_id", "left"), _round_entries(dump), "round_id")
    wide = wide.join(_session_entries(dump), ["session_id", "round_entry_id"], "left")
    wide = _with_dimensions(wide, dump)
    if not laps:
        return wide
    times = dump.lap.select("session_entry_id", F.col("time").alias("lap_time"))
    return outer_fan_out(wide, times, "session_entry_id", apart=("round_id", "session_id", "round_entry_id"))


def outer_fan_out(
    parents: DataFrame,
    children: DataFrame,
    key: str,
    rows_per_task: int = 1_000_000,
    apart: Sequence[str] = (),
) -> DataFrame:
    """Left join of parents with any number of children each.

    In a plain left join the children of one key cannot be divided, so a parent
    with very many of them would fill a task. The keys with more children than
    ``rows_per_task`` are counted first, with map-side combine, and staged; a
    parent on that list is repeated once per part, its children are dealt over
    the parts. Both inputs are planned once, apart from the keys of the children.

    Parents without a key have no children, but would all meet in one task. They
    are dealt by the columns ``apart``, which tell them from one another.
    """
    counts = children.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_parts"))
    hot = stage(counts.filter("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = F.pmod(F.xxhash64(*children.columns), parts).cast("int")
    repeated = parents.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    if apart:
        keyless = F.hash(*apart)
        repeated = repeated.withColumn("_part", F.when(F.col(key).isNull(), keyless).otherwise(F.col("_part")))
    spread = children.join(hot, key, "left").select(*children.columns, dealt.alias("_part"), F.lit(True).alias("_child"))
    joined = repeated.join(spread, [key, "_part"], "left")
    # A repeated parent has children, so a part of it without any is no row.
    kept = joined.filter(F.col("_child").isNotNull() | F.col("_parts").isNull())
    return kept.select(*parents.columns, *[c for c in children.columns if c != key])


def session_entries(dump: Dump, types: Sequence[str]) -> DataFrame:
    """One row per entry of a session of the given types that was not cancelled.

    It starts from the entries, and every join adds one row of a parent table,
    so no step fans out.
    """
    sessions = dump.session.filter(
        F.col("type").isin(*types) & (F.col("is_cancelled") == "f")
    ).select(F.col("id").alias("session_id"), "round_id", F.col("date").alias("session_date"))
    rounds = dump.round.filter(F.col("is_cancelled") == "f").select(
        F.col("id").alias("round_id"), "circuit_id", F.col("date").alias("round_date")
    )
    # Sessions and rounds meet first: the entries then need one join for both. They are
    # staged, as Spark takes a join for too large to broadcast: it would shuffle the
    # entries of all sessions before it learns how few sessions are left.
    known = stage(sessions.join(rounds, "round_id"))
    return (
        _session_entries(dump)
        .join(known, "session_id")
        .join(_round_entries(dump), ["round_entry_id", "round_id"])
        .join(_team_drivers(dump), "team_driver_id", "left")
    )


def with_first_race(entries: DataFrame, date: str = "date", earlier: DataFrame | None = None) -> DataFrame:
    """Add each driver's earliest date among these entries, and among ``earlier``
    debuts (``driver_id, first_race_date``) if entries of other years are left out.

    An aggregate joined back, not a window: a driver with very many entries
    is combined before the shuffle.
    """
    debut = first_race_dates(entries, date)
    if earlier is not None:
        both = debut.unionByName(earlier.select("driver_id", "first_race_date"))
        debut = first_race_dates(both, "first_race_date")
    return entries.join(debut, "driver_id", "left")


def first_race_dates(entries: DataFrame, date: str = "date") -> DataFrame:
    return (
        entries.filter(F.col("driver_id").isNotNull())
        .groupBy("driver_id")
        .agg(F.min(date).alias("first_race_date"))
    )


def with_weather(entries: DataFrame, weather: DataFrame) -> DataFrame:
    """Add the rain flag; an entry on a date without weather is dropped."""
    known = weather.filter(F.col("weather").isNotNull())
    return entries.join(known, "date").withColumn("rain", rain_flag(F.col("weather"))).drop("weather")


def with_circuit_type(entries: DataFrame, circuit_type: DataFrame) -> DataFrame:
    return entries.join(circuit_type, "circuit", "left")


def with_names(entries: DataFrame, dump: Dump) -> DataFrame:
    """Add driver, constructor and circuit references and countries."""
    return _with_entities(entries, dump)


def with_calendar(entries: DataFrame) -> DataFrame:
    return entries.select(
        "*",
        F.month("date").alias("race_month"),
        F.dayofmonth("date").alias("race_day"),
        F.year("date").alias("race_year"),
        days_apart(F.col("driver_date_of_birth"), F.col("date")).alias("age_at_gp_in_days"),
        days_apart(F.col("first_race_date"), F.col("date")).alias("days_since_first_race"),
    )


def with_home_flags(entries: DataFrame) -> DataFrame:
    there = F.col("circuit_nationality")
    return entries.select(
        "*",
        home_flag(F.col("driver_nationality"), there).alias("driver_home"),
        home_flag(F.col("constructor_nationality"), there).alias("constructor_home"),
    )


def dated_race_entries(dump: Dump) -> DataFrame:
    """Race entries of all years with a result, dated by their round."""
    entries = session_entries(dump, RACE_SESSIONS).filter(F.col("is_classified").isNotNull())
    return entries.withColumn("date", F.col("round_date"))


def dated_qualifying_entries(dump: Dump, laps_seen: DataFrame) -> DataFrame:
    """Qualifying entries of all years with a row in ``laps_seen``, dated by session."""
    entries = session_entries(dump, QUALIFYING_SESSIONS).join(laps_seen, "session_entry_id")
    return entries.withColumn("date", F.col("session_date"))


def race_entries(dump: Dump, year_from: int = 1981, earlier: DataFrame | None = None) -> DataFrame:
    """Classified-or-not race entries with every feature that needs no laps.

    The year filter comes after the debut date, so earlier debuts count. With
    ``earlier`` debuts it comes first, and entries of earlier years aren't read.
    """
    entries = dated_race_entries(dump).select(*_RACE_COLUMNS)
    entries = _with_debut(entries, year_from, earlier)
    entries = with_weather(entries, dump.weather)
    return _featured(entries, dump)


def qualifying_entries(
    dump: Dump, laps_seen: DataFrame, year_from: int = 1981, earlier: DataFrame | None = None
) -> DataFrame:
    """Qualifying entries that have a row in ``laps_seen``, dated by session."""
    entries = dated_qualifying_entries(dump, laps_seen)
    entries = entries.select(*_ID_COLUMNS, "date", *laps_seen.columns)
    return _featured(_with_debut(entries, year_from, earlier), dump)


def _with_debut(entries: DataFrame, year_from: int, earlier: DataFrame | None) -> DataFrame:
    late = F.year("date") >= year_from
    # Computed once: the debut dates and the features both read it.
    entries = stage(entries if earlier is None else entries.filter(late))
    return with_first_race(entries, earlier=earlier).filter(late)


def _featured(entries: DataFrame, dump: Dump) -> DataFrame:
    entries = with_names(entries, dump)
    entries = with_circuit_type(entries, dump.circuit_type)
    return with_home_flags(with_calendar(entries))


def _session_entries(dump: Dump) -> DataFrame:
    return dump.sessionentry.select(
        F.col("id").alias("session_entry_id"),
        "session_id",
        "round_entry_id",
        "is_classified",
        F.col("grid").alias("qualification_position"),
        F.col("time").alias("session_time"),
        "laps_completed",
    )


def _round_entries(dump: Dump) -> DataFrame:
    return dump.roundentry.select(F.col("id").alias("round_entry_id"), "round_id", "team_driver_id")


def _team_drivers(dump: Dump) -> DataFrame:
    return dump.teamdriver.select(F.col("id").alias("team_driver_id"), "team_id", "driver_id")


def _with_dimensions(rows: DataFrame, dump: Dump) -> DataFrame:
    return _with_entities(rows.join(_team_drivers(dump), "team_driver_id", "left"), dump)


def _with_entities(rows: DataFrame, dump: Dump) -> DataFrame:
    drivers = dump.driver.select(
        F.col("id").alias("driver_id"),
        F.col("reference").alias("driver"),
        F.col("country_code").alias("driver_nationality"),
        F.col("date_of_birth").alias("driver_date_of_birth"),
    )
    teams = dump.team.select(
        F.col("id").alias("team_id"),
        F.col("reference").alias("constructor"),
        F.col("country_code").alias("constructor_nationality"),
    )
    circuits = dump.circuit.select(
        F.col("id").alias("circuit_id"),
        F.col("reference").alias("circuit"),
        F.col("country_code").alias("circuit_nationality"),
    )
    return (
        rows.join(drivers, "driver_id", "left")
        .join(teams, "team_id", "left")
        .join(circuits, "circuit_id", "left")
    )
