"""Main-race training table: how far from the race median each car finished."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.functions import half_even, time_to_ms
from apexframe.operators import facts, groups, rollup
from apexframe.schemas import MAINRACE, RACE, Dump
from apexframe.session import stage

# Everything known about a car in a race apart from its single laps.
ATTRIBUTES = (
    "is_classified",
    "qualification_position",
    "laps_completed",
    "driver",
    "driver_nationality",
    "driver_date_of_birth",
    "constructor",
    "constructor_nationality",
    "circuit",
    "circuit_nationality",
    "date",
    "race_month",
    "race_day",
    "race_year",
    "age_at_gp_in_days",
    "first_race_date",
    "days_since_first_race",
    "rain",
    "type_circuit",
    "driver_home",
    "constructor_home",
    "milliseconds",
)
TRAINING = (*MAINRACE.features, MAINRACE.target, "final_position")


def entries(dump: Dump, year_from: int = 1981, earlier: DataFrame | None = None) -> DataFrame:
    """Race entries with their features and the session time in milliseconds."""
    cars = facts.race_entries(dump, year_from, earlier)
    session_ms = F.coalesce(time_to_ms(F.col("session_time")), F.lit(0))
    return cars.select("session_entry_id", session_ms.alias("milliseconds"), *[
        c for c in ATTRIBUTES if c != "milliseconds"
    ])


def rolled_up(
    dump: Dump,
    cars: DataFrame,
    keep_lap_identity: bool = False,
    skip_deleted: bool = False,
    laps_table: DataFrame | None = None,
) -> DataFrame:
    """One row per car and race of ``entries``, with its summed laps.

    ``laps_table`` hands over the ``lap_times`` if they were staged before, which pays
    for laps that are slow to read.
    """
    laps = rollup.lap_times(dump.lap, skip_deleted) if laps_table is None else laps_table
    return rollup.roll_up_laps(cars, laps, ATTRIBUTES, keep_lap_identity)


def timed(cars: DataFrame) -> DataFrame:
    """Cars with any time at all: their race duration and lap count."""
    laps_ms, session_ms = F.col("milliseconds_laptime"), F.col("milliseconds")
    return (
        cars.filter((laps_ms != 0) | (session_ms != 0))
        .withColumn("race_duration", F.when(laps_ms != 0, laps_ms).otherwise(session_ms))
        .withColumn("laps_completed", F.greatest(F.col("laps_completed").cast("long"), F.col("laps_count")))
        .drop("laps_count")
    )


def extrapolated(cars: DataFrame, min_laps: int = 10) -> DataFrame:
    """Duration over the full distance for classified cars that were lapped.

    Needs ``max_laps``, which counts cars below ``min_laps`` too.
    """
    missing = F.coalesce(F.abs(F.col("max_laps") - F.col("laps_completed")), F.lit(0))
    duration = F.col("race_duration").cast("double")
    full = duration + duration / F.col("laps_completed") * F.col("additional_laps")
    return (
        cars.filter(F.col("laps_completed") >= min_laps)
        .withColumn("additional_laps", missing)
        .withColumn("laps", F.col("max_laps"))
        .withColumn(
            "final_race_duration",
            F.coalesce(F.when(F.col("is_classified") == "t", full), duration),
        )
    )


def deviations(
    cars: DataFrame,
    min_laps: int = 10,
    lower: float = -110_000,
    upper: float = 612_000,
) -> DataFrame:
    """Rolled-up cars to ranked deviations from the median of their race.

    The order of steps matters: unclassified cars count in the median and are
    dropped after it; bounds and ranks see rounded values.
    """
    # Read by the statistics of three steps.
    cars = stage(timed(cars))
    cars = groups.group_max(cars, RACE, "laps_completed", "max_laps")
    cars = extrapolated(cars, min_laps)
    cars = groups.group_median(cars, RACE, "final_race_duration", "median_race_duration")
    gap = F.col("final_race_duration") - F.col("median_race_duration")
    cars = cars.withColumn("deviation_from_median", gap).filter(F.col("is_classified") == "t")
    cars = rounded(cars)
    gap = F.col("deviation_from_median")
    cars = cars.filter((gap > lower) & (gap < upper))
    return groups.group_rank(cars, RACE, "deviation_from_median", "final_position")


def rounded(rows: DataFrame) -> DataFrame:
    """Round every fractional column to whole numbers, halves to even."""
    fractional = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")]
    return rows.withColumns({name: half_even(F.col(name)) for name in fractional})


def training(
    dump: Dump,
    year_from: int = 1981,
    keep_lap_identity: bool = False,
    skip_deleted: bool = False,
    entries_table: DataFrame | None = None,
    laps_table: DataFrame | None = None,
    **bounds,
) -> DataFrame:
    """The training table. ``final_position`` is kept for evaluation only.

    ``entries_table`` and ``laps_table`` hand over the ``entries`` and the ``lap_times``
    if they were staged before.
    """
    cars = stage(entries(dump, year_from)) if entries_table is None else entries_table
    merged = rolled_up(dump, cars, keep_lap_identity, skip_deleted, laps_table)
    # Neither used from here on nor in the table, so not carried through its steps.
    merged = merged.drop("date", "driver_date_of_birth", "first_race_date")
    return deviations(merged, **bounds).select(*TRAINING)
