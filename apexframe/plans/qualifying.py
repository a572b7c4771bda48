"""Qualifying training table: best lap against the median of the session date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.operators import facts, groups, rollup
from apexframe.plans.mainrace import rounded
from apexframe.schemas import QUALIFYING, RACE, Dump
from apexframe.session import stage

ATTRIBUTES = (
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
    "type_circuit",
    "driver_home",
    "constructor_home",
)
TRAINING = (*QUALIFYING.features, QUALIFYING.target)


def entries(
    dump: Dump, year_from: int = 1981, skip_deleted: bool = False, earlier: DataFrame | None = None
) -> DataFrame:
    """Qualifying entries with the fastest lap each; laps are reduced to one row
    per entry before they meet any other table."""
    best = rollup.best_lap_per_entry(rollup.lap_times(dump.lap, skip_deleted))
    return facts.qualifying_entries(dump, best, year_from, earlier)


def best_laps(cars: DataFrame) -> DataFrame:
    """One row per car and session date of ``entries``."""
    return rollup.best_lap(cars, ATTRIBUTES, "milliseconds_qualification").filter(
        F.col("milliseconds_qualification") != 0
    )


def deviations(cars: DataFrame, upper: float = 1_000_000) -> DataFrame:
    """Best laps to ranked deviations from the median of their session date."""
    cars = stage(cars)
    best = F.col("milliseconds_qualification")
    cars = groups.group_median(cars, RACE, "milliseconds_qualification", "median_qualification_duration")
    gap = best - F.col("median_qualification_duration")
    cars = rounded(cars.withColumn("deviation_from_median", gap))
    cars = cars.filter(F.col("deviation_from_median") < upper)
    return groups.group_rank(cars, RACE, "deviation_from_median", "final_position")


def training(
    dump: Dump,
    year_from: int = 1981,
    skip_deleted: bool = False,
    entries_table: DataFrame | None = None,
    **bounds,
) -> DataFrame:
    """The training table. ``entries_table`` hands over staged ``entries``."""
    if entries_table is None:
        entries_table = entries(dump, year_from, skip_deleted)
    return deviations(best_laps(entries_table), **bounds).select(*TRAINING)
