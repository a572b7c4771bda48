"""Retirement training table: which entries did not finish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.functions import dnf_label
from apexframe.operators import facts
from apexframe.schemas import STATUS, Dump

ATTRIBUTES = (
    "is_classified",
    "qualification_position",
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
)
TRAINING = (*STATUS.features, STATUS.target)


def entries(
    dump: Dump, year_from: int = 1981, earlier: DataFrame | None = None, cars: DataFrame | None = None
) -> DataFrame:
    """Distinct race entries. Laps would only multiply rows, so they stay out.

    ``cars`` hands over the race entries if they were staged before.
    """
    cars = facts.race_entries(dump, year_from, earlier) if cars is None else cars
    return cars.select(*ATTRIBUTES).distinct()


def training(
    dump: Dump, year_from: int = 1981, entries_table: DataFrame | None = None
) -> DataFrame:
    """The training table. ``entries_table`` hands over staged ``entries``."""
    cars = entries(dump, year_from) if entries_table is None else entries_table
    return cars.withColumn("dnf", dnf_label(F.col("is_classified"))).select(*TRAINING)
