"""Domain expressions (Column in, Column out); all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weather labels that count as a wet race.
WET_WEATHER = ("Rain", "Changeable", "Very changeable")


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lenient(value: Column, to: str = "double") -> Column:
    """Cast that gives null instead of an error."""
    return value.try_cast(to)


def half_even(value: Column) -> Column:
    """Round to a whole number, halves to the even neighbour."""
    return F.rint(value)


def rain_flag(weather: Column) -> Column:
    return F.coalesce(weather.isin(*WET_WEATHER), F.lit(False)).cast("int")


def home_flag(nationality: Column, circuit_nationality: Column) -> Column:
    """1 where both are known and equal, else 0."""
    return F.coalesce(nationality == circuit_nationality, F.lit(False)).cast("int")


def dnf_label(is_classified: Column) -> Column:
    return F.when(is_classified == "t", F.lit(0)).otherwise(F.lit(1))


def race_id(year: Column, month: Column, day: Column, circuit: Column) -> Column:
    """``year_month_day_circuit`` without zero padding."""
    return F.concat_ws("_", year.cast("string"), month.cast("string"), day.cast("string"), circuit)


def race_weight(entries: Column) -> Column:
    """Weight of a race by its number of entries."""
    return F.when(entries < 5, F.lit(0.2)).when(entries < 10, F.lit(0.5)).otherwise(F.lit(1.0))


def position_weight(position: Column) -> Column:
    """Weight of a finishing position."""
    return F.when(position <= 5, F.lit(3)).when(position <= 10, F.lit(2)).otherwise(F.lit(1))


def base_feature(name: Column, numeric: Sequence[str]) -> Column:
    """Column a feature name stands for: itself, or the text before the first ``_``."""
    return F.when(name.isin(*numeric), name).otherwise(F.split_part(name, F.lit("_"), F.lit(1)))


def split_bucket(key: Column, seed: int = 42, buckets: int = 100) -> Column:
    """Stable bucket of a text key, the same on every cluster and every run."""
    digest = F.md5(F.concat(key, F.lit(f"_{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
