"""Checks and previews of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls")


def several_dates(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Groups that should have one date and have more."""
    return (
        df.groupBy(*keys)
        .agg(F.count_distinct(date).alias("dates"))
        .filter(F.col("dates") > 1)
    )


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def latest(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The last ``n`` rows in the given order; every task keeps its own last n."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def null_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows a roll-up on ``keys`` leaves out for a null key, per key."""
    missing = [F.count_if(F.col(k).isNull()).alias(k) for k in keys]
    whole = F.lit(False)
    for k in keys:
        whole = whole | F.col(k).isNull()
    counts = df.agg(*missing, F.count_if(whole).alias("any_key"))
    return counts.unpivot([], [*keys, "any_key"], "column_name", "nulls")
