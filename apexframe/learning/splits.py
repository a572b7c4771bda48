"""Train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.functions import race_id, split_bucket
from apexframe.schemas import RACE


def race_key() -> Column:
    return race_id(*[F.col(c) for c in RACE])


def with_race_bucket(rows: DataFrame, seed: int = 42, buckets: int = 100) -> DataFrame:
    key = race_key()
    return rows.withColumns({"race_id": key, "bucket": split_bucket(key, seed, buckets)})


def split_by_race(rows: DataFrame, test_percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a race is wholly on one side.

    The side follows from a hash of the race, so nothing is collected and the
    split is the same whatever the partitioning.
    """
    bucket = split_bucket(race_key(), seed)
    return rows.filter(bucket >= test_percent), rows.filter(bucket < test_percent)


def split_by_ids(rows: DataFrame, test_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a given table of test ``race_id``s."""
    keyed = rows.withColumn("race_id", race_key())
    train = keyed.join(test_ids, "race_id", "left_anti")
    return train.drop("race_id"), keyed.join(test_ids, "race_id", "left_semi").drop("race_id")


def split_rows(
    rows: DataFrame, columns: Sequence[str], test_percent: int = 20, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the given columns, whatever the race."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    bucket = split_bucket(key, seed)
    return rows.filter(bucket >= test_percent), rows.filter(bucket < test_percent)
