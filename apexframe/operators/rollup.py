"""Lap tables rolled up to one row per driver and race."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.functions import time_to_ms

# Two independent hashes stand for all attributes of an entry, so that lap rows
# carry 16 bytes through the shuffle instead of twenty columns.
_GROUP = ("_group_a", "_group_b")


def lap_times(lap: DataFrame, skip_deleted: bool = False, strict_fraction: bool = False) -> DataFrame:
    """Lap times in milliseconds, one row per lap that has a time text."""
    if skip_deleted:
        lap = lap.filter(F.coalesce(F.col("is_deleted") != "t", F.lit(True)))
    return lap.select(
        "session_entry_id",
        time_to_ms(F.col("time"), strict_fraction).alias("lap_ms"),
        F.col("time").isNotNull().alias("has_time"),
    )


def roll_up_laps(
    entries: DataFrame,
    laps: DataFrame,
    attributes: Sequence[str],
    keep_lap_identity: bool = False,
) -> DataFrame:
    """Sum and count the laps of every distinct combination of ``attributes``.

    ``entries`` holds one row per session entry, ``laps`` the columns
    ``session_entry_id`` and ``lap_ms``. A missing time counts as 0. An entry
    without laps counts one lap of 0. Equal lap times of one combination
    collapse into one, unless ``keep_lap_identity``. A combination with a null
    attribute is left out.

    Laps meet only the entry id and the hash of its attributes; the attributes
    are joined once, after the laps are summed.
    """
    marked = with_group_hash(entries.dropna(subset=list(attributes)), attributes)
    times = laps.select("session_entry_id", F.coalesce("lap_ms", F.lit(0)).alias("lap_ms"))
    ids = marked.select("session_entry_id", *_GROUP)
    if keep_lap_identity:
        per_entry = times.groupBy("session_entry_id").agg(
            F.sum("lap_ms").alias("ms"), F.count("lap_ms").alias("n")
        )
        timed = ids.join(per_entry, "session_entry_id", "left").select(
            *_GROUP, F.coalesce("ms", F.lit(0)).alias("ms"), F.coalesce("n", F.lit(1)).alias("n")
        )
    else:
        # An inner join, so that the laps of an entry with very many can be split;
        # entries without laps are found by their keys and count one lap of 0. Both
        # joins leave out null ids, so that they share one shuffle of the entries.
        no_id = F.col("session_entry_id").isNull()
        known = ids.filter(~no_id)
        lapped = known.join(times, "session_entry_id").select(*_GROUP, F.col("lap_ms").alias("ms"))
        without = known.join(times.select("session_entry_id").distinct(), "session_entry_id", "left_anti")
        without = without.unionByName(ids.filter(no_id))
        timed = lapped.unionByName(without.select(*_GROUP, F.lit(0).cast("long").alias("ms"))).distinct()
        timed = timed.withColumn("n", F.lit(1))
    sums = timed.groupBy(*_GROUP).agg(
        F.sum("ms").alias("milliseconds_laptime"), F.sum("n").cast("long").alias("laps_count")
    )
    merged = marked.select(*_GROUP, *attributes).dropDuplicates(list(_GROUP))
    return merged.join(sums, list(_GROUP)).drop(*_GROUP)


def best_lap_per_entry(laps: DataFrame) -> DataFrame:
    """Fastest lap of every session entry that has at least one time text."""
    timed = laps.filter("has_time")
    return timed.groupBy("session_entry_id").agg(F.min("lap_ms").alias("lap_ms"))


def best_lap(entries: DataFrame, attributes: Sequence[str], out: str) -> DataFrame:
    """Fastest ``lap_ms`` of every distinct combination of ``attributes``."""
    known = entries.dropna(subset=list(attributes))
    return known.groupBy(*attributes).agg(F.min("lap_ms").alias(out))


def with_group_hash(entries: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return entries.withColumns(
        {
            _GROUP[0]: F.xxhash64(F.lit(1), *attributes),
            _GROUP[1]: F.xxhash64(F.lit(2), *attributes),
        }
    )
