"""Per-group maximum, median and rank for groups of any size, in one plan.

A window over a group puts all of it into one task and fails for a group that
holds a third of the table. Here a group is never gathered: its values are
counted with map-side combine, the counts are laid out in value order over
range partitions of even size, summed up inside the partitions, and joined back
to the rows. Row tables meet staged tables only, so that Spark broadcasts the
small ones and splits the hot keys of the others.

Null and NaN values are missing: they count in no maximum, median or rank and
get no rank. Negative and positive zero are equal. Rows with a null in a group
key get a null result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.session import stage, stage_ranges

_N, _BEFORE, _TOTAL, _RANGE = "_own_rows", "_rows_before", "_group_rows", "_range"
_WHICH, _VALUE, _RANK, _ALL = "_which", "_value", "_rank", "_all"


def group_max(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the maximum of ``value`` per group."""
    return attach(df, df.groupBy(*keys).agg(F.max(_present(df, value)).alias(out)), keys)


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the exact median of ``value`` per group, interpolated for even counts."""
    return attach(df, median_table(df, keys, value, out), keys)


def median_table(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """One row per group with the exact median of ``value``; null without values."""
    # The middle one or two of the sorted values, found by their positions.
    low = F.floor((F.col(_TOTAL) + 1) / 2)
    high = F.floor(F.col(_TOTAL) / 2) + 1

    def holds(position: Column) -> Column:
        return (F.col(_BEFORE) < position) & (position <= F.col(_BEFORE) + F.col(_N))

    middle = value_positions(df, keys, value).filter(holds(low) | holds(high))
    medians = middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / F.lit(2.0)).alias(out))
    known = df.dropna(subset=list(keys))
    every = known.groupBy(*keys).agg(F.count(_present(known, value)).alias(_N)).filter(F.col(_N) == 0)
    return medians.unionByName(every.select(*keys, F.lit(None).cast("double").alias(out)))


def group_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the rank of ``value`` in its group: ascending, ties share the lowest.

    Without keys all rows are one group.
    """
    ranks = value_positions(df, keys, value).select(*keys, value, (F.col(_BEFORE) + 1).alias(out))
    return attach(df, ranks, [*keys, value])


def group_ranks(df: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """``group_rank`` for several values of one type in a single pass: ``values``
    names the new column of each. The rows are read once and laid out once."""
    kinds = {df.schema[value].dataType.simpleString() for value in values}
    if len(kinds) > 1:
        raise ValueError(f"values of several types ({', '.join(sorted(kinds))}) are ranked one by one")
    each = [F.struct(F.lit(i).alias(_WHICH), F.col(value).alias(_VALUE)) for i, value in enumerate(values)]
    longer = df.select(*keys, F.inline(F.array(*each)))
    placed = value_positions(longer, [_WHICH, *keys], _VALUE)
    ranks = stage(placed.select(_WHICH, *keys, _VALUE, (F.col(_BEFORE) + 1).alias(_RANK)))
    for i, (value, out) in enumerate(values.items()):
        own = ranks.filter(F.col(_WHICH) == i)
        own = own.select(*keys, F.col(_VALUE).alias(value), F.col(_RANK).alias(out))
        df = _looked_up(df, own, [*keys, value])
    return df


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct value: how often it occurs, how many rows
    of the group lie below it, and how many rows the group has."""
    counts = (
        df.dropna(subset=[*keys, value])  # also drops NaN
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias(_N))
    )
    return running_sums(counts, keys, value, [_N]).select(
        *keys,
        value,
        _N,
        F.col(f"{_N}_below").alias(_BEFORE),
        F.col(f"{_N}_total").alias(_TOTAL),
    )


def running_sums(
    sums: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], derived: Mapping[str, Column] | None = None
) -> DataFrame:
    """Add ``<m>_below`` and ``<m>_total`` to rows that are unique per group and
    value: the sum of measure m over the smaller values, and over the group.

    The rows lie in range partitions by group and value, staged as such, and are
    summed inside them without a further shuffle. Only the first and the last
    group of a partition can lie in others too; what those hold of it comes from
    these edges, at most two rows a partition. Rows with a null key are left out.

    Measures in ``derived`` follow from the columns of their row. They are computed
    where they are summed, so that no shuffle and no file carries them.
    """
    group = list(keys) or [_ALL]
    known = sums.dropna(subset=group) if keys else sums.withColumn(_ALL, F.lit(0))
    dealt = stage_ranges(known, (*group, value), _RANGE).withColumns(dict(derived or {}))
    measures = [*measures, *(derived or {})]
    edges = _edges(dealt, group, measures)
    # One order for both frames, so that the rows pass one window and not two.
    ordered = Window.partitionBy(*group, _RANGE).orderBy(value)
    inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
    here = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = dealt.withColumns(
        {f"{m}_below": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}
        | {f"{m}_total": F.sum(m).over(here) for m in measures}
    )
    # Two rows a partition, whatever the size of the table.
    joined = dealt.join(F.broadcast(edges), [*group, _RANGE], "left")
    return joined.select(
        *sums.columns,
        *[(F.col(f"{m}_below") + F.coalesce(f"_{m}_lower", F.lit(0))).alias(f"{m}_below") for m in measures],
        *[F.coalesce(f"_{m}_whole", f"{m}_total").alias(f"{m}_total") for m in measures],
    )


def _edges(dealt: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The first and the last group of each range partition, with the sums of the
    group's parts in earlier partitions and in all. A group that lies in several
    partitions is an edge of each of them."""
    name, partition = F.struct(*group), Window.partitionBy(_RANGE)
    parts = dealt.groupBy(_RANGE, *group).agg(*[F.sum(m).alias(m) for m in measures])
    ends = parts.withColumns({"_first": F.min(name).over(partition), "_last": F.max(name).over(partition)})
    ends = ends.filter((name == F.col("_first")) | (name == F.col("_last")))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *group,
        _RANGE,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_lower") for m in measures],
        *[F.sum(m).over(whole).alias(f"_{m}_whole") for m in measures],
    )


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join ``stats``, which has one row per key, to the rows.

    ``stats`` is staged: its size is known, so it is broadcast if it is small,
    and else both sides are shuffled and the rows of a hot key are split.
    """
    return _looked_up(rows, stage(stats), keys)


def _looked_up(rows: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(staged, list(keys), "left").select(
        *rows.columns, *[c for c in staged.columns if c not in keys]
    )


def _present(df: DataFrame, value: str) -> Column:
    """The value, null where it is NaN."""
    if df.schema[value].dataType.typeName() in ("double", "float"):
        return F.when(~F.isnan(value), F.col(value))
    return F.col(value)
