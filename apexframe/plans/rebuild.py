"""Rebuild the last years of a training table and leave the others as they are.

The only feature that looks back beyond its year is a driver's debut. A side
table keeps each driver's earliest date in each year, so that the entries of
earlier years need not be read again. A year's debut depends on that year and
those before it; all years from a given one on are rebuilt together, and the
result equals a full rebuild as long as earlier years of the dump are the same.

Pick lists and dimensions are distinct values over all years: ``build`` makes
them. A rebuild that stops half-way is run again; every step replaces whole years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.operators import facts, rollup
from apexframe.plans import mainrace, qualifying, status
from apexframe.schemas import Dump
from apexframe.session import stage
from apexframe.sources import tables

_SOURCES = {"mainrace": mainrace, "qualifying": qualifying, "status": status}


def debuts(dump: Dump, task: str) -> DataFrame:
    """Earliest date of each driver and year among the entries of a task."""
    if task == "qualifying":
        seen = rollup.best_lap_per_entry(rollup.lap_times(dump.lap))
        dated = facts.dated_qualifying_entries(dump, seen)
    else:
        dated = facts.dated_race_entries(dump)
    known = dated.filter(F.col("driver_id").isNotNull())
    return known.groupBy("driver_id", F.year("date").alias(tables.YEAR)).agg(F.min("date").alias("first_race_date"))


def build_years(dump: Dump, root: str, task: str, year_from: int = 1981) -> None:
    """The training table of all years, and the debuts that ``rebuild_years`` needs."""
    tables.write_training(_SOURCES[task].training(dump, year_from), root, task)
    tables.write_years(debuts(dump, task), _debut_path(root, task))


def rebuild_years(dump: Dump, root: str, task: str, since: int, year_from: int = 1981) -> None:
    """Replace the years from ``since`` on; files of earlier years aren't touched."""
    if since < year_from:
        raise ValueError(f"the table starts in {year_from}; build it anew to change {since}")
    source, path = _SOURCES[task], _debut_path(root, task)
    earlier = dump.round.sparkSession.read.parquet(path).filter(F.col(tables.YEAR) < since)
    earlier = earlier.groupBy("driver_id").agg(F.min("first_race_date").alias("first_race_date"))
    entries = stage(source.entries(dump, since, earlier=earlier))
    tables.replace_years(source.training(dump, since, entries_table=entries), f"{root}/training_{task}", since)
    tables.replace_years(debuts(dump, task).filter(F.col(tables.YEAR) >= since), path, since)


def _debut_path(root: str, task: str) -> str:
    return f"{root}/debuts_{task}"
