"""From a raw dump to every processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from apexframe.operators import dimensions
from apexframe.plans import mainrace, qualifying, status
from apexframe.schemas import Dump
from apexframe.session import stage
from apexframe.sources import tables


def build_dimensions(dump: Dump, root: str, fmt: str = "parquet") -> None:
    tables.write_dimensions(dimensions.all_dimensions(dump), root, fmt)


def build_task(
    dump: Dump, root: str, task: str, year_from: int = 1981, fmt: str = "parquet", cars: DataFrame | None = None
) -> str:
    """Pick lists and training table of one task. Needs the driver table.

    ``cars`` hands over the main-race ``entries``, from which two tasks start, if
    they were staged before.
    """
    spark = dump.round.sparkSession
    drivers = tables.read(spark, f"{root}/drivers", fmt)
    source = {"mainrace": mainrace, "qualifying": qualifying, "status": status}[task]
    if task == "mainrace" and cars is not None:
        entries = cars
    elif task == "status":
        entries = stage(status.entries(dump, year_from, cars=cars))
    else:
        entries = stage(source.entries(dump, year_from))
    picks = dimensions.pick_lists(entries, drivers)
    tables.write_pick_lists(picks, f"{root}/pick_lists", task, fmt)
    return tables.write_training(source.training(dump, year_from, entries_table=entries), root, task)


def build_all(dump: Dump, root: str, year_from: int = 1981, fmt: str = "parquet") -> None:
    build_dimensions(dump, root, fmt)
    cars = stage(mainrace.entries(dump, year_from))
    for task in ("mainrace", "qualifying", "status"):
        build_task(dump, root, task, year_from, fmt, cars)
