"""Read and write training tables, dimensions and pick lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from apexframe.schemas import TASKS
from apexframe.session import stage
from apexframe.sources.dump import is_missing

YEAR = "race_year"


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def write_training(df: DataFrame, root: str, task: str) -> str:
    """Write one directory per year.

    The rebalance hint gathers the rows of a year, so that it has few files,
    and splits a year that is too large for one task.
    """
    path = f"{root}/training_{task}"
    write_years(df, path)
    return path


def write_years(df: DataFrame, path: str) -> None:
    df.hint("rebalance", YEAR).write.mode("overwrite").partitionBy(YEAR).parquet(path)


def replace_years(df: DataFrame, path: str, since: int) -> None:
    """Replace the directories of the years from ``since`` on by those of ``df``,
    which has no earlier year; a year that has no rows any more goes."""
    spark, df = df.sparkSession, stage(df)
    years = {row[0] for row in df.select(YEAR).distinct().collect()}  # one row a calendar year
    if any(year is None or year < since for year in years):
        raise ValueError(f"rows without a year or before {since}")
    writer = df.hint("rebalance", YEAR).write.mode("overwrite").partitionBy(YEAR)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        year = status.getPath().getName().removeprefix(f"{YEAR}=")
        if year.isdecimal() and int(year) >= since and int(year) not in years:
            files.delete(status.getPath(), True)


def read_training(spark: SparkSession, root: str, task: str, year_from: int | None = None) -> DataFrame:
    """Features, target and whatever else the table keeps; ``year_from`` skips
    the directories of earlier years."""
    df = spark.read.parquet(f"{root}/training_{task}")
    if year_from is not None:
        df = df.filter(df[YEAR] >= year_from)
    extra = [c for c in df.columns if c not in (*TASKS[task].features, TASKS[task].target)]
    return df.select(*TASKS[task].features, TASKS[task].target, *extra)


def write_dimensions(dims: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, df in dims.items():
        write(df, f"{root}/{name}", fmt)


def read_dimensions(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {n: read(spark, f"{root}/{n}", fmt) for n in ("drivers", "constructors", "circuits")}


def write_pick_lists(picks: Mapping[str, DataFrame], root: str, task: str, fmt: str = "parquet") -> None:
    for name, df in picks.items():
        write(df, f"{root}/{name}_{task}", fmt)


def read_pick_lists(spark: SparkSession, root: str, task: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {n: read(spark, f"{root}/{n}_{task}", fmt) for n in ("drivers", "constructors", "circuits")}


def read_options(spark: SparkSession, primary: str, fallback: str, fmt: str = "parquet") -> DataFrame:
    """The first of two tables that exists, as text with nulls as ``""``."""
    for path in (primary, fallback):
        try:
            df = read(spark, path, fmt)
        except AnalysisException as error:
            if not is_missing(error):
                raise
            continue
        return df.select(*[df[c].cast("string").alias(c) for c in df.columns]).na.fill("")
    raise FileNotFoundError(f"no options found (tried {primary} and {fallback})")


def write_race_tables(cars: DataFrame, root: str, fmt: str = "parquet") -> None:
    """The ranked cars with their race median, and the unique drivers,
    constructors and circuits among them, as five tables."""
    parts = {
        "race_cars": cars,
        "race_medians": cars.select("race_year", "race_month", "race_day", "circuit", "median_race_duration").distinct(),
        "unique_drivers": cars.select("driver", "driver_date_of_birth", "first_race_date", "driver_nationality").distinct(),
        "unique_constructors": cars.select("constructor", "constructor_nationality").distinct(),
        "unique_circuits": cars.select("circuit", "circuit_nationality", "type_circuit").distinct(),
    }
    for name, df in parts.items():
        write(df, f"{root}/{name}", fmt)
