"""Driver, constructor and circuit tables, and the pick lists taken from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.operators import facts
from apexframe.schemas import Dump

ENTITIES = ("drivers", "constructors", "circuits")


def drivers(dump: Dump) -> DataFrame:
    """Drivers with the date of the first round they were entered for.

    Any round counts, held or cancelled, whatever its sessions. The entries are
    reduced to one date per driver contract before they meet the drivers.
    """
    rounds = dump.round.select(F.col("id").alias("round_id"), "date")
    team_drivers = dump.teamdriver.select(F.col("id").alias("team_driver_id"), "driver_id")
    entered = dump.roundentry.select("round_id", "team_driver_id")
    per_pair = entered.join(rounds, "round_id").groupBy("team_driver_id").agg(F.min("date").alias("date"))
    debut = (
        per_pair.join(team_drivers, "team_driver_id")
        .groupBy("driver_id")
        .agg(F.min("date").alias("first_race_date"))
    )
    return (
        dump.driver.join(debut, F.col("id") == F.col("driver_id"))
        .select(
            F.col("reference").alias("driverRef"),
            F.col("country_code").alias("driver_nationality"),
            F.col("date_of_birth").alias("driver_date_of_birth"),
            "first_race_date",
        )
        .dropna()
        .distinct()
    )


def constructors(dump: Dump) -> DataFrame:
    return (
        dump.team.select(
            F.col("reference").alias("constructorRef"),
            F.col("country_code").alias("constructor_nationality"),
        )
        .dropna()
        .distinct()
    )


def circuits(dump: Dump) -> DataFrame:
    """Circuits of known type."""
    typed = facts.with_circuit_type(
        dump.circuit.withColumnRenamed("reference", "circuit"), dump.circuit_type
    )
    return (
        typed.select(
            F.col("circuit").alias("circuitRef"),
            F.col("country_code").alias("circuit_nationality"),
            "type_circuit",
        )
        .dropna()
        .distinct()
    )


def all_dimensions(dump: Dump) -> dict[str, DataFrame]:
    return {
        "drivers": drivers(dump),
        "constructors": constructors(dump),
        "circuits": circuits(dump),
    }


def pick_drivers(entries: DataFrame, driver_table: DataFrame) -> DataFrame:
    """Drivers of the entries as the driver table describes them; one that is
    not in it gives a row of nulls."""
    seen = entries.select("driver").distinct()
    return seen.join(driver_table, F.col("driver") == F.col("driverRef"), "left").drop("driver")


def pick_constructors(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("constructor").alias("constructorRef"), "constructor_nationality"
    ).distinct()


def pick_circuits(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("circuit").alias("circuitRef"), "circuit_nationality").distinct()


def pick_lists(entries: DataFrame, driver_table: DataFrame) -> dict[str, DataFrame]:
    """What may be asked for in one task: the entities its entries contain."""
    return {
        "drivers": pick_drivers(entries, driver_table),
        "constructors": pick_constructors(entries),
        "circuits": pick_circuits(entries),
    }
