"""Validate prediction requests and expand them into model features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.functions import home_flag, parse_date, signed_days, strip
from apexframe.schemas import TASKS

_NAMES = {"driver": "driverRef", "constructor": "constructorRef", "circuit": "circuitRef"}


def first_match(table: DataFrame, key: Column, out: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per key, ignoring case, as the struct ``out``: the least row by
    ``order``, then by all columns. It is an aggregate, not a window, so copies
    combine before the shuffle."""
    ordered = [*order, *[c for c in table.columns if c not in order]]
    keyed = table.withColumn(f"{out}_key", F.lower(key)).filter(F.col(f"{out}_key").isNotNull())
    return keyed.groupBy(f"{out}_key").agg(F.min(F.struct(*ordered)).alias(out))


def _with_asked(requests: DataFrame) -> DataFrame:
    """Add the names as they are looked up. They are columns, as a sort evaluates an
    expression anew in every comparison."""
    return requests.withColumns({f"_{n}_asked": F.lower(strip(F.col(n))) for n in _NAMES})


def with_validity(requests: DataFrame, picks: Mapping[str, DataFrame]) -> DataFrame:
    """Add ``valid``: driver, constructor and circuit are all in the pick lists."""
    checked = _with_asked(requests)
    valid = F.lit(True)
    for name, ref in _NAMES.items():
        known = (
            picks[f"{name}s"]
            .filter(F.col(ref).isNotNull())
            .select(F.lower(ref).alias(f"_{name}_known"))
            .distinct()
        )
        checked = checked.join(known, F.col(f"_{name}_asked") == F.col(f"_{name}_known"), "left")
        valid = valid & F.col(f"_{name}_known").isNotNull()
    return checked.withColumn("valid", valid).select(*requests.columns, "valid")


def accepted(requests: DataFrame, picks: Mapping[str, DataFrame]) -> DataFrame:
    """Requests whose names are all known, by semi joins."""
    checked = _with_asked(requests)
    for name, ref in _NAMES.items():
        known = picks[f"{name}s"].select(F.lower(ref).alias("_known"))
        checked = checked.join(known, F.col(f"_{name}_asked") == F.col("_known"), "left_semi")
    return checked.select(*requests.columns)


def rejected(requests: DataFrame, picks: Mapping[str, DataFrame]) -> DataFrame:
    """Requests with at least one unknown name."""
    return with_validity(requests, picks).filter(~F.col("valid")).drop("valid")


def insist_valid(requests: DataFrame, picks: Mapping[str, DataFrame]) -> DataFrame:
    """All requests; the job fails on the first that is not valid."""
    message = F.lit("driver, constructor or circuit is not in the pick lists")
    checked = with_validity(requests, picks)
    passed = F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return checked.filter(passed).drop("valid")


def expand(
    requests: DataFrame,
    dims: Mapping[str, DataFrame],
    task: str,
    faithful_case: bool = False,
    keep_input: bool = False,
) -> DataFrame:
    """The requests with the model features of ``task`` in place of their fields.

    Names are trimmed and found ignoring case. The feature is the spelling of
    the dimension table, which the model was trained on; ``faithful_case``
    keeps the spelling of the request. Day counts keep their sign here.
    ``keep_input`` adds the request as it came in the struct ``input``.
    """
    found = requests.select(
        F.struct("*").alias("_request"),
        *[strip(F.col(n)).alias(f"_asked_{n}") for n in _NAMES],
        F.col("race_date").cast("date").alias("_date"),
    )
    found = found.withColumns({f"_wanted_{n}": F.lower(f"_asked_{n}") for n in _NAMES})
    for name, ref in _NAMES.items():
        table = dims[f"{name}s"]
        asked = F.col(f"_wanted_{name}")
        matches = first_match(table, F.col(ref), f"_{name}")
        found = found.join(matches, asked == F.col(f"_{name}_key"), "left")
        if {"forename", "surname"} <= set(table.columns):
            full = F.concat_ws(" ", F.coalesce("forename", F.lit("")), F.coalesce("surname", F.lit("")))
            named = first_match(table, full, "_named")
            found = found.join(named, asked == F.col("_named_key"), "left").withColumn(
                f"_{name}", F.coalesce(f"_{name}", "_named")
            ).drop("_named", "_named_key")

    def asked_for(column: str) -> Column:
        known = column in requests.columns
        return F.col(f"_request.{column}") if known else F.lit(None)

    def canonical(name: str) -> Column:
        asked = F.col(f"_asked_{name}")
        return asked if faithful_case else F.coalesce(F.col(f"_{name}.{_NAMES[name]}"), asked)

    def looked_up(name: str, column: str) -> Column:
        known = column in dims[f"{name}s"].columns
        return F.col(f"_{name}.{column}") if known else F.lit(None).cast("string")

    def days_since(column: str) -> Column:
        since = looked_up("driver", column)
        table = dims["drivers"]
        if column not in table.columns or table.schema[column].dataType.typeName() != "date":
            since = parse_date(since.cast("string"), strict=False)
        return signed_days(F.col("_date"), since)

    there = looked_up("circuit", "circuit_nationality")
    drivers_land = looked_up("driver", "driver_nationality")
    constructors_land = looked_up("constructor", "constructor_nationality")
    columns = {
        "qualification_position": asked_for("qualification_position").cast("int"),
        "age_at_gp_in_days": days_since("driver_date_of_birth"),
        "days_since_first_race": days_since("first_race_date"),
        "laps": asked_for("laps").cast("int"),
        "race_year": F.year("_date"),
        "constructor": canonical("constructor"),
        "circuit": canonical("circuit"),
        "type_circuit": F.coalesce(
            F.nullif(looked_up("circuit", "type_circuit"), F.lit("")),
            asked_for("type_circuit").cast("string"),
        ),
        "driver": canonical("driver"),
        "circuit_nationality": there,
        "driver_nationality": drivers_land,
        "constructor_nationality": constructors_land,
        "race_month": F.month("_date"),
        "race_day": F.dayofmonth("_date"),
        "rain": F.coalesce(asked_for("rain").cast("int"), F.lit(0)),
        "driver_home": home_flag(drivers_land, there),
        "constructor_home": home_flag(constructors_land, there),
    }
    # Columns that are neither a feature nor a field of the request, such as an id.
    fields = {*columns, "race_date"}
    carried = [F.col(f"_request.{c}").alias(c) for c in requests.columns if c not in fields]
    if keep_input:
        carried.append(F.col("_request").alias("input"))
    return found.select(*carried, *[columns[c].alias(c) for c in TASKS[task].features])
