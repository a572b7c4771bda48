"""Table contracts: the columns each step reads and writes."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns read from each dump table, with their types. Other columns in the
# files are ignored and never parsed.
DUMP = {
    "round": "id long, circuit_id long, name string, date date, is_cancelled string",
    "session": "id long, round_id long, type string, date date, is_cancelled string",
    "roundentry": "id long, round_id long, team_driver_id long",
    "sessionentry": (
        "id long, session_id long, round_entry_id long, is_classified string, "
        "grid int, time string, laps_completed int"
    ),
    "teamdriver": "id long, team_id long, driver_id long",
    "driver": "id long, reference string, country_code string, date_of_birth date",
    "team": "id long, reference string, country_code string",
    "circuit": "id long, reference string, country_code string",
    "lap": "session_entry_id long, number int, time string, is_deleted string",
}
WEATHER = "date date, weather string"
CIRCUIT_TYPE = "circuit string, type_circuit string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Dump:
    """The nine normalised tables and the two side tables."""

    round: DataFrame
    session: DataFrame
    roundentry: DataFrame
    sessionentry: DataFrame
    teamdriver: DataFrame
    driver: DataFrame
    team: DataFrame
    circuit: DataFrame
    lap: DataFrame
    weather: DataFrame
    circuit_type: DataFrame

    def with_tables(self, **tables: DataFrame) -> "Dump":
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


@dataclass(frozen=True)
class Task:
    """Columns of one prediction task (fixed values, in model order)."""

    name: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


# Fixed values, in model order: categories without and with the rain flag.
CATEGORICAL = (
    "constructor",
    "circuit",
    "type_circuit",
    "driver",
    "circuit_nationality",
    "driver_nationality",
    "constructor_nationality",
    "race_month",
    "race_day",
    "driver_home",
    "constructor_home",
)
WITH_RAIN = (
    "constructor",
    "circuit",
    "type_circuit",
    "driver",
    "circuit_nationality",
    "driver_nationality",
    "constructor_nationality",
    "race_month",
    "race_day",
    "rain",
    "driver_home",
    "constructor_home",
)

MAINRACE = Task(
    "mainrace",
    ("qualification_position", "age_at_gp_in_days", "days_since_first_race", "laps", "race_year"),
    WITH_RAIN,
    "deviation_from_median",
)
QUALIFYING = Task(
    "qualifying",
    ("age_at_gp_in_days", "days_since_first_race", "race_year"),
    CATEGORICAL,
    "deviation_from_median",
)
STATUS = Task(
    "status",
    ("qualification_position", "age_at_gp_in_days", "days_since_first_race", "race_year"),
    WITH_RAIN,
    "dnf",
)
TASKS = {t.name: t for t in (MAINRACE, QUALIFYING, STATUS)}

# Request columns per task.
REQUESTS = {
    "mainrace": (
        "qualification_position int, laps int, constructor string, circuit string, "
        "driver string, race_date date, rain int"
    ),
    "qualifying": "constructor string, circuit string, driver string, race_date date",
    "status": (
        "qualification_position int, constructor string, circuit string, "
        "driver string, race_date date, rain int"
    ),
}

# A race: the key its rows are ranked in.
RACE = ("race_year", "race_month", "race_day", "circuit")
