"""A small raw dump: two circuits, four drivers, races before and after 1981."""

from __future__ import annotations

from datetime import date

from apexframe.schemas import CIRCUIT_TYPE, DUMP, WEATHER, Dump, struct

D = date


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, struct(ddl))


def clock(ms):
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


ROUNDS = [
    (1, 1, "early", D(1979, 5, 1), "f"),
    (2, 1, "first", D(1985, 5, 1), "f"),
    (3, 2, "second", D(1985, 6, 1), "f"),
    (4, 2, "called off", D(1985, 7, 1), "t"),
    (5, 1, "no weather", D(1986, 5, 1), "f"),
]
SESSIONS = [(r[0] * 10, r[0], "R", r[3], "f") for r in ROUNDS] + [
    (21, 2, "Q1", D(1985, 4, 30), "f"),
    (22, 2, "Q2", D(1985, 4, 30), "f"),
    (23, 2, "FP", D(1985, 4, 29), "f"),
]
DRIVERS = [
    (1, "hamilton", "GBR", D(1955, 1, 1)),
    (2, "prost", "FRA", D(1955, 2, 24)),
    (3, "lauda", "AUT", D(1949, 2, 22)),
    (4, "senna", None, D(1960, 3, 21)),
]
TEAMS = [(1, "ferrari", "ITA"), (2, "lotus", "GBR")]
CIRCUITS = [(1, "silverstone", "GBR"), (2, "monza", "ITA")]
TEAM_DRIVERS = [(10 + d, 1 + d % 2, d) for d in (1, 2, 3, 4)]


def small_dump(spark, session_entries, laps):
    """``session_entries``: (id, session_id, driver, is_classified, grid, time, laps)."""
    round_of = {s[0]: s[1] for s in SESSIONS}
    round_entries = sorted({(round_of[e[1]] * 100 + e[2], round_of[e[1]], 10 + e[2]) for e in session_entries})
    entries = [
        (e[0], e[1], round_of[e[1]] * 100 + e[2], e[3], e[4], e[5], e[6]) for e in session_entries
    ]
    return Dump(
        round=frame(spark, DUMP["round"], ROUNDS),
        session=frame(spark, DUMP["session"], SESSIONS),
        roundentry=frame(spark, DUMP["roundentry"], round_entries),
        sessionentry=frame(spark, DUMP["sessionentry"], entries),
        teamdriver=frame(spark, DUMP["teamdriver"], TEAM_DRIVERS),
        driver=frame(spark, DUMP["driver"], DRIVERS),
        team=frame(spark, DUMP["team"], TEAMS),
        circuit=frame(spark, DUMP["circuit"], CIRCUITS),
        lap=frame(spark, DUMP["lap"], [(e, n, t, "f") for e, n, t in laps]),
        weather=frame(
            spark,
            WEATHER,
            [
                (D(1979, 5, 1), "Dry"),
                (D(1985, 5, 1), "Changeable"),
                (D(1985, 6, 1), "rain"),
                (D(1985, 7, 1), "Rain"),
            ],
        ),
        circuit_type=frame(spark, CIRCUIT_TYPE, [("silverstone", "Race circuit"), ("monza", "Race circuit")]),
    )
