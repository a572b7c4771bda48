"""Plain SQL for the registered queries, on the star schema itself."""

from __future__ import annotations

from apexframe.schemas import TASKS

YEAR_FROM = 1996

# --- shared subqueries ------------------------------------------------------

PLACED = """
placed AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         CAST(o_orderdate AS DATE) AS o_date, c_nationkey, c_mktsegment, c_name,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(c_nationkey AS BIGINT) * 1000000 + year(o_orderdate) * 100 + month(o_orderdate) AS round_id
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

NAMES = """
driver_names AS (
  SELECT c_custkey AS driver_id, lower(c_name) AS driver, n_name AS driver_nationality,
         CASE WHEN c_custkey % 50 <> 0
              THEN CAST(DATE '1960-01-01' + CAST(c_custkey % 7300 AS INTEGER) AS DATE) END AS driver_date_of_birth
  FROM customer JOIN nation ON c_custkey * 7 % 25 = n_nationkey
), team_names AS (
  SELECT DISTINCT c_mktsegment, lower(c_mktsegment) AS constructor, n_name AS constructor_nationality
  FROM customer JOIN nation ON ascii(c_mktsegment) % 25 = n_nationkey
), circuit_names AS (
  SELECT n_nationkey, n_name AS circuit, n_name AS circuit_nationality,
         CASE WHEN n_nationkey % 10 <> 9 THEN r_name END AS type_circuit
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

WEATHER = """
per_type AS (
  SELECT day(ts) AS d, event_type, count(*) AS n FROM events GROUP BY ALL
), top_type AS (
  SELECT d, event_type FROM per_type
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, event_type) = 1
), weather AS (
  SELECT CAST(DATE '1994-12-01' + to_months(CAST(d + shift AS INTEGER)) AS DATE) AS date,
         CASE event_type WHEN 'error' THEN 'Rain' WHEN 'click' THEN 'Changeable'
              WHEN 'view' THEN 'Very changeable' ELSE 'Dry' END AS weather
  FROM top_type, (VALUES (0), (31), (62)) AS s(shift)
)"""

SESSION_ENTRIES = """
session_entry AS (
  SELECT o_orderkey * 2 + k AS id, o_orderkey, round_id, c_nationkey, c_mktsegment, month, k,
         CASE WHEN k = 0 THEN 0 ELSE 1 + o_orderkey % 2 END AS session_no,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'f' ELSE 't' END AS is_classified,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
              THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS qualification_position,
         CAST(floor(o_totalprice + 0.5) AS BIGINT) AS milliseconds,
         CAST(o_orderkey % 16 AS INTEGER) AS laps_completed, o_custkey AS driver_id
  FROM placed, (VALUES (0), (1)) AS kinds(k)
), held AS (
  SELECT *, CASE WHEN k = 0 THEN month ELSE CAST(month - INTERVAL 1 DAY AS DATE) END AS date
  FROM session_entry
  WHERE round_id % 37 <> 0 AND (round_id + session_no) % 41 <> 0
), lap AS (
  SELECT l_orderkey * 2 + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS entry_id,
         CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS ms
  FROM lineitem
)"""

_CALENDAR = """
         CAST(month(date) AS INTEGER) AS race_month, CAST(day(date) AS INTEGER) AS race_day,
         CAST(year(date) AS INTEGER) AS race_year,
         CAST(abs(date_diff('day', driver_date_of_birth, date)) AS INTEGER) AS age_at_gp_in_days,
         CAST(abs(date_diff('day', first_race_date, date)) AS INTEGER) AS days_since_first_race,
         CASE WHEN driver_nationality = circuit_nationality THEN 1 ELSE 0 END AS driver_home,
         CASE WHEN constructor_nationality = circuit_nationality THEN 1 ELSE 0 END AS constructor_home"""

RACE_ENTRIES = f"""
raced AS (
  SELECT *, min(date) OVER (PARTITION BY driver_id) AS first_race_date
  FROM held WHERE k = 0 AND is_classified IS NOT NULL
), race_entry AS (
  SELECT id, is_classified, qualification_position, laps_completed, driver, driver_nationality,
         driver_date_of_birth, constructor, constructor_nationality, circuit, circuit_nationality,
         date, first_race_date, type_circuit, milliseconds,
         CASE WHEN weather IN ('Rain', 'Changeable', 'Very changeable') THEN 1 ELSE 0 END AS rain,
         {_CALENDAR}
  FROM raced JOIN weather USING (date)
  LEFT JOIN driver_names USING (driver_id)
  LEFT JOIN team_names USING (c_mktsegment)
  LEFT JOIN circuit_names ON c_nationkey = n_nationkey
  WHERE year(date) >= {YEAR_FROM}
)"""

RACE_BASE = ",".join([PLACED, NAMES, WEATHER, SESSION_ENTRIES, RACE_ENTRIES])

_RACE_ATTRIBUTES = (
    "is_classified, qualification_position, laps_completed, driver, driver_nationality, "
    "driver_date_of_birth, constructor, constructor_nationality, circuit, circuit_nationality, "
    "date, race_month, race_day, race_year, age_at_gp_in_days, first_race_date, "
    "days_since_first_race, rain, type_circuit, driver_home, constructor_home, milliseconds"
)
_STATUS_ATTRIBUTES = _RACE_ATTRIBUTES.replace("laps_completed, ", "").replace(", milliseconds", "")
_QUALIFYING_ATTRIBUTES = (
    "driver, driver_nationality, driver_date_of_birth, constructor, constructor_nationality, "
    "circuit, circuit_nationality, date, race_month, race_day, race_year, age_at_gp_in_days, "
    "first_race_date, days_since_first_race, type_circuit, driver_home, constructor_home"
)


def _all_known(columns: str) -> str:
    return " AND ".join(f"{c.strip()} IS NOT NULL" for c in columns.split(","))


ROLLED = f"""
timed_lap AS (
  SELECT DISTINCT {_RACE_ATTRIBUTES}, coalesce(ms, 0) AS lap_ms
  FROM race_entry LEFT JOIN lap ON id = entry_id
), rolled AS (
  SELECT {_RACE_ATTRIBUTES}, CAST(sum(lap_ms) AS BIGINT) AS milliseconds_laptime, count(lap_ms) AS laps_count
  FROM timed_lap WHERE {_all_known(_RACE_ATTRIBUTES)} GROUP BY {_RACE_ATTRIBUTES}
)"""

TIMED = f"""
timed AS (
  SELECT * EXCLUDE (laps_completed, laps_count),
         greatest(CAST(laps_completed AS BIGINT), laps_count) AS laps_completed,
         CASE WHEN milliseconds_laptime <> 0 THEN milliseconds_laptime ELSE milliseconds END AS race_duration
  FROM rolled WHERE milliseconds_laptime <> 0 OR milliseconds <> 0
), maxed AS (
  SELECT *, max(laps_completed) OVER (PARTITION BY circuit, race_year, date) AS max_laps FROM timed
), extended AS (
  SELECT *, max_laps AS laps, abs(max_laps - laps_completed) AS additional_laps,
         CASE WHEN is_classified = 't'
              THEN CAST(race_duration AS DOUBLE)
                   + CAST(race_duration AS DOUBLE) / laps_completed * abs(max_laps - laps_completed)
              ELSE CAST(race_duration AS DOUBLE) END AS final_race_duration
  FROM maxed WHERE laps_completed >= 10
), compared AS (
  SELECT *, median(final_race_duration) OVER (PARTITION BY circuit, race_year, date) AS median_race_duration
  FROM extended
), deviated AS (
  SELECT * REPLACE (round_even(final_race_duration, 0) AS final_race_duration,
                    round_even(median_race_duration, 0) AS median_race_duration),
         round_even(final_race_duration - median_race_duration, 0) AS deviation_from_median
  FROM compared WHERE is_classified = 't'
), finished AS (
  SELECT *, CAST(rank() OVER (PARTITION BY race_year, race_month, race_day, circuit
                              ORDER BY deviation_from_median) AS BIGINT) AS final_position
  FROM deviated WHERE deviation_from_median > -110000 AND deviation_from_median < 612000
)"""

MAINRACE = ",".join([RACE_BASE, ROLLED, TIMED])

QUALIFYING = ",".join(
    [
        PLACED,
        NAMES,
        SESSION_ENTRIES,
        f"""
best AS (SELECT entry_id, min(ms) AS lap_ms FROM lap GROUP BY entry_id),
qualified AS (
  SELECT *, min(date) OVER (PARTITION BY driver_id) AS first_race_date
  FROM held JOIN best ON id = entry_id WHERE k = 1
), qualifying_entry AS (
  SELECT lap_ms, driver, driver_nationality, driver_date_of_birth, constructor, constructor_nationality,
         circuit, circuit_nationality, date, first_race_date, type_circuit, {_CALENDAR}
  FROM qualified
  LEFT JOIN driver_names USING (driver_id)
  LEFT JOIN team_names USING (c_mktsegment)
  LEFT JOIN circuit_names ON c_nationkey = n_nationkey
  WHERE year(date) >= {YEAR_FROM}
), best_lap AS (
  SELECT {_QUALIFYING_ATTRIBUTES}, min(lap_ms) AS milliseconds_qualification
  FROM qualifying_entry WHERE {_all_known(_QUALIFYING_ATTRIBUTES)} GROUP BY {_QUALIFYING_ATTRIBUTES}
  HAVING min(lap_ms) <> 0
), compared AS (
  SELECT *, median(milliseconds_qualification) OVER (PARTITION BY circuit, race_year, date)
         AS exact_median FROM best_lap
), deviated AS (
  SELECT * EXCLUDE (exact_median), round_even(exact_median, 0) AS median_qualification_duration,
         round_even(milliseconds_qualification - exact_median, 0) AS deviation_from_median
  FROM compared
), finished AS (
  SELECT *, CAST(rank() OVER (PARTITION BY race_year, race_month, race_day, circuit
                              ORDER BY deviation_from_median) AS BIGINT) AS final_position
  FROM deviated WHERE deviation_from_median < 1000000
)""",
    ]
)

_CATEGORICAL = (
    "constructor, circuit, type_circuit, driver, circuit_nationality, driver_nationality, "
    "constructor_nationality, race_month, race_day, driver_home, constructor_home"
)
_FEATURES = {
    "mainrace": "qualification_position, age_at_gp_in_days, days_since_first_race, laps, race_year, rain, "
    + _CATEGORICAL,
    "qualifying": "age_at_gp_in_days, days_since_first_race, race_year, " + _CATEGORICAL,
    "status": "qualification_position, age_at_gp_in_days, days_since_first_race, race_year, rain, "
    + _CATEGORICAL,
}

# Columns as text in the order both sides are compared in; the number of
# milliseconds of a time text after the rules of the library.
CLOCK_TEXT = """
lap_text AS (
  SELECT l_orderkey, l_partkey, l_linenumber, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS ms
  FROM lineitem
), full_text AS (
  SELECT *, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0')
         || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')
         AS t FROM lap_text
), spelled AS (
  SELECT l_orderkey, l_partkey, l_linenumber,
         CASE l_linenumber % 7 WHEN 0 THEN t WHEN 1 THEN t[1:8] WHEN 2 THEN t[1:11] WHEN 3 THEN t || '000'
              WHEN 4 THEN 'x' || t WHEN 5 THEN t[1:9] ELSE t[1:6] || '60' END AS lap_time
  FROM full_text
)"""

DIM_DRIVERS = """
debut AS (SELECT o_custkey AS driver_id, min(month) AS first_race_date FROM placed GROUP BY o_custkey),
dim_driver AS (
  SELECT DISTINCT driver AS "driverRef", driver_nationality, driver_date_of_birth, first_race_date
  FROM driver_names JOIN debut USING (driver_id)
  WHERE driver_date_of_birth IS NOT NULL
)"""

REQUESTS = """
request AS (
  SELECT o_orderkey AS request_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS qualification_position,
         CAST(o_orderkey % 20 + 50 AS INTEGER) AS laps,
         CASE WHEN o_orderkey % 13 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS constructor,
         n_name AS circuit,
         CASE WHEN o_orderkey % 11 = 0 THEN 'nobody ' || lower(c_name)
              WHEN o_orderkey % 3 = 0 THEN '  ' || upper(lower(c_name)) || ' '
              ELSE lower(c_name) END AS driver,
         o_date AS race_date,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 2 AS INTEGER) END AS rain,
         o_totalprice AS score
  FROM placed JOIN nation ON c_nationkey = n_nationkey
)"""

# Pick lists of the main race decide which requests are valid.
VALID = f"""
known_driver AS (
  SELECT DISTINCT lower("driverRef") AS k FROM dim_driver
  WHERE "driverRef" IN (SELECT driver FROM race_entry)
), known_team AS (SELECT DISTINCT lower(constructor) AS k FROM race_entry),
known_circuit AS (SELECT DISTINCT lower(circuit) AS k FROM race_entry),
checked AS (
  SELECT *, coalesce(lower(trim(driver)) IN (SELECT k FROM known_driver), FALSE)
        AND coalesce(lower(trim(constructor)) IN (SELECT k FROM known_team), FALSE)
        AND coalesce(lower(trim(circuit)) IN (SELECT k FROM known_circuit), FALSE) AS valid
  FROM request
)"""
REQUEST_BASE = ",".join([RACE_BASE, DIM_DRIVERS, REQUESTS, VALID])

EXPANDED = """
expanded AS (
  SELECT request_id, score, qualification_position, laps, coalesce(rain, 0) AS rain, valid,
         CAST(date_diff('day', d.driver_date_of_birth, race_date) AS INTEGER) AS age_at_gp_in_days,
         CAST(date_diff('day', d.first_race_date, race_date) AS INTEGER) AS days_since_first_race,
         CAST(year(race_date) AS INTEGER) AS race_year, CAST(month(race_date) AS INTEGER) AS race_month,
         CAST(day(race_date) AS INTEGER) AS race_day,
         coalesce(t.constructor, trim(r.constructor)) AS constructor,
         coalesce(c.circuit, trim(r.circuit)) AS circuit,
         coalesce(d."driverRef", trim(r.driver)) AS driver,
         c.type_circuit, c.circuit_nationality, d.driver_nationality, t.constructor_nationality,
         CASE WHEN d.driver_nationality = c.circuit_nationality THEN 1 ELSE 0 END AS driver_home,
         CASE WHEN t.constructor_nationality = c.circuit_nationality THEN 1 ELSE 0 END AS constructor_home
  FROM checked r
  LEFT JOIN dim_driver d ON lower(trim(r.driver)) = lower(d."driverRef")
  LEFT JOIN team_names t ON lower(trim(r.constructor)) = lower(t.constructor)
  LEFT JOIN (SELECT * FROM circuit_names WHERE type_circuit IS NOT NULL) c
       ON lower(trim(r.circuit)) = lower(c.circuit)
)"""

FINISHES = """
finish AS (
  SELECT o_orderkey, CAST(year(month) AS INTEGER) AS race_year, CAST(month(month) AS INTEGER) AS race_month,
         1 AS race_day, n_name AS circuit, lower(c_name) AS driver, lower(c_mktsegment) AS constructor,
         CAST(o_orderkey * 7919 % 1009 AS DOUBLE) AS deviation_from_median, o_totalprice AS score
  FROM placed JOIN nation ON c_nationkey = n_nationkey
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY race_year, race_month, race_day, circuit
                         ORDER BY deviation_from_median) AS final_position,
         rank() OVER (PARTITION BY race_year, race_month, race_day, circuit
                      ORDER BY score) AS predicted_final_position
  FROM finish
), paired AS (
  SELECT p.race_year, p.race_month, p.race_day, p.circuit, p.driver, p.constructor,
         p.predicted_final_position, t.final_position
  FROM ranked p JOIN ranked t USING (race_year, race_month, race_day, circuit, driver, constructor)
), weighed AS (
  SELECT *, count(*) OVER (PARTITION BY race_year, race_month, race_day, circuit) AS entries FROM paired
), erred AS (
  SELECT *, CASE WHEN entries < 5 THEN 0.2::DOUBLE WHEN entries < 10 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
            * CASE WHEN final_position <= 5 THEN 3 WHEN final_position <= 10 THEN 2 ELSE 1 END
            * abs(final_position - predicted_final_position) AS weighted
  FROM weighed
)"""
EVALUATED = ",".join([PLACED, FINISHES])

_POSITION_ERRORS = """
SELECT round(avg(pow(final_position - predicted_final_position, 2)), 6) AS mse,
       round(sqrt(avg(pow(final_position - predicted_final_position, 2))), 6) AS rmse,
       round(1 - sum(pow(final_position - predicted_final_position, 2))
             / (sum(pow(final_position, 2)) - pow(sum(final_position), 2) / count(*)), 6) AS r2,
       round(avg(abs(final_position - predicted_final_position)), 6) AS mae
FROM paired"""

CLASSIFIED = """
classified AS (
  SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CASE WHEN value > 50 THEN 1 ELSE 0 END AS prediction, value AS score FROM events
)"""

_REPORT = """
tally AS (
  SELECT c, CAST(count(*) FILTER (label = c AND prediction = c) AS DOUBLE) AS hit,
         count(*) FILTER (prediction = c) AS said, count(*) FILTER (label = c) AS was, count(*) AS total
  FROM classified, (VALUES (0), (1)) AS classes(c) GROUP BY c
), scores AS (
  SELECT c, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS p, CASE WHEN was = 0 THEN 0 ELSE hit / was END AS r,
         CASE WHEN said + was = 0 THEN 0 ELSE 2 * hit / (said + was) END AS f, was, hit, total FROM tally
)
SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
       CAST(was AS BIGINT) AS support FROM scores
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / max(total), 6), max(total) FROM scores
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), max(total) FROM scores
UNION ALL SELECT 'weighted avg', round(sum(p * was) / sum(was), 6), round(sum(r * was) / sum(was), 6),
       round(sum(f * was) / sum(was), 6), max(total) FROM scores"""

_PICKS = {
    "mainrace": (",".join([RACE_BASE, DIM_DRIVERS]), "race_entry"),
    "status": (",".join([RACE_BASE, DIM_DRIVERS]), "race_entry"),
    "qualifying": (",".join([QUALIFYING, DIM_DRIVERS]), "qualifying_entry"),
}


def _pick_sql() -> dict[str, str]:
    out = {}
    for task, (base, entries) in _PICKS.items():
        out[f"pick_drivers_{task}"] = f"""WITH {base}
SELECT d.* FROM (SELECT DISTINCT driver FROM {entries}) LEFT JOIN dim_driver d ON driver = "driverRef" """
        out[f"pick_constructors_{task}"] = f"""WITH {base}
SELECT DISTINCT constructor AS "constructorRef", constructor_nationality FROM {entries}"""
        out[f"pick_circuits_{task}"] = f"""WITH {base}
SELECT DISTINCT circuit AS "circuitRef", circuit_nationality FROM {entries}"""
    return out


def oracle_sql() -> dict[str, str]:
    found = _plain_sql()
    # Queries whose result follows from others'.
    found["rebuilt_years"] = found["status_training"]
    found["csv_dump_training"] = found["mainrace_training"]
    found["dump_rejects"] = """
WITH written AS (
  SELECT o_orderkey AS k, o_orderkey % 107 = 0 AS short, o_orderkey % 109 = 0 AND o_orderkey % 107 <> 0 AS long,
         CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' WHEN o_orderkey % 103 = 0 THEN '""'
              WHEN o_orderkey % 127 = 0 THEN '7.0' ELSE CAST(o_custkey AS VARCHAR) END AS customer,
         CASE WHEN o_orderkey % 131 = 0 THEN '"1,5"' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price,
         CASE WHEN o_orderkey % 113 = 0 THEN strftime(o_orderdate, '%Y') || '-02-30'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
  FROM orders),
found AS (
  SELECT 'row' AS problem, CAST(NULL AS VARCHAR) AS "column",
         concat_ws(',', k, customer, price, CASE WHEN NOT short THEN day END, CASE WHEN long THEN 'more' END) AS text
  FROM written WHERE short OR long
  UNION ALL SELECT 'field', 'o_custkey', customer FROM written WHERE NOT short AND NOT long AND customer = 'n/a'
  UNION ALL SELECT 'field', 'o_totalprice', '1,5' FROM written WHERE NOT short AND NOT long AND price = '"1,5"'
  UNION ALL SELECT 'field', 'o_orderdate', day FROM written WHERE NOT short AND NOT long AND day LIKE '%-02-30')
SELECT problem, "column", text, count(*) AS rows FROM found GROUP BY ALL"""
    found["text_tables"] = "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region"
    found["options_fallback"] = f"""
SELECT "driverRef", driver_nationality, CAST(driver_date_of_birth AS VARCHAR) AS driver_date_of_birth,
       CAST(first_race_date AS VARCHAR) AS first_race_date FROM ({found["dim_driver"]})"""
    built = {"drivers": "dim_driver", "constructors": "dim_constructor", "circuits": "dim_circuit"}
    for task in ("mainrace", "qualifying", "status"):
        built |= {f"{n}_{task}": f"pick_{n}_{task}" for n in ("drivers", "constructors", "circuits")}
        built[f"training_{task}"] = f"{task}_training"
    found["built_tables"] = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM ({found[query]})" for name, query in built.items()
    )
    bucket = """CAST('0x' || substr(md5(race_year || '_' || race_month || '_' || race_day || '_' || circuit || '_42'), 1, 8)
           AS BIGINT) % 100"""
    found["planted_step"] = f"""
SELECT race_year, race_month, race_day, circuit, driver, constructor, CAST(race_year >= 1997 AS INTEGER) AS dnf
FROM ({found["status_training"]}) WHERE {bucket} < 20"""
    found["planted_forest"] = f"""
SELECT race_year, race_month, race_day, circuit, driver, constructor, CAST(CASE WHEN race_year >= 1997 THEN 5 ELSE -3 END AS DOUBLE) AS deviation
FROM ({found["qualifying_training"]}) WHERE {bucket} < 20"""
    labelled = TASKS["status"].categorical
    labels = " UNION ".join(f"SELECT {k} AS k, CAST({c} AS VARCHAR) AS label FROM fitted" for k, c in enumerate(labelled))
    joins = "\n".join(f"LEFT JOIN placed AS p{k} ON p{k}.k = {k} AND p{k}.label = CAST(t.{c} AS VARCHAR)" for k, c in enumerate(labelled))
    ones = " + ".join(f"CAST(p{k}.label IS NOT NULL AS INTEGER)" for k in range(len(labelled)))
    places = ", ".join(f"p{k}.element AS element_{c}" for k, c in enumerate(labelled))
    found["unseen_categories"] = f"""
WITH t AS ({found["status_training"]}), fitted AS (SELECT * FROM t WHERE {bucket} >= 20 AND constructor <> 'building'),
labels AS ({labels}),
placed AS (SELECT k, label, CAST({len(TASKS["status"].numeric)} + row_number() OVER (ORDER BY k, label) - 1 AS INTEGER) AS element
           FROM labels WHERE label IS NOT NULL)
SELECT t.race_year, t.race_month, t.race_day, t.circuit, t.driver, t.constructor, {ones} AS ones, {places}
FROM t {joins}"""
    found["model_invariants"] = f"""
SELECT 'main-race rows' AS fact, CAST(count(*) AS DOUBLE) AS value FROM ({found["mainrace_training"]}) WHERE {bucket} < 20
UNION ALL SELECT 'wrong ranks', 0 UNION ALL SELECT 'importance', 1
UNION ALL SELECT 'status rows', count(*) FROM ({found["status_training"]}) WHERE {bucket} < 20
UNION ALL SELECT 'percentages out of range', 0"""
    found["planted_importance"] = """
SELECT planted, by_source, CASE planted WHEN 'year' THEN 'race_year' ELSE 'constructor' END AS base_feature, CAST(1 AS DOUBLE) AS importance
FROM (VALUES ('year'), ('constructor')) AS p(planted), (VALUES (true), (false)) AS s(by_source)"""
    fold = bucket.replace("% 100", "% 5")
    found["grid_search_status"] = f"""
SELECT point, fold, count(*) AS rows, won AS best, won AS perfect, won AS all_right
FROM (SELECT CAST({fold} AS INTEGER) AS fold FROM ({found["status_training"]})), (VALUES ('one cut', false), ('tree', true)) AS p(point, won)
GROUP BY point, fold, won"""
    found["model_roundtrip"] = f"""
SELECT count(*) AS n_rows, 16 AS n_features, 'dnf' AS target, '1' AS version, 0 AS differing
FROM ({found["status_training"]}) WHERE {bucket} >= 20"""
    return found


def _plain_sql() -> dict[str, str]:
    race_keys = "race_year, race_month, race_day, circuit"
    return {
        "mainrace_training": f"""WITH {MAINRACE}
SELECT {_FEATURES['mainrace']}, deviation_from_median, final_position FROM finished""",
        "qualifying_training": f"""WITH {QUALIFYING}
SELECT {_FEATURES['qualifying']}, deviation_from_median FROM finished""",
        "status_training": f"""WITH {RACE_BASE}
SELECT {_FEATURES['status']}, CASE WHEN is_classified = 't' THEN 0 ELSE 1 END AS dnf
FROM (SELECT DISTINCT {_STATUS_ATTRIBUTES} FROM race_entry)""",
        "lap_rollup": f"""WITH {RACE_BASE}, {ROLLED}
SELECT {_RACE_ATTRIBUTES}, milliseconds_laptime, laps_count FROM rolled""",
        "lap_rollup_all_laps": f"""WITH {RACE_BASE}, per_entry AS (
  SELECT id, coalesce(sum(ms), 0) AS ms, greatest(count(ms), 1) AS n
  FROM race_entry LEFT JOIN lap ON id = entry_id GROUP BY id
)
SELECT {_RACE_ATTRIBUTES}, CAST(sum(ms) AS BIGINT) AS milliseconds_laptime, CAST(sum(n) AS BIGINT) AS laps_count
FROM race_entry JOIN per_entry USING (id) WHERE {_all_known(_RACE_ATTRIBUTES)} GROUP BY {_RACE_ATTRIBUTES}""",
        "max_laps": f"""WITH {MAINRACE}
SELECT DISTINCT {race_keys}, max_laps FROM maxed""",
        "final_duration": f"""WITH {MAINRACE}
SELECT driver, {race_keys}, is_classified, laps_completed, additional_laps, race_duration,
       round(final_race_duration, 6) AS final_race_duration FROM extended""",
        "best_lap": f"""WITH {QUALIFYING}
SELECT {_QUALIFYING_ATTRIBUTES}, milliseconds_qualification FROM best_lap""",
        "race_median": f"""WITH {QUALIFYING}
SELECT {race_keys}, median(milliseconds_qualification) AS median_qualification_duration
FROM best_lap GROUP BY {race_keys}""",
        "final_position": f"""WITH {QUALIFYING}
SELECT driver, constructor, {race_keys}, deviation_from_median, final_position FROM finished""",
        "time_to_ms": f"""WITH {CLOCK_TEXT}
SELECT l_orderkey, l_partkey, l_linenumber, lap_time,
       CASE WHEN regexp_full_match(lap_time, '([01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9](\\.[0-9]*)?') THEN
         CAST(split_part(split_part(lap_time, '.', 1), ':', 1) AS BIGINT) * 3600000
         + CAST(split_part(split_part(lap_time, '.', 1), ':', 2) AS BIGINT) * 60000
         + CAST(split_part(split_part(lap_time, '.', 1), ':', 3) AS BIGINT) * 1000
         + CAST(CASE WHEN length(split_part(lap_time, '.', 2)) < 3
                     THEN rpad(split_part(lap_time, '.', 2), 3, '0')
                     ELSE split_part(lap_time, '.', 2) END AS BIGINT) END AS ms
FROM spelled""",
        "days_between": """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS days_apart,
       CAST(date_diff('day', l_shipdate, o_orderdate) AS INTEGER) AS signed_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "home_flags": f"""WITH {PLACED}, {NAMES}
SELECT o_orderkey, CASE WHEN driver_nationality = circuit_nationality THEN 1 ELSE 0 END AS driver_home,
       CASE WHEN constructor_nationality = circuit_nationality THEN 1 ELSE 0 END AS constructor_home
FROM placed JOIN driver_names ON o_custkey = driver_id JOIN team_names USING (c_mktsegment)
JOIN circuit_names ON c_nationkey = n_nationkey""",
        "rain_flag": f"""WITH {WEATHER}
SELECT date, weather, CASE WHEN weather IN ('Rain', 'Changeable', 'Very changeable') THEN 1 ELSE 0 END AS rain
FROM weather""",
        "dnf_label": """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 AND o_orderstatus <> 'P' THEN 0 ELSE 1 END AS dnf FROM orders""",
        "round_half_even": """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half,
       round_even(l_extendedprice, 0) AS price FROM lineitem""",
        "race_id": f"""WITH {PLACED}
SELECT o_orderkey, year(month) || '_' || month(month) || '_' || day(month) || '_' || n_name AS race_id
FROM placed JOIN nation ON c_nationkey = n_nationkey""",
        "lenient_cast": """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1 + o_orderkey % 2) AS DOUBLE) AS grid FROM orders""",
        "denormalize": f"""WITH {PLACED}, {NAMES}, {SESSION_ENTRIES}, rounds AS (
  SELECT DISTINCT round_id, c_nationkey, month FROM placed
), sessions AS (
  SELECT round_id, n, c_nationkey, month, round_id * 10 + n AS session_id,
         CASE n WHEN 0 THEN 'R' WHEN 1 THEN 'Q1' ELSE 'Q2' END AS type
  FROM rounds, (VALUES (0), (1), (2)) AS kinds(n)
), wide AS (
  SELECT s.session_id, s.round_id, s.type, p.o_orderkey AS round_entry_id, p.o_custkey AS driver_id,
         p.c_mktsegment, s.c_nationkey, e.id AS session_entry_id
  FROM sessions s LEFT JOIN placed p USING (round_id)
  LEFT JOIN session_entry e ON e.o_orderkey = p.o_orderkey AND e.session_no = s.n
)
SELECT session_id, round_id, type, round_entry_id, session_entry_id, driver, driver_nationality, constructor,
       circuit, ms AS lap_ms
FROM wide LEFT JOIN driver_names USING (driver_id) LEFT JOIN team_names USING (c_mktsegment)
LEFT JOIN circuit_names ON c_nationkey = n_nationkey LEFT JOIN lap ON session_entry_id = entry_id""",
        "race_sessions": f"""WITH {PLACED}, {SESSION_ENTRIES}
SELECT id AS session_entry_id, round_id, driver_id, month AS round_date, is_classified FROM held WHERE k = 0""",
        "qualifying_sessions": f"""WITH {PLACED}, {SESSION_ENTRIES}
SELECT id AS session_entry_id, round_id, driver_id, date AS session_date FROM held WHERE k = 1""",
        "first_race_date": f"""WITH {PLACED}, {SESSION_ENTRIES}
SELECT driver_id, min(date) AS first_race_date FROM held WHERE k = 0 AND is_classified IS NOT NULL
GROUP BY driver_id""",
        "weather_join": f"""WITH {PLACED}, {WEATHER}, {SESSION_ENTRIES}
SELECT id AS session_entry_id, date, CASE WHEN weather = 'Dry' THEN 0 ELSE 1 END AS rain
FROM held JOIN weather USING (date) WHERE k = 0""",
        "circuit_type_join": f"""WITH {PLACED}, {NAMES}
SELECT o_orderkey, circuit, type_circuit FROM placed JOIN circuit_names ON c_nationkey = n_nationkey""",
        "distinct_entries": f"""WITH {RACE_BASE}
SELECT DISTINCT {_STATUS_ATTRIBUTES} FROM race_entry""",
        "dim_driver": f"""WITH {PLACED}, {NAMES}, {DIM_DRIVERS} SELECT * FROM dim_driver""",
        "dim_constructor": f"""WITH {NAMES}
SELECT DISTINCT constructor AS "constructorRef", constructor_nationality FROM team_names""",
        "dim_circuit": f"""WITH {NAMES}
SELECT DISTINCT circuit AS "circuitRef", circuit_nationality, type_circuit FROM circuit_names
WHERE type_circuit IS NOT NULL""",
        **_pick_sql(),
        "validate_requests": f"""WITH {REQUEST_BASE}
SELECT request_id, driver, constructor, circuit, valid FROM checked""",
        "accepted_requests": f"""WITH {REQUEST_BASE}
SELECT request_id, driver, constructor, circuit FROM checked WHERE valid""",
        "rejected_requests": f"""WITH {REQUEST_BASE}
SELECT request_id, driver, constructor, circuit FROM checked WHERE NOT valid""",
        **{
            f"expand_features_{task}": f"""WITH {REQUEST_BASE}, {EXPANDED}
SELECT request_id, score, {columns} FROM expanded"""
            for task, columns in _FEATURES.items()
        },
        "stream_expand_features": f"""WITH {REQUEST_BASE}, {EXPANDED}
SELECT request_id, score, {_FEATURES['mainrace']} FROM expanded WHERE valid""",
        "stream_predict_rank": f"""WITH {REQUEST_BASE}, {EXPANDED}
SELECT request_id, request_id % 4 AS list_id, {race_keys}, score AS predicted_deviation_from_median,
       rank() OVER (PARTITION BY request_id % 4, {race_keys} ORDER BY score) AS predicted_final_position
FROM expanded WHERE valid""",
        "stream_lists_over_files": f"""WITH {REQUEST_BASE}, {EXPANDED}
SELECT request_id, request_id % 4 AS list_id, {race_keys}, score AS predicted_deviation_from_median,
       rank() OVER (PARTITION BY request_id % 4, {race_keys} ORDER BY score) AS predicted_final_position
FROM expanded WHERE valid AND request_id % 4 < 3""",
        "stream_waiting_lists": f"""WITH {REQUEST_BASE}
SELECT request_id % 4 AS list_id, count(*) AS rows, count(*) + 1 AS wanted FROM checked WHERE request_id % 4 = 3 GROUP BY 1""",
        "stream_restart": f"""WITH {REQUEST_BASE}
SELECT request_id % 4 AS list_id, count(*) AS n_rows, 0 AS differing FROM checked WHERE valid AND request_id % 4 < 3 GROUP BY 1""",
        "checked_fail_fast": f"""WITH {REQUEST_BASE}
SELECT request_id, driver, constructor, circuit FROM checked WHERE valid""",
        "nested_answers": f"""WITH {REQUEST_BASE}, {EXPANDED}
SELECT e.request_id, r.driver AS asked_driver, e.driver, e.circuit, e.score AS predicted_deviation_from_median,
       rank() OVER (PARTITION BY e.race_year, e.race_month, e.race_day, e.circuit ORDER BY e.score)
         AS predicted_final_position
FROM expanded e JOIN request r USING (request_id) WHERE valid""",
        "expand_with_requested_type": f"""WITH {REQUEST_BASE}, {EXPANDED}
SELECT request_id, circuit, coalesce(type_circuit, 'street') AS type_circuit FROM expanded""",
        "rank_predictions": f"""WITH {EVALUATED}
SELECT o_orderkey, {race_keys}, score AS predicted_deviation_from_median,
       CAST(predicted_final_position AS BIGINT) AS predicted_final_position FROM ranked""",
        "rank_global": """
SELECT o_orderkey, o_totalprice AS predicted_deviation_from_median,
       CAST(rank() OVER (ORDER BY o_totalprice) AS BIGINT) AS predicted_final_position FROM orders""",
        "true_positions": f"""WITH {EVALUATED}
SELECT o_orderkey, {race_keys}, CAST(final_position AS BIGINT) AS final_position FROM ranked""",
        "joined_positions": f"""WITH {EVALUATED}
SELECT {race_keys}, driver, constructor, CAST(predicted_final_position AS BIGINT) AS predicted_final_position,
       CAST(final_position AS BIGINT) AS final_position FROM paired
JOIN (SELECT {race_keys}, driver, constructor FROM finish GROUP BY ALL HAVING count(*) = 1)
     USING ({race_keys}, driver, constructor)""",
        "rejected_cars": f"""WITH {EVALUATED}
SELECT {race_keys}, driver, constructor, count(*) AS predicted_rows, count(*) AS true_rows
FROM finish GROUP BY ALL HAVING count(*) > 1""",
        "duplicate_cars": f"""WITH {EVALUATED}
SELECT {race_keys}, driver, constructor, count(*) AS rows FROM finish GROUP BY ALL HAVING count(*) > 1""",
        "pair_sums": f"""WITH {EVALUATED}
SELECT {race_keys}, driver, constructor, final_position, CAST(count(*) AS DECIMAL(38, 0)) AS pairs,
       CAST(sum(abs(final_position - predicted_final_position)) AS DECIMAL(38, 0)) AS absolute_error,
       CAST(sum((final_position - predicted_final_position) * (final_position - predicted_final_position))
         AS DECIMAL(38, 0)) AS squared_error
FROM paired GROUP BY ALL""",
        "regression_errors": """
WITH both_sides AS (
  SELECT floor(l_extendedprice + 0.5) AS t, floor(l_quantity * 1500) AS p FROM lineitem
)
SELECT round(avg((t - p) * (t - p)), 6) AS mse, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse,
       round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2, round(avg(abs(t - p)), 6) AS mae
FROM both_sides""",
        "position_errors": f"WITH {EVALUATED} {_POSITION_ERRORS}",
        "position_errors_top5": f"WITH {EVALUATED} {_POSITION_ERRORS} WHERE final_position <= 5",
        "weighted_position_error": f"""WITH {EVALUATED}
SELECT round(avg(weighted), 6) AS weighted_position_error FROM erred""",
        "top5_weighted_error": f"""WITH {EVALUATED}
SELECT round(avg(weighted), 6) AS weighted_position_error FROM erred WHERE final_position <= 5""",
        "race_weights": f"""WITH {EVALUATED}
SELECT {race_keys}, count(*) AS entries,
       CASE WHEN count(*) < 5 THEN 0.2::DOUBLE WHEN count(*) < 10 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS race_weight
FROM finish GROUP BY ALL""",
        "top5_finishers": f"""WITH {EVALUATED}
SELECT o_orderkey, {race_keys}, CAST(final_position AS BIGINT) AS final_position,
       CASE WHEN final_position <= 5 THEN 3 WHEN final_position <= 10 THEN 2 ELSE 1 END AS position_weight
FROM ranked WHERE final_position <= 5""",
        "confusion_matrix": f"""WITH {CLASSIFIED}
SELECT label, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1
FROM classified GROUP BY label""",
        "classification_report": f"WITH {CLASSIFIED}, {_REPORT}",
        "roc_auc": f"""WITH {CLASSIFIED}, placed_scores AS (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r
  FROM classified
)
SELECT round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2)
             / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc FROM placed_scores""",
        "auc_by_model": f"""WITH {CLASSIFIED}, long AS (
  SELECT label, unnest([{{'m': 'given', 'v': score}}, {{'m': 'turned', 'v': -score}}, {{'m': 'tied', 'v': floor(score / 10)}}], recursive := true) FROM classified
), placed_scores AS (
  SELECT m, label, rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2.0::DOUBLE AS r FROM long
)
SELECT m AS model, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2)
             / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc FROM placed_scores GROUP BY m""",
        "null_profile": f"""WITH {RACE_BASE} """
        + " UNION ALL ".join(
            f"SELECT '{c.strip()}' AS column_name, count(*) FILTER ({c.strip()} IS NULL) AS nulls FROM race_entry"
            for c in _RACE_ATTRIBUTES.split(",")
        ),
        "null_key_rows": f"""WITH {RACE_BASE} """
        + " UNION ALL ".join(
            f"SELECT '{c.strip()}' AS column_name, count(*) FILTER ({c.strip()} IS NULL) AS nulls FROM race_entry"
            for c in _RACE_ATTRIBUTES.split(",")
        )
        + f" UNION ALL SELECT 'any_key', count(*) FILTER (NOT ({_all_known(_RACE_ATTRIBUTES)})) FROM race_entry",
        "duplicate_dates": f"""WITH {PLACED}
SELECT CAST(year(o_date) AS INTEGER) AS race_year, CAST(month(o_date) AS INTEGER) AS race_month, n_name AS circuit,
       count(DISTINCT o_date) AS dates
FROM placed JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(DISTINCT o_date) > 1""",
        "unique_values": "SELECT DISTINCT lower(c_mktsegment) AS constructor FROM customer",
        "latest_rows": """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""",
        "sorted_by_date": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
       row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS place FROM orders""",
        "sorted_importances": f"""WITH {PLACED}
SELECT n_name AS feature, round(sum(o_totalprice), 2) AS importance,
       row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) - 1 AS place
FROM placed JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
        "group_statistics_with_gaps": f"""WITH {EVALUATED}, gapped AS (
  SELECT *, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN score END AS v FROM finish
)
SELECT o_orderkey, max(v) OVER race AS top, round(median(v) OVER race, 4) AS middle,
       CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY {race_keys} ORDER BY v NULLS LAST) END AS place
FROM gapped WINDOW race AS (PARTITION BY {race_keys})""",
        "race_split": f"""WITH {EVALUATED}, keyed AS (
  SELECT o_orderkey, race_year || '_' || race_month || '_' || race_day || '_' || circuit AS race_id FROM finish
)
SELECT o_orderkey, race_id, CAST('0x' || substr(md5(race_id || '_42'), 1, 8) AS BIGINT) % 100 AS bucket FROM keyed""",
        "race_split_train": f"""WITH {EVALUATED}
SELECT o_orderkey, {race_keys} FROM finish
WHERE CAST('0x' || substr(md5(race_year || '_' || race_month || '_' || race_day || '_' || circuit || '_42'), 1, 8)
           AS BIGINT) % 100 >= 20""",
        "race_split_by_ids": f"""WITH {EVALUATED}
SELECT o_orderkey, {race_keys}, CASE WHEN race_year >= 2000 THEN 'test' ELSE 'train' END AS side FROM finish""",
        "row_split_test": """
SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(o_orderkey || '|' || o_custkey || '_42'), 1, 8) AS BIGINT) % 100 < 20
       THEN 'test' ELSE 'train' END AS side FROM orders""",
        "robust_scaled": """
WITH q AS (
  SELECT quantile_cont(l_quantity, 0.5) AS qm, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qw,
         quantile_cont(l_linenumber, 0.5) AS nm,
         quantile_cont(l_linenumber, 0.75) - quantile_cont(l_linenumber, 0.25) AS nw FROM lineitem
)
SELECT l_orderkey, l_partkey, round((l_quantity - qm) / qw, 6) AS l_quantity,
       round((l_linenumber - nm) / nw, 6) AS l_linenumber FROM lineitem, q""",
        "training_roundtrip": f"""WITH {RACE_BASE}
SELECT {_FEATURES['status']}, CASE WHEN is_classified = 't' THEN 0 ELSE 1 END AS dnf
FROM (SELECT DISTINCT {_STATUS_ATTRIBUTES} FROM race_entry) WHERE race_year >= 1999""",
        "options_roundtrip": f"""WITH {RACE_BASE}, {DIM_DRIVERS}
SELECT coalesce("driverRef", '') AS "driverRef", coalesce(driver_nationality, '') AS driver_nationality,
       coalesce(CAST(driver_date_of_birth AS VARCHAR), '') AS driver_date_of_birth,
       coalesce(CAST(first_race_date AS VARCHAR), '') AS first_race_date
FROM (SELECT DISTINCT driver FROM race_entry) LEFT JOIN dim_driver ON driver = "driverRef" """,
        "race_tables_export": f"""WITH {MAINRACE}
SELECT DISTINCT driver, driver_date_of_birth, first_race_date, driver_nationality FROM finished""",
    }
