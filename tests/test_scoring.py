from datetime import date

import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from apexframe.operators import lookup
from apexframe.plans import scoring
from apexframe.schemas import RACE, REQUESTS, TASKS, struct
from apexframe.session import stage
from apexframe.streaming import scoring as stream


@pytest.fixture(scope="module")
def dims(spark):
    text = "driverRef string, driver_nationality string, driver_date_of_birth string, first_race_date string"
    return {
        "drivers": spark.createDataFrame(
            [("hamilton", "GBR", "1985-01-07", "2007-03-18"), ("Hamilton", "XXX", "1900-01-01", "1950-01-01"),
             ("mystery", None, None, "bad date")],
            text,
        ),
        "constructors": spark.createDataFrame(
            [("ferrari", "ITA")], "constructorRef string, constructor_nationality string"
        ),
        "circuits": spark.createDataFrame(
            [("silverstone", "GBR", "Race circuit"), ("street", "MCO", "")],
            "circuitRef string, circuit_nationality string, type_circuit string",
        ),
    }


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), struct(REQUESTS["mainrace"]))


def request(driver="hamilton", constructor="ferrari", circuit="silverstone", rain=0):
    return (10, 58, constructor, circuit, driver, date(2023, 7, 14), rain)


def test_expand(spark, dims):
    row = lookup.expand(requests(spark, request()), {**dims, "drivers": dims["drivers"].limit(1)}, "mainrace").first()
    assert row.age_at_gp_in_days == 14067
    assert (row.driver_nationality, row.circuit_nationality, row.constructor_nationality) == ("GBR", "GBR", "ITA")
    assert (row.driver_home, row.constructor_home, row.rain, row.race_month) == (1, 0, 0, 7)
    assert row.type_circuit == "Race circuit"
    for task, width in (("mainrace", 17), ("qualifying", 14), ("status", 16)):
        assert len(TASKS[task].features) == width
        assert lookup.expand(requests(spark, request()), dims, task).columns == list(TASKS[task].features)


def test_expand_edge_cases(spark, dims):
    rows = requests(spark, request("  HAMILTON ", rain=None), request("mystery", circuit="street"))
    plain = lookup.expand(rows, dims, "mainrace").collect()
    # Two spellings of one reference: the least row is taken, for every request.
    assert plain[0].driver == "Hamilton" and plain[0].rain == 0
    assert lookup.expand(rows, dims, "mainrace", faithful_case=True).first().driver == "HAMILTON"
    assert plain[1].age_at_gp_in_days is None and plain[1].days_since_first_race is None
    assert plain[1].type_circuit is None and plain[1].driver_home == 0
    typed = lookup.expand(rows.withColumn("type_circuit", F.lit("Street circuit")), dims, "mainrace").collect()
    assert [r.type_circuit for r in typed] == ["Race circuit", "Street circuit"]


def test_days_keep_their_sign(spark, dims):
    early = requests(spark, (1, 1, "ferrari", "silverstone", "hamilton", date(1890, 1, 1), 0))
    assert lookup.expand(early, dims, "mainrace").first().age_at_gp_in_days < 0


def test_full_name_fallback(spark, dims):
    named = dims["drivers"].limit(1).withColumns({"forename": F.lit("Lewis"), "surname": F.lit("Hamilton")})
    row = lookup.expand(requests(spark, request("lewis hamilton")), {**dims, "drivers": named}, "mainrace").first()
    assert (row.driver, row.driver_nationality) == ("hamilton", "GBR")


def test_validity(spark, dims):
    rows = requests(spark, request(" Hamilton"), request("nobody"), request(constructor="lotus"), request(None))
    valid = lookup.with_validity(rows, dims).collect()
    assert sorted((r.driver or "", r.constructor, r.valid) for r in valid) == [
        ("", "ferrari", False), (" Hamilton", "ferrari", True), ("hamilton", "lotus", False),
        ("nobody", "ferrari", False),
    ]
    assert lookup.accepted(rows, dims).count() == 1
    assert lookup.rejected(rows, dims).count() == 3
    good, bad = scoring.expand_valid(rows, dims, dims, "mainrace")
    assert (good.count(), bad.count()) == (1, 3)
    with pytest.raises(Exception, match="pick lists"):
        scoring.expand_valid(rows, dims, dims, "mainrace", fail_fast=True)[0].collect()
    assert lookup.insist_valid(requests(spark, request()), dims).count() == 1


BATCH = [
    (2023, 7, 14, "silverstone", 10, 3),
    (2023, 7, 14, "silverstone", 5, 2),
    (2023, 7, 14, "silverstone", 1, 1),
    (2023, 8, 20, "yas_marina", 2, 1),
    (2023, 8, 20, "yas_marina", 4, 2),
]
BATCH_DDL = "race_year int, race_month int, race_day int, circuit string, qualification_position int, expected int"


def test_rank_per_race(spark):
    df = spark.createDataFrame(BATCH, BATCH_DDL)
    # Any transformer that adds a prediction will do as a model.
    model = SQLTransformer(statement="SELECT *, double(qualification_position) AS prediction FROM __THIS__")
    ranked = scoring.predict_and_rank(df, model).collect()
    assert all(r[scoring.POSITION] == r.expected for r in ranked)
    assert all(r[scoring.PREDICTED] == float(r.qualification_position) for r in ranked)


def test_rank_over_everything(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "qualification_position int")
    ranked = scoring.predict_and_rank(df, "qualification_position").collect()
    assert all(r[scoring.POSITION] == r.qualification_position for r in ranked)


def test_responses(spark, dims):
    rows = lookup.expand(requests(spark, request("HAMILTON")), dims, "mainrace", keep_input=True)
    scored = scoring.predict_and_rank(rows, "laps")
    meta = spark.createDataFrame([(5, "deviation_from_median")], "n_rows long, target string")
    row = scoring.responses(scored, "mainrace", meta).first()
    assert row.input.driver == "HAMILTON" and row.features.driver == "Hamilton"
    assert row[scoring.PREDICTED] == 58.0 and row[scoring.POSITION] == 1
    assert row.model_meta.n_rows == 5


def test_stream_equals_batch(spark, dims, tmp_path):
    rows = requests(spark, request(), request("nobody"), (3, 40, "ferrari", "silverstone", "hamilton", date(2023, 7, 14), 1))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    static = {k: stage(v) for k, v in dims.items()}
    incoming = stream.read_requests(spark, str(tmp_path / "in"), "mainrace")
    features = stream.expanded_stream(incoming, static, static, "mainrace")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    query = stream.score_stream(features, write, "laps", str(tmp_path / "marks"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    good, _ = scoring.expand_valid(rows, dims, dims, "mainrace")
    want = scoring.predict_and_rank(good, "laps")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    assert set(RACE) <= set(got.columns)


def test_names_are_prepared_before_they_are_looked_up(spark, dims):
    """A sort by an expression would evaluate it anew in every comparison."""
    rows = requests(spark, request("  HAMILTON "), request("nobody"), request(None))
    picks = dims
    found = {
        "validity": lookup.with_validity(rows, picks),
        "accepted": lookup.accepted(rows, picks),
        "expanded": lookup.expand(rows, dims, "mainrace"),
    }
    for name, df in found.items():
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
        assert joins and not any("regexp_replace(" in x or "lower(" in x for x in joins), name
    assert [r.valid for r in found["validity"].select("driver", "valid").orderBy("driver").collect()] == [False, True, False]
    assert found["accepted"].columns == rows.columns and found["accepted"].count() == 1
