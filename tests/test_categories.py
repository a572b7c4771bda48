import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from test_learning import training  # noqa: F401

from apexframe.learning import categories, inspect, pipelines
from apexframe.plans import scoring
from apexframe.schemas import TASKS
from apexframe.sources import models


def test_places_follow_the_order_of_labels(spark):
    rows = spark.createDataFrame([("b", 10), ("a", 9), (None, 10), ("b", None), ("", 9)], "x string, y int")
    known = categories.dictionary(rows, ["x", "y"])
    assert sorted(map(tuple, known.table.collect())) == [("x", "", 0), ("x", "a", 1), ("x", "b", 2), ("y", "10", 0), ("y", "9", 1)]
    assert known.sizes == {"x": 3, "y": 2} and known.width == 5
    served = spark.createDataFrame([("b", 9), ("new", 9), (None, None)], "x string, y int")
    got = categories.elements(served, known, 4).select("element_x", "element_y").collect()
    assert sorted(map(tuple, got), key=str) == [(6, 8), (None, 8), (None, None)]


def test_no_rows(spark):
    known = categories.dictionary(spark.createDataFrame([], "x string"), ["x"])
    assert known.sizes == {"x": 0} and known.table.count() == 0
    served = categories.encode(spark.createDataFrame([("a", 3)], "x string, v int"), known, {"v": (1.0, 2.0)})
    assert list(served.first().features.toArray()) == [1.0]


def test_vectors_equal_the_pipelines(training):  # noqa: F811
    task = TASKS["status"]
    scales = pipelines.robust_scales(training, task.numeric)
    stages = pipelines.build_pipeline("status", scales=scales).getStages()[:-1]
    served = training.withColumn("driver", F.when(F.col("laps") > 60, F.lit("nobody")).otherwise(F.col("driver")))
    served = served.withColumn("constructor", F.when(F.col("laps") < 53, F.lit(None)).otherwise(F.col("constructor")))
    wanted = Pipeline(stages=stages).fit(training).transform(served)
    got = categories.encode(served, categories.dictionary(training, task.categorical), scales)

    def vectors(df):
        return {r.days_since_first_race: list(r.v) for r in df.select("days_since_first_race", vector_to_array("features").alias("v")).collect()}

    assert vectors(got) == vectors(wanted)
    assert "features" in got.columns and [c for c in got.columns if c.startswith(("element_", "_"))] == []


@pytest.mark.parametrize("task, estimator, settings", [("status", "logistic", {"maxIter": 10}), ("mainrace", "gbt", {"maxIter": 2, "maxDepth": 3})])
def test_predicts_as_the_pipeline_does(training, task, estimator, settings):  # noqa: F811
    tabled = categories.fit(training, task, estimator, **settings)
    piped = pipelines.fit(training, task, estimator, **settings)
    served = training.withColumn("driver", F.lit("nobody"))
    totals = []
    for model in (tabled, piped):
        scored = scoring.predict(served, model)
        totals.append(scored.agg(F.sum(scoring.PREDICTED), F.count(F.lit(1))).first())
    assert totals[0][1] == totals[1][1] == 400
    assert totals[0][0] == pytest.approx(totals[1][0], rel=1e-6)


def test_many_labels_leave_no_list_in_the_driver(spark):
    rows = spark.range(300_000).select(F.concat(F.lit("label "), F.col("id")).alias("x"), (F.col("id") % 7).alias("v"))
    known = categories.dictionary(rows, ["x"])
    encoded = categories.encode(rows, known, {"v": (0.0, 1.0)})
    assert known.width == 300_000 and not encoded.schema["features"].metadata
    assert known.table.agg(F.countDistinct("place"), F.min("place"), F.max("place")).first() == (300_000, 0, 299_999)
    assert encoded.first().features.size == 300_001


def test_wide_models_keep_no_labels(spark, training, monkeypatch, tmp_path):  # noqa: F811
    """Labels of a wide fit stand in a table, in the model, in its file and for its importances."""
    narrow = pipelines.fit(training, "mainrace", maxIter=2, maxDepth=3)
    monkeypatch.setattr(pipelines, "DENSE_CELLS", 0)
    monkeypatch.setattr(categories, "SENT_LABELS", 2)
    wide = pipelines.fit(training, "mainrace", maxIter=2, maxDepth=3)
    assert not any(hasattr(s, "labelsArray") for s in wide.stages)
    models.save(wide, models.describe(training, "mainrace"), str(tmp_path / "m"))
    loaded, _ = models.load(spark, str(tmp_path / "m"))
    served = training.withColumn("driver", F.when(F.col("laps") > 60, "nobody").when(F.col("laps") > 55, F.col("driver")))
    said = [sorted(r[0] for r in scoring.predict(served, m).select(F.round(scoring.PREDICTED, 6)).collect()) for m in (narrow, wide, loaded)]
    assert said[0] == said[1] == said[2]
    names = [inspect.element_names(spark, m, "mainrace").collect() for m in (narrow, loaded)]
    assert sorted(names[0]) == sorted(names[1]) and inspect.feature_names(wide, "mainrace") == inspect.feature_names(narrow, "mainrace")
    monkeypatch.setattr(inspect, "feature_names", None)
    shares = [{r.feature: round(r.importance, 6) for r in inspect.importance(m, "mainrace", training).collect()} for m in (wide, loaded)]
    assert shares[0] == shares[1] and sum(shares[0].values()) == pytest.approx(1, abs=1e-4)
