import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from apexframe.learning import forests, inspect, nodes, pipelines
from apexframe.sources import models
from test_learning import training  # noqa: F401

DEEP = {"numTrees": 7, "maxDepth": 30}


@pytest.mark.parametrize("trees, part, sizes", [(7, 3, [3, 2, 2]), (800, 50, [50] * 16), (1, 50, [1]), (51, 50, [26, 25])])
def test_part_sizes(trees, part, sizes):
    assert forests.part_sizes(trees, part) == sizes


def test_no_trees():
    with pytest.raises(ValueError):
        forests.part_sizes(0, 5)


@pytest.mark.parametrize("task, kind", [("mainrace", RandomForestRegressionModel), ("status", RandomForestClassificationModel)])
def test_merged_forest_is_the_mean_of_its_parts(spark, training, tmp_path, task, kind):  # noqa: F811
    folder = str(tmp_path / task)
    model = forests.fit_in_parts(training, task, folder, part_trees=3, **DEEP)
    whole, parts = model.stages[-1], [kind.load(f"{folder}/part-{k}") for k in range(3)]
    assert whole.getNumTrees == 7 and [p.getNumTrees for p in parts] == [3, 2, 2]
    assert whole.totalNumNodes == sum(p.totalNumNodes for p in parts) and whole.numFeatures == parts[0].numFeatures
    rows = PreparedRows(model, training)
    got = rows.scores(whole)
    each = [rows.scores(p) for p in parts]
    for i, score in enumerate(got):
        assert score == pytest.approx(sum(n * own[i] for n, own in zip((3, 2, 2), each)) / 7)
    # No two parts grow the same trees.
    assert each[1] != each[2]
    shares = {r.feature: r.importance for r in nodes.node_importance(nodes.node_table(spark, whole), True).collect()}
    assert max(abs(shares.get(k, 0) - w) for k, w in enumerate(whole.featureImportances.toArray())) < 1e-9
    assert inspect.importance(model, task, training).count() > 0


class PreparedRows:
    """Rows as vectors in a fixed order, and what a forest says of them."""

    def __init__(self, model, rows):
        for s in model.stages[:-1]:
            rows = s.transform(rows)
        self.rows = rows.select("days_since_first_race", "features").cache()

    def scores(self, forest):
        scored = forest.transform(self.rows)
        value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        return [r.v for r in scored.orderBy("days_since_first_race").select(value.alias("v")).collect()]


def test_a_lost_fit_goes_on(spark, training, tmp_path, monkeypatch):  # noqa: F811
    folder, straight = str(tmp_path / "lost"), str(tmp_path / "straight")
    assert forests.fit_parts(training, "mainrace", folder, part_trees=3, at_most=1, **DEEP) == (1, 3)
    # The second part is saved, but the fit ends before its record.
    record = forests._record

    def lost(spark, folder, name, text):
        raise KeyboardInterrupt

    monkeypatch.setattr(forests, "_record", lost)
    with pytest.raises(KeyboardInterrupt):
        forests.fit_parts(training, "mainrace", folder, part_trees=3, **DEEP)
    recorded = []
    monkeypatch.setattr(forests, "_record", lambda *a: (recorded.append(a[2]), record(*a)))
    model = forests.fit_in_parts(training, "mainrace", folder, part_trees=3, **DEEP)
    assert recorded == ["part-1", "part-2"]
    monkeypatch.setattr(forests, "_record", record)
    other = forests.fit_in_parts(training.repartition(3), "mainrace", straight, part_trees=3, **DEEP)
    assert model.stages[-1].getNumTrees == other.stages[-1].getNumTrees == 7
    assert forests.fit_parts(training, "mainrace", folder, part_trees=3, **DEEP) == (3, 3)


def test_other_rows_or_settings_are_an_error(training, tmp_path):  # noqa: F811
    folder = str(tmp_path / "own")
    forests.fit_parts(training, "mainrace", folder, part_trees=3, at_most=0, **DEEP)
    for rows, settings in ((training.limit(300), DEEP), (training, {**DEEP, "maxDepth": 5})):
        with pytest.raises(ValueError, match="other rows or settings"):
            forests.fit_parts(rows, "mainrace", folder, part_trees=3, **settings)


def test_forests_of_other_features_dont_merge(spark, training, tmp_path):  # noqa: F811
    few = {"numTrees": 2, "maxDepth": 2}
    for name, rows in (("a", training), ("b", training.filter("driver <> 'driver1'"))):
        pipelines.fit(rows, "mainrace", "forest", **few).stages[-1].write().save(str(tmp_path / name))
    with pytest.raises(ValueError, match="numFeatures"):
        forests.merge_forests(spark, [str(tmp_path / "a"), str(tmp_path / "b")], False)


def test_saved_like_any_pipeline(spark, training, tmp_path):  # noqa: F811
    model = forests.fit_in_parts(training, "status", str(tmp_path / "f"), part_trees=3, numTrees=4, maxDepth=4)
    models.save(model, models.describe(training, "status"), str(tmp_path / "m"))
    loaded, _ = models.load(spark, str(tmp_path / "m"))
    a, b = (m.transform(training).agg(F.sum(vector_to_array("probability")[1])).first()[0] for m in (model, loaded))
    assert a == b
