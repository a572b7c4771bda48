"""Trees on rows that aren't widened, against Spark's own learners."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from apexframe.learning import forests, nodes, pipelines, search, trees
from test_learning import FEW, training  # noqa: F401


def _scores(model, rows):
    scored = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return [r.v for r in scored.select("driver", "race_year", "days_since_first_race", value.alias("v")).orderBy("days_since_first_race", "driver", "race_year", "v").collect()]


@pytest.mark.parametrize("task", ["mainrace", "status"])
def test_wide_rows_give_the_same_boosted_trees(spark, training, monkeypatch, task):  # noqa: F811
    narrow = pipelines.fit(training, task, **FEW)
    monkeypatch.setattr(pipelines, "DENSE_CELLS", 0)
    wide = pipelines.fit(training, task, **FEW)
    assert _scores(wide, training) == pytest.approx(_scores(narrow, training))
    a, b = (m.stages[-1].featureImportances.toArray() for m in (narrow, wide))
    assert abs(a - b).max() < 1e-6
    tables = [nodes.node_table(spark, m.stages[-1]).where("feature IS NOT NULL").count() for m in (narrow, wide)]
    assert tables[0] == tables[1]


def test_wide_rows_stay_narrow(spark, training, monkeypatch):  # noqa: F811
    """No pass over the rows reads vectors or the names of their elements."""
    monkeypatch.setattr(pipelines, "DENSE_CELLS", 0)
    seen = []
    monkeypatch.setattr(trees, "fit", lambda last, rows, *sizes: seen.append((rows, sizes)))
    task, rows = "status", pipelines.usable(training, "status").cache()
    prepared = pipelines.Pipeline(stages=pipelines.build_pipeline(task, scales=pipelines.robust_scales(rows, pipelines.TASKS[task].numeric)).getStages()[:-1]).fit(rows)
    laid = pipelines.laid_out(prepared, rows, task)
    pipelines.fit_last(pipelines.learner(task, **FEW), laid, task)
    (table, (numbers, size)), = seen
    assert numbers == 4 and table.first()["features"].size == size
    assert max(r.n for r in table.select((F.size("numbers") + F.size("ones")).alias("n")).collect()) <= 4 + 12
    assert table.schema["features"].metadata == {"ml_attr": {"num_attrs": size}}
    of = [set(r.ones) | set(range(4)) >= {k for k, x in enumerate(r.features) if x} for r in table.collect()]
    assert all(of)


@pytest.mark.parametrize("task", ["qualifying", "status"])
def test_wide_forest(spark, training, monkeypatch, tmp_path, task):  # noqa: F811
    """A planted step of the year is found whatever rows and elements a tree draws."""
    monkeypatch.setattr(pipelines, "DENSE_CELLS", 0)
    late = F.col("race_year") >= training.agg(F.expr("percentile_disc(0.5) within group (order by race_year)")).first()[0]
    target = pipelines.TASKS[task].target
    planted = training.withColumn(target, late.cast(training.schema[target].dataType))
    model = forests.fit_in_parts(planted, task, str(tmp_path / "f"), part_trees=20, numTrees=40, maxDepth=6)
    assert model.stages[-1].getNumTrees == 40
    wrong = model.transform(planted).filter(F.abs(F.col("prediction") - F.col(target)) > 0.5).count()
    assert wrong <= planted.count() // 20


def test_cuts_next_to_even_shares(spark):
    rows = spark.range(1000).select(F.array((F.col("id") % 100).cast("double"), (F.col("id") % 3).cast("double"), F.lit(1.0)).alias("numbers"))
    many, few, one = trees.thresholds(rows, 3, 5)
    assert many == [19.5, 39.5, 59.5, 79.5] and few == [0.5, 1.5] and one == []


def test_grid_search_on_wide_rows(spark, training, monkeypatch):  # noqa: F811
    grid = {"a": ("gbt", {"maxIter": 1, "maxDepth": 2}), "b": ("logistic", {"maxIter": 5})}
    narrow = {(r.point, r.fold): r.metric for r in search.grid_search(training, "status", grid, folds=2).scores.collect()}
    monkeypatch.setattr(pipelines, "DENSE_CELLS", 0)
    wide = {(r.point, r.fold): r.metric for r in search.grid_search(training, "status", grid, folds=2).scores.collect()}
    assert wide == pytest.approx(narrow)


@pytest.mark.parametrize("share", [1, 3, 1 << 30])
def test_rare_elements_put_off_change_no_tree(spark, training, monkeypatch, share):  # noqa: F811
    """Whether all elements are rare, some, or none, the forest has the same nodes."""
    monkeypatch.setattr(pipelines, "DENSE_CELLS", 0)
    found = []
    for rare in (share, 1 << 30):
        monkeypatch.setattr(trees, "_RARE", rare)
        model = pipelines.fit(training.coalesce(1), "status", "forest", numTrees=3, maxDepth=4)
        table = nodes.node_table(spark, model.stages[-1]).select("tree", "node", "feature", F.round("gain", 9), "left")
        found.append(sorted(table.collect(), key=str))
    assert found[0] == found[1]


def test_rare_elements_that_cant_win_arent_summed(spark, monkeypatch):
    """A step of one number explains all, so only the numbers and common elements are read."""
    rows = spark.range(4000).selectExpr("if(id % 10 < 4, 5D, -3D) AS y", "array(cast(id % 10 AS double)) AS numbers", "array(cast(1 + id AS int), 4001) AS ones")
    seen, best = [], trees._Grower._best
    monkeypatch.setattr(trees._Grower, "_best", lambda self, points, places, active, *more: (seen.append(sorted(active)), best(self, points, places, active, *more))[1])
    forest = RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=30, featureSubsetStrategy="all", seed=1)
    model = trees.fit(forest, rows, 1, 4002)
    assert seen == [[(0, 0), (1, 0)]]
    assert [t.numNodes for t in model.trees] == [3, 3]
