import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from apexframe.learning import inspect, nodes, pipelines, search, splits
from apexframe.plans import scoring
from apexframe.schemas import MAINRACE, TASKS
from apexframe.sources import models

FEW = {"maxIter": 3, "maxDepth": 3}


@pytest.fixture(scope="module")
def training(spark):
    """Deviation and retirement both follow from grid position and driver."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        driver, grid = int(rng.integers(0, 6)), int(rng.integers(1, 21))
        race = i // 20
        rows.append((
            grid, 9000 + i, 10 * i, 50 + race % 20, 2000 + race, f"team{driver % 3}", f"circuit_{race % 5}", "Race circuit",
            f"driver{driver}", "GBR", "ITA", "GBR", 1 + race % 12, 1 + race % 28, int(rng.integers(0, 2)), 0, 1,
            float(grid * 1000 + driver * 500), int(grid > 12), grid,
        ))
    ddl = ", ".join(
        f"{c} {'string' if c in ('constructor', 'circuit', 'type_circuit', 'driver') or 'nationality' in c else 'int'}"
        for c in MAINRACE.features
    )
    df = spark.createDataFrame(rows, f"{ddl}, deviation_from_median double, dnf int, final_position int")
    return df.cache()


@pytest.fixture(scope="module")
def model(training):
    return pipelines.fit(training, "mainrace", **FEW)


def test_feature_counts_and_no_leak(training, model):
    assert [len(TASKS[t].features) for t in ("mainrace", "qualifying", "status")] == [17, 14, 16]
    stages = [s for s in model.stages]
    used = {c for s in stages if hasattr(s, "getInputCols") for c in s.getInputCols()}
    assert not any("final_position" in c for c in used)
    assert model.stages[-1].numFeatures == len(inspect.feature_names(model, "mainrace"))


def test_chosen_settings():
    gbt = pipelines.learner("mainrace")
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getMinInstancesPerNode()) == (400, 5, 4)
    forest = pipelines.learner("qualifying", "forest")
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (800, 30)
    assert pipelines.learner("status").getMinInstancesPerNode() == 5
    assert pipelines.learner("status", "forest").getFeatureSubsetStrategy() == "sqrt"


def test_unseen_category_is_accepted(training, model):
    unseen = training.limit(3).withColumn("driver", F.lit("nobody"))
    assert scoring.predict(unseen, model).filter(F.col(scoring.PREDICTED).isNotNull()).count() == 3


def test_learns_something(training, model):
    row = inspect.test_scores(model, training, "mainrace").first()
    assert row.r2 > 0.3


@pytest.mark.parametrize("estimator, settings", [
    ("gbt", FEW), ("forest", {"numTrees": 3, "maxDepth": 4}), ("logistic", {"maxIter": 10}),
])
def test_dnf_percentage(training, estimator, settings):
    fitted = pipelines.fit(training, "status", estimator, **settings)
    rows = scoring.dnf_percentage(training, fitted).collect()
    assert all(0 <= r.dnf_percentage <= 100 for r in rows)
    assert inspect.test_scores(fitted, training, "status").first().roc_auc > 0.8


def test_hashed_columns(training):
    fitted = pipelines.fit(training, "mainrace", hashed=("driver",), **FEW)
    names = inspect.feature_names(fitted, "mainrace")
    assert len(names) == fitted.stages[-1].numFeatures
    assert inspect.importance(fitted, "mainrace", training).count() > 0


def test_scales(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (10, 7)], "x int, same int")
    scales = pipelines.robust_scales(df, ["x", "same"])
    assert scales["x"] == (2.5, 4.75 - 1.75) and scales["same"] == (7.0, 1.0)
    assert pipelines.scaled(df, scales).agg(F.max("x")).first()[0] == pytest.approx(7.5 / 3)


def test_approximate_scaler_pipeline(training):
    pipeline = pipelines.build_pipeline("mainrace", "gbt", **FEW)
    assert pipeline.fit(training).transform(training).count() == 400


def test_save_and_load(spark, training, model, tmp_path):
    path = str(tmp_path / "model")
    models.save(model, models.describe(training, "mainrace", "v1"), path)
    loaded, meta = models.load(spark, path)
    row = meta.first()
    assert (row.n_rows, row.n_features, row.target, row.version) == (400, 17, "deviation_from_median", "v1")
    a = scoring.predict(training, model).select(scoring.PREDICTED).collect()
    assert a == scoring.predict(training, loaded).select(scoring.PREDICTED).collect()
    with pytest.raises(FileNotFoundError):
        models.load(spark, str(tmp_path / "none"))


def test_splits(training):
    keyed = splits.with_race_bucket(training)
    train, test = splits.split_by_race(training)
    assert train.count() + test.count() == 400
    key = splits.race_key()
    assert train.select(key).intersect(test.select(key)).count() == 0
    again, _ = splits.split_by_race(training.repartition(7))
    assert sorted(again.collect()) == sorted(train.collect())
    ids = keyed.filter("bucket < 20").select("race_id").distinct()
    by_ids = splits.split_by_ids(training, ids)
    assert sorted(by_ids[1].collect()) == sorted(test.collect())
    assert by_ids[0].count() == train.count()
    left, right = splits.split_rows(training, training.columns)
    assert left.count() + right.count() == 400 and 40 < right.count() < 120


GRID = {"shallow": ("gbt", {"maxIter": 2, "maxDepth": 1}), "deep": ("gbt", {"maxIter": 2, "maxDepth": 4})}


@pytest.mark.parametrize("by_race", [True, False])
def test_grid_search(training, by_race):
    found = search.grid_search(training, "mainrace", GRID, folds=2, by_race=by_race)
    assert found.best == "deep"
    # Every row is predicted once by each point, and the metric is that of these predictions.
    assert {r.point: r["count"] for r in found.predictions.groupBy("point").count().collect()} == {"shallow": 400, "deep": 400}
    own = found.predictions.groupBy("point", "fold").agg(F.avg((F.col("truth") - F.col("prediction")) ** 2).alias("mse"), F.count("*").alias("n"))
    for row in found.scores.join(own, ["point", "fold"]).collect():
        assert row.rows == row.n and row.metric == pytest.approx(row.mse)
    if by_race:
        assert found.predictions.groupBy("race_year", "race_month", "race_day", "circuit").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_folds_are_prepared_without_their_own_rows(training):
    rows = search.with_folds(training, "status", folds=3)
    rare = rows.withColumn("driver", F.when(F.col("fold") == 1, F.lit("only here")).otherwise(F.col("driver")))
    prepared = search.prepared_fold(rare, "status", 1)
    sizes = {r.fold: (r.low, r.high) for r in prepared.groupBy("fold").agg(
        F.min(F.size(vector_to_array("features"))).alias("low"), F.max(F.size(vector_to_array("features"))).alias("high")).collect()}
    assert len(set(sizes.values())) == 1
    other = search.prepared_fold(rare, "status", 0)
    # The label is known where fold 1 is in training: one element more.
    assert other.select(F.size(vector_to_array("features"))).first()[0] == sizes[1][0] + 1


def test_grid_search_of_classifiers(training):
    grid = {"weak": ("logistic", {"maxIter": 5, "regParam": 100.0}), "usual": ("logistic", {"maxIter": 20}), "tree": ("gbt", {"maxIter": 2, "maxDepth": 3})}
    found = search.grid_search(training, "status", grid, folds=2)
    assert found.best == "tree" and found.scores.count() == 6
    assert found.scores.filter("metric < 0 OR metric > 1").count() == 0


@pytest.mark.parametrize("task, estimator, settings", [
    ("mainrace", "gbt", FEW), ("mainrace", "forest", {"numTrees": 4, "maxDepth": 4}), ("status", "gbt", FEW), ("status", "forest", {"numTrees": 4, "maxDepth": 4}),
])
def test_node_table_gives_the_models_importances(spark, training, task, estimator, settings):
    last = pipelines.fit(training, task, estimator, **settings).stages[-1]
    table = nodes.node_table(spark, last).cache()
    got = {r.feature: r.importance for r in nodes.node_importance(table, nodes.is_forest(last)).collect()}
    want = last.featureImportances.toArray()
    assert max(abs(got.get(k, 0) - w) for k, w in enumerate(want)) < 1e-9 and sum(got.values()) == pytest.approx(1)
    assert table.count() == last.totalNumNodes and table.select("tree").distinct().count() == last.getNumTrees
    children = table.filter("feature IS NOT NULL").selectExpr("tree", "node up", "inline(array(struct(left node), struct(right node)))")
    assert children.join(table, ["tree", "node"]).count() == children.count() == table.count() - last.getNumTrees
    assert table.filter("feature IS NULL AND (gain IS NOT NULL OR left IS NOT NULL)").count() == 0


def test_importance_of_a_single_leaf(spark, training):
    flat = pipelines.fit(training.withColumn("deviation_from_median", F.lit(1.0)), "mainrace", **FEW)
    assert inspect.importance(flat, "mainrace", training).count() == 0


def test_importance(training, model):
    importances = inspect.importance(model, "mainrace", training)
    assert importances.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    faithful = inspect.grouped_importance(importances, "mainrace").collect()
    exact = inspect.grouped_importance(importances, "mainrace", by_source=True).collect()
    assert faithful[0].base_feature == exact[0].base_feature == "qualification_position"
    assert {r.base_feature for r in exact} <= set(MAINRACE.features)
    first = inspect.sorted_importance(importances).first()
    assert first.feature == "qualification_position"


def test_numbered(training):
    numbers = [r.row_index for r in inspect.numbered(training.repartition(5)).collect()]
    assert sorted(numbers) == list(range(400))


def test_permutation_importance(training, model):
    rows = {r.feature: r.importance for r in inspect.permutation_importance(model, training, "mainrace").collect()}
    assert set(rows) == set(MAINRACE.features)
    assert max(rows, key=rows.get) == "qualification_position"
    assert rows["type_circuit"] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 98, 10**11])
def test_shuffle_is_a_bijection(n):
    step, shift = inspect._shuffle_step(n, 42)
    if n < 1000:
        assert sorted((step * i + shift) % n for i in range(n)) == list(range(n))
    assert np.gcd(step, n) == 1


def test_leaderboard(training):
    train, test = splits.split_by_race(training)
    table = inspect.leaderboard(train, test, "mainrace", {
        "boosted": ("gbt", FEW), "deep": ("deep_gbt", {"maxIter": 3}), "forest": ("forest", {"numTrees": 2, "maxDepth": 3}),
    }).collect()
    assert len(table) == 3 and [r.rmse for r in table] == sorted(r.rmse for r in table)


def test_missing_numbers(training):
    gaps = training.withColumn("qualification_position", F.when(F.col("laps") > 55, F.col("qualification_position")))
    with pytest.raises(Exception):  # noqa: B017
        pipelines.fit(gaps, "status", "logistic")
    counts = {r.column_name: r.rows for r in pipelines.missing_numbers(gaps, "status").collect()}
    assert counts["qualification_position"] == counts["any_number"] > 0 and counts["all_rows"] == 400
    fitted = pipelines.fit(gaps, "status", "logistic", nulls="impute", maxIter=10)
    scored = scoring.dnf_percentage(gaps, fitted)
    assert scored.filter(F.col("dnf_percentage").isNull() | F.isnan("dnf_percentage")).count() == 0
    assert pipelines.usable(gaps, "status", "drop").count() == 400 - counts["any_number"]


def test_scoring_carries_no_names_of_elements(training):
    model = pipelines.fit(training, "status", "logistic")
    plain, lean = model.transform(training), pipelines.applied(model, training)
    # Names of labels and elements, as they lie in the schemas.
    said = [[("team0" in str(f.metadata)) for f in df.schema if "constructor" in f.name or f.name == "features"] for df in (plain, lean)]
    assert any(said[0]) and not any(said[1])
    wanted = plain.select((vector_to_array("probability")[1] * 100).alias("p"))
    scored = scoring.dnf_percentage(training, model)
    assert sorted(r.p for r in wanted.collect()) == sorted(r.dnf_percentage for r in scored.collect())
    assert scored.columns == [*training.columns, "dnf_percentage"] and lean.columns == plain.columns
