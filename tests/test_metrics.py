import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from apexframe.operators import metrics
from apexframe.schemas import RACE

CAR = list(metrics.CAR)


@pytest.fixture(scope="module")
def sides(spark):
    """Predicted and true positions; one car occurs very often on both sides."""
    rng = np.random.default_rng(3)
    rows = [(2020, 1, 1, "monza", f"d{i % 7}", "c", int(rng.integers(1, 15))) for i in range(40)]
    rows += [(2020, 2, 1, "spa", "same", "c", int(rng.integers(1, 30))) for _ in range(60)]
    rows += [(2020, 3, 1, "tiny", f"d{i}", "c", i + 1) for i in range(3)]
    rows += [(2020, 4, 1, "mid", f"d{i}", "c", 7 - i) for i in range(7)]
    true = [(*r[:6], 1 + (r[6] * 7) % 13) for r in rows if r[6] % 5 or r[3] != "monza"]
    ddl = "race_year int, race_month int, race_day int, circuit string, driver string, constructor string, "
    return (
        spark.createDataFrame(rows, ddl + "predicted_final_position int"),
        spark.createDataFrame(true, ddl + "final_position int"),
    )


@pytest.fixture(scope="module")
def joined(sides):
    """All pairs, by brute force."""
    p, t = (s.toPandas() for s in sides)
    return p.merge(t, on=CAR)


@pytest.fixture(scope="module")
def pairs(sides):
    return metrics.pair_sums(*sides)


def test_joined(sides, joined):
    size = joined.groupby(CAR).driver.transform("size")
    assert metrics.join_truth(*sides).count() == (size == 1).sum()
    rejected = metrics.rejected_cars(*sides).toPandas()
    assert (rejected.predicted_rows * rejected.true_rows).sum() == (size > 1).sum()
    assert metrics.duplicate_cars(sides[0]).count() == 8


def test_pair_sums(pairs, joined):
    error = (joined.final_position - joined.predicted_final_position).abs()
    want = (
        joined.assign(pairs=1, absolute_error=error, squared_error=error**2)
        .groupby([*CAR, "final_position"])[["pairs", "absolute_error", "squared_error"]]
        .sum()
    )
    got = pairs.toPandas().set_index([*CAR, "final_position"]).sort_index()
    assert got.index.tolist() == want.index.tolist()
    assert (got[want.columns].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("top", [None, 5])
def test_weighted_position_error(pairs, joined, top):
    entries = joined.groupby(list(RACE)).driver.transform("size")
    race = np.where(entries < 5, 0.2, np.where(entries < 10, 0.5, 1.0))
    t = joined.final_position
    place = np.where(t <= 5, 3, np.where(t <= 10, 2, 1))
    weighted = race * place * (t - joined.predicted_final_position).abs()
    want = weighted[t <= top].mean() if top else weighted.mean()
    got = metrics.weighted_position_error(pairs, top).first()[0]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("top", [None, 5])
def test_position_errors(pairs, joined, top):
    rows = joined[joined.final_position <= top] if top else joined
    t, p = rows.final_position.to_numpy(float), rows.predicted_final_position.to_numpy(float)
    mse = ((t - p) ** 2).mean()
    want = (mse, mse**0.5, 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum(), np.abs(t - p).mean())
    assert tuple(metrics.position_errors(pairs, top).first()) == pytest.approx(want)


def test_regression_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 1.0), (None, 1.0)], "t double, p double")
    row = metrics.regression_errors(df, F.col("t"), F.col("p"), nulls="drop").first()
    assert row.dropped == 1
    assert row.mse == pytest.approx(10 / 3) and row.mae == pytest.approx(4 / 3)
    assert row.r2 == pytest.approx(1 - 10 / (14 / 3))


def test_classification(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1), (0, 1, 0.8)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    matrix = {r.label: (r.predicted_0, r.predicted_1) for r in metrics.confusion_matrix(df, "label", "prediction").collect()}
    assert matrix == {0: (2, 1), 1: (1, 1)}
    report = {r["class"]: r for r in metrics.classification_report(df, "label", "prediction").collect()}
    assert report["0"].precision == pytest.approx(2 / 3) and report["1"].recall == 0.5
    assert report["accuracy"].f1 == pytest.approx(0.6)
    assert report["macro avg"].recall == pytest.approx((2 / 3 + 0.5) / 2)
    assert report["weighted avg"].support == 5
    # Pairs in the right order: 0.9 beats all, 0.4 beats one and ties with one.
    assert metrics.roc_auc(df, "label", "score").first()[0] == pytest.approx((3 + 1.5) / 6)


def test_classes_never_seen(spark):
    df = spark.createDataFrame([(0, 0, 0.5)], "label int, prediction int, score double")
    matrix = {r.label: (r.predicted_0, r.predicted_1) for r in metrics.confusion_matrix(df, "label", "prediction").collect()}
    assert matrix == {0: (1, 0), 1: (0, 0)}
    report = {r["class"]: r for r in metrics.classification_report(df, "label", "prediction").collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1) == (0.0, 0.0, 0.0)
    assert metrics.roc_auc(df, "label", "score").first()[0] is None


def test_auc_equals_the_built_in_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 500).astype(float), "s": np.round(rng.random(500), 2)})
    df = spark.createDataFrame([tuple(map(float, r)) for r in pdf.to_numpy()], "label double, s double")
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", numBins=0)
    assert metrics.roc_auc(df, "label", "s").first()[0] == pytest.approx(evaluator.evaluate(df))


def test_large_sums_are_exact(spark):
    rows = [(2000, 1, 1, "c", "d", "t", 1, 1, 3_000_000_000, 3 * 10**18), (2000, 1, 1, "c", "e", "t", 5, 1, 4, 8 * 10**18)]
    ddl = "race_year int, race_month int, race_day int, circuit string, driver string, constructor string, "
    pairs = spark.createDataFrame(rows, ddl + "final_position long, pairs long, absolute_error long, squared_error long")
    assert metrics.position_errors(pairs).first().mse == 5.5e18


def test_missing_scores_fail_or_are_counted(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, None), (0, float("nan"))], "label int, score double")
    with pytest.raises(Exception):  # noqa: B017  (Spark wraps what the job raised)
        metrics.roc_auc(rows, "label", "score").collect()
    assert tuple(metrics.roc_auc(rows, "label", "score", nulls="drop").first()) == (1.0, 2)
    with pytest.raises(Exception, match="null or not a number"):
        metrics.regression_errors(rows, F.col("label"), F.col("score")).collect()
    assert metrics.regression_errors(rows, F.col("label"), F.col("score"), nulls="drop").first().dropped == 2


def test_metrics_by_key(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 0.9), ("a", 0.0, 0.1), ("a", 1.0, 0.1), ("b", 1.0, 0.2), ("b", 0.0, 0.7), ("c", 1.0, 0.5)], "model string, y double, p double"
    )
    areas = dict(metrics.keyed_roc_auc(rows, ["model"], "y", "p").collect())
    assert areas == {"a": 0.75, "b": 0.0, "c": None}
    for key in ("a", "b"):
        own = rows.filter(F.col("model") == key)
        assert metrics.roc_auc(own, "y", "p").first()[0] == areas[key]
    errors = {r.model: r for r in metrics.keyed_regression_errors(rows, ["model"], F.col("y"), F.col("p")).collect()}
    one = metrics.regression_errors(rows.filter("model = 'a'"), F.col("y"), F.col("p")).first()
    assert errors["a"].mse == one.mse and errors["a"].mae == one.mae and errors["a"].r2 == one.r2 and errors["c"].mse == 0.25


def test_pair_sums_of_one_table_equal_those_of_two_sides(spark):
    rows = [(2001, 1, 1, "x", f"d{i % 5}", "c", float(i * 7 % 11), float(i * 5 % 13)) for i in range(40)]
    rows.append((2001, 1, 1, "x", None, "c", 1.0, None))
    cars = spark.createDataFrame(
        rows,
        "race_year int, race_month int, race_day int, circuit string, driver string, constructor string,"
        " predicted_deviation_from_median double, deviation_from_median double",
    )
    predicted = metrics.group_rank(cars, metrics.RACE, "predicted_deviation_from_median", "predicted_final_position")
    two = metrics.pair_sums(predicted, metrics.ranked_truth(cars))
    one = metrics.pair_sums(metrics.ranked_both(cars))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.count() > 5
