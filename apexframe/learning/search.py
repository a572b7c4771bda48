"""Cross-validated grid search, fold by fold.

A fold's scales, category numbers and feature vectors depend on its training rows
alone, not on the grid point. So each fold is prepared and staged once, and every
point is fitted on the staged vectors. What a point predicts for rows it wasn't
fitted on is kept in one long table, from which the metrics of all points and
folds come in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from apexframe.functions import split_bucket
from apexframe.learning.pipelines import LOGISTIC_C, fit_last, is_classification, laid_out, learner, prepare, robust_scales, usable
from apexframe.learning.splits import race_key
from apexframe.operators import metrics
from apexframe.schemas import RACE, TASKS
from apexframe.session import stage

# Name of a grid point: estimator and settings.
Grid = Mapping[str, tuple[str, dict]]


@dataclass(frozen=True)
class Search:
    """``predictions``: point, fold, race, truth, prediction, score, a row for each
    row and point. ``scores``: a row for each point and fold. ``best``: the name of
    the point with the best mean over the folds, the first of several."""

    predictions: DataFrame
    scores: DataFrame
    best: str


def with_folds(rows: DataFrame, task: str, folds: int = 5, seed: int = 42, by_race: bool = False) -> DataFrame:
    """Add ``fold``, from a hash of the whole row, or of the race with ``by_race``."""
    columns = [*TASKS[task].features, TASKS[task].target]
    key = race_key() if by_race else F.to_json(F.struct(*columns))
    return rows.withColumn("fold", split_bucket(key, seed, folds).cast("int"))


def prepared_fold(rows: DataFrame, task: str, fold: int, impute: bool = False) -> DataFrame:
    """Feature vectors of all rows, staged, by what the rows outside ``fold`` say."""
    train = rows.filter(F.col("fold") != fold)
    scales = robust_scales(train, TASKS[task].numeric)
    made = laid_out(prepare(train, task, scales, impute), rows, task, (*RACE, "fold"))
    return made if "ones" in made.columns else stage(made)


def grid_search(
    training: DataFrame,
    task: str,
    grid: Grid,
    folds: int = 5,
    seed: int = 42,
    by_race: bool = False,
    parallelism: int = 2,
    nulls: str = "error",
) -> Search:
    """Fit every point on every fold and score it on the rows left out.

    ``parallelism`` points are fitted side by side. The metric is the area under
    the ROC curve for retirements and the mean squared error for deviations.
    """
    target, classes = TASKS[task].target, is_classification(task)
    rows = stage(with_folds(usable(training, task, nulls), task, folds, seed, by_race))
    score = vector_to_array("probability")[1] if classes else F.col("prediction")
    parts: list[DataFrame] = []
    for fold in range(folds):
        prepared = prepared_fold(rows, task, fold, nulls == "impute")
        train, held = prepared.filter(F.col("fold") != fold), prepared.filter(F.col("fold") == fold)
        settings_of = dict(grid)
        if any(estimator == "logistic" for estimator, _ in grid.values()):
            strength = {"regParam": 1 / (LOGISTIC_C * max(train.count(), 1))}
            settings_of = {k: (e, {**strength, **s} if e == "logistic" else s) for k, (e, s) in grid.items()}

        def predictions(name: str) -> DataFrame:
            estimator, settings = settings_of[name]
            scored = fit_last(learner(task, estimator, **settings), train, task).transform(held)
            return stage(scored.select(F.lit(name).alias("point"), "fold", *RACE, F.col(target).cast("double").alias("truth"), "prediction", score.alias("score")))

        with ThreadPool(parallelism) as pool:
            parts += pool.map(inheritable_thread_target(rows.sparkSession)(predictions), grid)
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    keys = ["point", "fold"]
    if classes:
        found = metrics.keyed_roc_auc(table, keys, "truth", "score").withColumnRenamed("roc_auc", "metric")
    else:
        found = metrics.keyed_regression_errors(table, keys, F.col("truth"), F.col("prediction")).select(*keys, F.col("mse").alias("metric"))
    sizes = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    scores = stage(sizes.join(found, keys))
    # A row for each point of the grid.
    means = {r["point"]: r["mean"] for r in scores.groupBy("point").agg(F.avg("metric").alias("mean")).collect()}
    order = {name: k for k, name in enumerate(grid)}
    known = [name for name in grid if means.get(name) is not None]
    best = min(known, key=lambda name: (-means[name] if classes else means[name], order[name]))
    return Search(table, scores, best)
