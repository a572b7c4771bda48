"""Requests to predictions: validate, expand, predict, rank, nest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.learning.pipelines import applied
from apexframe.operators.groups import group_rank
from apexframe.operators.lookup import expand, insist_valid, with_validity
from apexframe.schemas import RACE, TASKS
from apexframe.session import stage

PREDICTED = "predicted_deviation_from_median"
POSITION = "predicted_final_position"


def expand_valid(
    requests: DataFrame,
    dims: Mapping[str, DataFrame],
    picks: Mapping[str, DataFrame],
    task: str,
    fail_fast: bool = False,
    faithful_case: bool = False,
    keep_input: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Features of the valid requests, and the requests that were rejected."""
    if fail_fast:
        good = insist_valid(requests, picks)
        return expand(good, dims, task, faithful_case, keep_input), good.limit(0)
    # Checked once for both sides.
    checked = stage(with_validity(requests, picks))
    good, bad = (checked.filter(side).drop("valid") for side in ("valid", "NOT valid"))
    return expand(good, dims, task, faithful_case, keep_input), bad


def predict(features: DataFrame, model: Transformer | str, out: str = PREDICTED) -> DataFrame:
    """Add the prediction of a fitted model, or take over an existing column."""
    if isinstance(model, str):
        return features.withColumn(out, F.col(model).cast("double"))
    predicted = applied(model, features)
    return predicted.select(*features.columns, F.col("prediction").cast("double").alias(out))


def rank_predictions(predicted: DataFrame, keys: Sequence[str] = RACE) -> DataFrame:
    """Add the predicted finishing position per race, over the keys that exist;
    over all rows if none does."""
    present = [k for k in keys if k in predicted.columns]
    return group_rank(predicted, present, PREDICTED, POSITION)


def predict_and_rank(
    features: DataFrame, model: Transformer | str, keys: Sequence[str] = RACE
) -> DataFrame:
    return rank_predictions(predict(features, model), keys)


def dnf_percentage(features: DataFrame, model: Transformer, out: str = "dnf_percentage") -> DataFrame:
    """Add the probability of the positive class in percent."""
    scored = applied(model, features)
    percent = vector_to_array("probability")[1] * 100
    return scored.select(*features.columns, percent.alias(out))


def responses(scored: DataFrame, task: str, meta: DataFrame | None = None) -> DataFrame:
    """One nested row per prediction: the input, the features, the results and,
    if given, the single row of model metadata. Needs ``keep_input`` features."""
    results = [c for c in (PREDICTED, POSITION, "dnf_percentage") if c in scored.columns]
    nested = scored.select("input", F.struct(*TASKS[task].features).alias("features"), *results)
    if meta is None:
        return nested
    row = meta.head().asDict()
    return nested.withColumn(
        "model_meta", F.struct(*[F.lit(v).alias(k) for k, v in row.items()])
    )
