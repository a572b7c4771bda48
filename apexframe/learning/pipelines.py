"""Spark ML pipelines for the three tasks, and fitting them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    OneHotEncoderModel,
    RobustScaler,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.learning import categories, trees
from apexframe.operators.groups import value_positions
from apexframe.schemas import TASKS
from apexframe.session import stage

# Width of a column that the caller chose to hash.
HASHED_WIDTH = 1 << 14
NULLS = ("error", "impute", "drop")
# Spark's trees hold a number for each row and element; up to so many.
DENSE_CELLS = 1 << 28

# The chosen settings of every learner. The squared loss doubles
# the residual, so a step of 0.05 moves as far as the usual 0.1.
REGRESSORS = {
    "gbt": (
        GBTRegressor,
        dict(lossType="squared", maxIter=400, maxDepth=5, minInstancesPerNode=4, stepSize=0.05, seed=42),
    ),
    "forest": (
        RandomForestRegressor,
        dict(numTrees=800, maxDepth=30, minInstancesPerNode=2, featureSubsetStrategy="all", seed=42),
    ),
    "deep_gbt": (
        GBTRegressor,
        dict(lossType="squared", maxIter=500, maxDepth=7, minInstancesPerNode=20, stepSize=0.025, seed=42),
    ),
}
CLASSIFIERS = {
    "gbt": (
        GBTClassifier,
        dict(maxIter=400, maxDepth=5, minInstancesPerNode=5, stepSize=0.1, seed=42),
    ),
    "forest": (
        RandomForestClassifier,
        dict(numTrees=800, maxDepth=30, minInstancesPerNode=4, featureSubsetStrategy="sqrt", seed=42),
    ),
    "logistic": (
        LogisticRegression,
        dict(maxIter=100, elasticNetParam=0.0, standardization=False),
    ),
}
LOGISTIC_C = 0.1


def is_classification(task: str) -> bool:
    return task == "status"


def learner(task: str, estimator: str = "gbt", **settings) -> Estimator:
    """The estimator of a task with its chosen settings, or others given here."""
    known = CLASSIFIERS if is_classification(task) else REGRESSORS
    kind, chosen = known[estimator]
    return kind(labelCol=TASKS[task].target, featuresCol="features", **{**chosen, **settings})


def build_pipeline(
    task: str,
    estimator: str | Estimator = "gbt",
    scales: Mapping[str, tuple[float, float]] | None = None,
    hashed: Sequence[str] = (),
    impute: bool = False,
    **settings,
) -> Pipeline:
    """Scaled numbers and one-hot categories, then the estimator.

    The features are an explicit list: no other column of the table, such as
    the finishing position, can slip into the model. A category never seen in
    training gives zeros. Columns named in ``hashed`` are hashed into a fixed
    width instead, which is another encoding: labels may share an element, and
    one never seen gives a one. The caller chooses that, never the data.

    ``scales`` holds centre and width per numeric column and replaces the
    approximate scaler; with ``impute`` a missing number then counts as the
    centre, in training and in prediction.
    """
    chosen = TASKS[task]
    last = learner(task, estimator, **settings) if isinstance(estimator, str) else estimator
    indexed = [c for c in chosen.categorical if c not in hashed]
    stages = [
        *_scaling(chosen.numeric, scales, impute),
        StringIndexer(
            inputCols=indexed,
            outputCols=[f"index_{c}" for c in indexed],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"index_{c}" for c in indexed],
            outputCols=[f"onehot_{c}" for c in indexed],
            dropLast=True,
        ),
        *[
            FeatureHasher(
                inputCols=[c], outputCol=f"onehot_{c}", numFeatures=HASHED_WIDTH, categoricalCols=[c]
            )
            for c in hashed
        ],
        VectorAssembler(
            inputCols=["scaled", *[f"onehot_{c}" for c in chosen.categorical]],
            outputCol="features",
            handleInvalid="keep",
        ),
        last,
    ]
    return Pipeline(stages=stages)


def usable(training: DataFrame, task: str, nulls: str = "error") -> DataFrame:
    """Features and target of a training table, with missing numbers treated as said.

    ``error`` fails the job at the first missing number, ``impute`` leaves them
    to the pipeline, ``drop`` leaves the rows out; ``missing_numbers`` counts
    them. A missing target always fails.
    """
    if nulls not in NULLS:
        raise ValueError(f"nulls is one of {', '.join(NULLS)}")
    chosen = TASKS[task]
    rows = training.select(*chosen.features, chosen.target)
    if nulls == "drop":
        rows = rows.dropna(subset=[*chosen.numeric])
    needed = [chosen.target] if nulls != "error" else [*chosen.numeric, chosen.target]
    for c in needed:
        message = F.lit(f"{c} has missing values; impute or drop them explicitly")
        kind = rows.schema[c].dataType
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.raise_error(message).cast(kind)))
    return rows


def missing_numbers(training: DataFrame, task: str) -> DataFrame:
    """How many rows miss each number, and any of them."""
    numbers = TASKS[task].numeric
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in numbers]
    missing = F.lit(False)
    for c in numbers:
        missing = missing | F.col(c).isNull()
    every = training.agg(*counts, F.count_if(missing).alias("any_number"), F.count(F.lit(1)).alias("all_rows"))
    names = [*numbers, "any_number", "all_rows"]
    return every.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("rows")) for n in names])))


def fit(training: DataFrame, task: str, estimator: str = "gbt", nulls: str = "error", **settings) -> PipelineModel:
    """Fit a task's pipeline on its training table, read once and staged."""
    chosen = TASKS[task]
    rows = stage(usable(training, task, nulls))
    if estimator == "logistic" and "regParam" not in settings:
        settings["regParam"] = 1 / (LOGISTIC_C * max(rows.count(), 1))
    hashed = settings.pop("hashed", ())
    last = learner(task, estimator, **settings) if isinstance(estimator, str) else estimator
    prepared = prepare(rows, task, robust_scales(rows, chosen.numeric), nulls == "impute", hashed)
    return PipelineModel(stages=[*prepared.stages, fit_last(last, laid_out(prepared, rows, task), task)])


def prepare(
    rows: DataFrame, task: str, scales: Mapping[str, tuple[float, float]], impute: bool = False, hashed: Sequence[str] = ()
) -> PipelineModel:
    """The stages before the estimator, fitted on staged rows.

    Where rows times elements exceed ``DENSE_CELLS``, the labels are numbered by a
    table and the driver keeps none of them; the vectors are the same.
    """
    chosen, n = TASKS[task], rows.count()
    first = len(chosen.numeric)
    # A column has no more labels than rows, so small tables aren't counted.
    if not hashed and n * (first + n * len(chosen.categorical)) > DENSE_CELLS:
        known = categories.dictionary(rows, chosen.categorical)
        if n * (first + known.width) > DENSE_CELLS:
            return PipelineModel(stages=[categories.Encoder(known, scales, impute)])
    stages = build_pipeline(task, scales=scales, hashed=hashed, impute=impute).getStages()
    return Pipeline(stages=stages[:-1]).fit(rows)


def laid_out(prepared: PipelineModel, rows: DataFrame, task: str, keep: Sequence[str] = ()) -> DataFrame:
    """Target, features and ``keep`` of all rows, which are staged.

    Where rows times elements exceed ``DENSE_CELLS``, the table is staged and also
    has the ``numbers`` and the places of the ``ones`` that a vector consists of, and
    the vectors come without the names of their elements: there is one for each
    label, and Spark would send them to every task of every pass.
    """
    chosen = TASKS[task]
    if isinstance(prepared.stages[0], categories.Encoder):
        return prepared.stages[0].laid_out(rows).select(*keep, chosen.target, "features", "numbers", "ones")
    encoder = next(s for s in prepared.stages if isinstance(s, OneHotEncoderModel))
    # The encoder also counts the unknown labels, which are zeros.
    counts = [size - 1 for size in encoder.categorySizes]
    size = len(chosen.numeric) + sum(counts)
    if len(counts) < len(chosen.categorical) or rows.count() * size <= DENSE_CELLS:
        return prepared.transform(rows).select(*keep, chosen.target, "features")
    made = applied(prepared, rows)
    first, ones = len(chosen.numeric), []
    for c, n in zip(chosen.categorical, counts):
        index = F.col(f"index_{c}")
        ones.append(F.when(index < n, (index + first).cast("int")))
        first += n
    features = F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": size}})
    numbers = F.array(*[F.col(f"scaled_{c}") for c in chosen.numeric])
    return stage(made.select(*keep, chosen.target, features, numbers.alias("numbers"), F.array_compact(F.array(*ones)).alias("ones")))


def applied(model: Transformer, rows: DataFrame) -> DataFrame:
    """``model.transform`` without the names that Spark keeps of every label and every
    element, several times over, with the columns of a pipeline: they would be sent
    to every task. No fitted stage needs them."""
    if not isinstance(model, PipelineModel):
        return model.transform(rows)
    for part in model.stages:
        rows = part.transform(rows)
        if isinstance(part, StringIndexerModel):
            kept = {c: {} for c in part.getOutputCols()}
        elif isinstance(part, OneHotEncoderModel):
            other = (part.getHandleInvalid() == "keep") - part.getDropLast()
            sizes = zip(part.getOutputCols(), part.categorySizes)
            kept = {c: {"ml_attr": {"num_attrs": n + other}} for c, n in sizes}
        elif isinstance(part, VectorAssembler) and part.getOutputCol() == "features":
            kept = {"features": {}}
        else:
            continue
        for c, metadata in kept.items():
            rows = rows.withMetadata(c, metadata)
    return rows


def fit_last(last: Estimator, rows: DataFrame, task: str) -> Model:
    """Fit an estimator on rows that are laid out. Trees don't widen rows with ``ones``."""
    by_sums = isinstance(last, GBTRegressor | GBTClassifier | RandomForestRegressor | RandomForestClassifier)
    if by_sums and "ones" in rows.columns:
        return trees.fit(last, rows, len(TASKS[task].numeric), rows.schema["features"].metadata["ml_attr"]["num_attrs"])
    return last.fit(rows.select(TASKS[task].target, "features"))


def robust_scales(rows: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column, interpolated; a range of 0 is 1.

    The quartiles come from the positions of the columns' counted values, so no
    task holds the values of a column. Missing values don't count.
    """
    long = rows.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numeric]))
    )
    n, before, own = F.col("_group_rows"), F.col("_rows_before"), F.col("_own_rows")
    wanted = []
    for share in (0.25, 0.5, 0.75):
        place = F.lit(share) * (n - 1)
        wanted += [(share, place, F.floor(place)), (share, place, F.ceil(place))]
    hits = [
        F.when((before <= at) & (at < before + own), F.struct(F.lit(s).alias("share"), place.alias("place"), at.alias("at")))
        for s, place, at in wanted
    ]
    found = value_positions(long, ["name"], "value").select("name", "value", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    # At most six values per column.
    values: dict[str, dict[float, list[tuple[int, float, float]]]] = {}
    for row in found.select("name", "value", "hit.*").collect():
        values.setdefault(row["name"], {}).setdefault(row["share"], []).append((row["at"], row["place"], row["value"]))

    def quartile(c: str, share: float) -> float:
        own_values = sorted(values.get(c, {}).get(share, []))
        if not own_values:
            return {0.25: 0.0, 0.5: 0.0, 0.75: 1.0}[share]
        (at, place, low), high = own_values[0], own_values[-1][2]
        return low + (place - at) * (high - low)

    scales = {}
    for c in numeric:
        low, middle, high = (quartile(c, share) for share in (0.25, 0.5, 0.75))
        scales[c] = (middle, (high - low) or 1.0)
    return scales


def scaled(rows: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The scaled columns in place of the originals."""
    return rows.withColumns({c: (F.col(c) - centre) / width for c, (centre, width) in scales.items()})


def _scaling(numeric: Sequence[str], scales: Mapping[str, tuple[float, float]] | None, impute: bool) -> list:
    if scales is None:
        return [
            VectorAssembler(inputCols=list(numeric), outputCol="numbers", handleInvalid="keep"),
            RobustScaler(inputCol="numbers", outputCol="scaled", withCentering=True, withScaling=True),
        ]
    parts = [f"({c} - ({centre!r}D)) / ({width!r}D)" for c, (centre, width) in scales.items()]
    if impute:
        parts = [f"coalesce({x}, 0D)" for x in parts]
    parts = [f"{x} AS scaled_{c}" for x, c in zip(parts, scales)]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"),
        VectorAssembler(
            inputCols=[f"scaled_{c}" for c in numeric], outputCol="scaled", handleInvalid="keep"
        ),
    ]
