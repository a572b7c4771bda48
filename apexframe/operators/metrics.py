"""Evaluation: position errors, regression errors and classification tables.

Every metric is a plain aggregate, or an aggregate of per-race aggregates, so
no race and no class is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexframe.functions import position_weight, race_weight
from apexframe.operators.groups import group_rank, group_ranks, running_sums
from apexframe.schemas import RACE

# Columns that tell one car of one race in an evaluation.
CAR = (*RACE, "driver", "constructor")


def ranked_truth(test: DataFrame, value: str = "deviation_from_median") -> DataFrame:
    """True finishing order within the rows of a test split."""
    return group_rank(test, RACE, value, "final_position")


def ranked_both(
    cars: DataFrame,
    predicted: str = "predicted_deviation_from_median",
    value: str = "deviation_from_median",
) -> DataFrame:
    """Predicted and true finishing order of the same rows, in one pass; both
    values must be of one type. ``pair_sums`` takes it for both sides."""
    return group_ranks(cars, RACE, {predicted: "predicted_final_position", value: "final_position"})


def _meetings(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per car: how often it occurs on either side, and its least positions."""
    said, was = F.col("predicted_final_position").cast("long"), F.col("final_position").cast("long")
    none = F.lit(None).cast("long")
    left = predicted.select(*CAR, said.alias("_said"), none.alias("_was"), F.lit(1).alias("_m"), F.lit(0).alias("_n"))
    right = truth.select(*CAR, none.alias("_said"), was.alias("_was"), F.lit(0).alias("_m"), F.lit(1).alias("_n"))
    return (
        left.unionByName(right)
        .dropna(subset=list(CAR))
        .groupBy(*CAR)
        .agg(
            F.sum("_m").alias("predicted_rows"),
            F.sum("_n").alias("true_rows"),
            F.min("_said").alias("predicted_final_position"),
            F.min("_was").alias("final_position"),
        )
    )


def join_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted and true position of every car that occurs once on either side.

    One aggregate, linear in its input: a car that occurs m times on one side and
    n times on the other would give m * n pairs. ``rejected_cars`` lists such
    cars, and ``pair_sums`` has the error sums over their pairs.
    """
    once = (F.col("predicted_rows") == 1) & (F.col("true_rows") == 1)
    return _meetings(predicted, truth).filter(once).drop("predicted_rows", "true_rows")


def rejected_cars(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Cars on both sides that ``join_truth`` leaves out, with their rows on each."""
    both = (F.col("predicted_rows") > 0) & (F.col("true_rows") > 0)
    often = (F.col("predicted_rows") > 1) | (F.col("true_rows") > 1)
    return _meetings(predicted, truth).filter(both & often).select(*CAR, "predicted_rows", "true_rows")


def duplicate_cars(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CAR).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


# Whole numbers whose products and sums outgrow 64 bits in large races.
_WIDE = "decimal(38,0)"


def pair_sums(predicted: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Sums over all pairs of a car's predicted and true rows, per car and true
    position, without writing the pairs out: their number, absolute and squared
    position errors, as decimals.

    Both sides are counted per car and position. With the number M and sum S of
    predictions below a true position t, and their totals, the sum of |t - p|
    over all predictions p is t (2 M - M_total) - (2 S - S_total).

    Without ``truth``, the rows of ``predicted`` have both positions and are read
    once.
    """
    def place(position: str, m: int, n: int) -> Column:
        return F.struct(F.col(position).cast("long").alias("_at"), F.lit(m).alias("_m"), F.lit(n).alias("_n"))

    said, was = place("predicted_final_position", 1, 0), place("final_position", 0, 1)
    if truth is None:
        every = predicted.select(*CAR, F.inline(F.array(said, was)))
    else:
        sides = ((predicted, said), (truth, was))
        every = reduce(DataFrame.unionByName, [rows.select(*CAR, F.inline(F.array(x))) for rows, x in sides])
    at = F.col("_at").cast("decimal(20,0)")
    places = (
        every.dropna(subset=[*CAR, "_at"])
        .groupBy(*CAR, "_at")
        .agg(F.sum("_m").alias("_m"), F.sum("_n").alias("_n"))
    )
    many = F.col("_m").cast(_WIDE)
    derived = {"_s": (many * at).cast(_WIDE), "_q": (many * at * at).cast(_WIDE)}
    summed = running_sums(places, CAR, "_at", ["_m"], derived)
    summed = summed.withColumns({c: F.col(c).cast(_WIDE) for c in ("_n", "_m_below", "_m_total")})
    number, total, squares = (F.col(f"_{x}_total") for x in "msq")
    absolute = at * (2 * F.col("_m_below") - number) - (2 * F.col("_s_below") - total)
    return summed.filter((F.col("_n") > 0) & (number > 0)).select(
        *CAR,
        F.col("_at").alias("final_position"),
        (F.col("_n") * number).cast(_WIDE).alias("pairs"),
        (F.col("_n") * absolute).cast(_WIDE).alias("absolute_error"),
        (F.col("_n") * (at * at * number - 2 * at * total + squares)).cast(_WIDE).alias("squared_error"),
    )


def weighted_position_error(pairs: DataFrame, top: int | None = None) -> DataFrame:
    """Mean of race weight x position weight x absolute position error.

    With ``top``, only true positions up to it are averaged; the race weight
    still counts every pair of the race.
    """
    error = position_weight(F.col("final_position")) * F.col("absolute_error")
    counted = F.lit(True) if top is None else F.col("final_position") <= top
    races = pairs.groupBy(*RACE).agg(
        F.sum("pairs").alias("entries"),
        F.sum(F.when(counted, error)).alias("error"),
        F.sum(F.when(counted, F.col("pairs")).otherwise(0)).alias("counted"),
    )
    total = F.sum(race_weight(F.col("entries")) * F.col("error"))
    return races.agg(F.try_divide(total, F.sum("counted")).alias("weighted_position_error"))


def position_errors(pairs: DataFrame, top: int | None = None) -> DataFrame:
    """Regression errors of the finishing position, of all cars or the true top."""
    if top is not None:
        pairs = pairs.filter(F.col("final_position") <= top)
    t, n = F.col("final_position").cast("decimal(20,0)"), F.col("pairs").cast(_WIDE)
    # Exact sums; the spread times n is the difference of exact products.
    sums = pairs.agg(
        F.sum(n).cast(_WIDE).alias("n"),
        F.sum(F.col("squared_error").cast(_WIDE)).cast("double").alias("squares"),
        F.sum(F.col("absolute_error").cast(_WIDE)).cast("double").alias("absolutes"),
        F.sum((n * t).cast(_WIDE)).cast(_WIDE).alias("t"),
        F.sum((n * t * t).cast(_WIDE)).cast(_WIDE).alias("tt"),
    )
    spread = (F.col("n") * F.col("tt")).cast(_WIDE) - (F.col("t") * F.col("t")).cast(_WIDE)
    count = F.col("n").cast("double")
    return _error_columns(
        sums.select(count.alias("n"), "squares", "absolutes", F.try_divide(spread.cast("double"), count).alias("spread"))
    )


def _insisted(value: Column, name: str) -> Column:
    """The value as a double; the job fails where it is null or not a number."""
    message = F.lit(f"{name} is null or not a number; drop such rows explicitly")
    number = value.cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), number).otherwise(F.raise_error(message).cast("double"))


def regression_errors(rows: DataFrame, truth: Column, predicted: Column, nulls: str = "error") -> DataFrame:
    """MSE, RMSE, R2 and MAE in one aggregate.

    A null or NaN fails the job. With ``nulls="drop"`` such rows are left out and
    counted in the column ``dropped``.
    """
    if nulls == "drop":
        t, p = truth.cast("double"), predicted.cast("double")
        known = t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p)
        t, p = F.when(known, t), F.when(known, p)
    else:
        t, p = _insisted(truth, "the true value"), _insisted(predicted, "the prediction")
    gap = t - p
    # The spread is taken around the mean by the variance aggregate, which does
    # not cancel as a difference of large sums would.
    sums = rows.agg(
        F.count(gap).cast("double").alias("n"),
        F.sum(gap * gap).alias("squares"),
        F.sum(F.abs(gap)).alias("absolutes"),
        (F.var_pop(t) * F.count(gap)).alias("spread"),
        (F.count(F.lit(1)) - F.count(gap)).alias("dropped"),
    )
    errors = _error_columns(sums)
    return errors if nulls == "drop" else errors.drop("dropped")


def keyed_regression_errors(rows: DataFrame, keys: Sequence[str], truth: Column, predicted: Column) -> DataFrame:
    """The same errors per key, such as one model each, in one pass. A null or NaN fails the job."""
    t, p = _insisted(truth, "the true value"), _insisted(predicted, "the prediction")
    gap = t - p
    sums = rows.groupBy(*keys).agg(
        F.count(gap).cast("double").alias("n"),
        F.sum(gap * gap).alias("squares"),
        F.sum(F.abs(gap)).alias("absolutes"),
        (F.var_pop(t) * F.count(gap)).alias("spread"),
    )
    return _error_columns(sums, keys)


def _error_columns(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    mse = F.try_divide(F.col("squares"), F.col("n"))
    return sums.select(
        *keys,
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("squares"), F.col("spread"))).alias("r2"),
        F.try_divide(F.col("absolutes"), F.col("n")).alias("mae"),
        *[c for c in sums.columns if c == "dropped"],
    )


def confusion_matrix(rows: DataFrame, label: str, prediction: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per true class, one column ``predicted_<class>`` per prediction."""
    spark = rows.sparkSession
    counts = [
        F.count(F.when(F.col(prediction) == c, 1)).alias(f"predicted_{c}") for c in classes
    ]
    seen = rows.groupBy(F.col(label).cast("int").alias(label)).agg(*counts)
    every = spark.range(len(classes)).select(
        F.element_at(F.array(*map(F.lit, classes)), (F.col("id") + 1).cast("int")).alias(label)
    )
    filled = every.join(seen, label, "left")
    return filled.na.fill(0, [f"predicted_{c}" for c in classes])


def classification_report(rows: DataFrame, label: str, prediction: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and means.

    A ratio with denominator 0 is 0. ``accuracy`` stands in the F1 column.
    """
    counts = rows.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))
    # At most classes x classes rows from here on.
    sums = []
    for c in classes:
        is_true, is_pred = F.col("label") == c, F.col("prediction") == c
        sums += [
            F.coalesce(F.sum(F.when(is_true & is_pred, F.col("n"))), F.lit(0)).alias(f"hit_{c}"),
            F.coalesce(F.sum(F.when(is_pred, F.col("n"))), F.lit(0)).alias(f"said_{c}"),
            F.coalesce(F.sum(F.when(is_true, F.col("n"))), F.lit(0)).alias(f"was_{c}"),
        ]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *sums)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def line(name: str, p: Column, r: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            f1.alias("f1"),
            support.cast("long").alias("support"),
        )

    per_class = []
    for c in classes:
        hit, said, was = (F.col(f"{k}_{c}") for k in ("hit", "said", "was"))
        per_class.append((str(c), ratio(hit, said), ratio(hit, was), ratio(2 * hit, said + was), was))
    everything = F.col("total")

    def mean(i: int, weighted: bool) -> Column:
        weights = [x[4] if weighted else F.lit(1) for x in per_class]
        whole = sum((w * x[i] for w, x in zip(weights, per_class)), F.lit(0.0))
        return ratio(whole, sum(weights, F.lit(0)))

    hits = sum((F.col(f"hit_{c}") for c in classes), F.lit(0))
    nothing = F.lit(None).cast("double")
    lines = [line(*x) for x in per_class]
    lines.append(line("accuracy", nothing, nothing, ratio(hits, everything), everything))
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        lines.append(line(name, *[mean(i, weighted) for i in (1, 2, 3)], everything))
    return total.select(F.inline(F.array(*lines)))


def roc_auc(rows: DataFrame, label: str, score: str, nulls: str = "error") -> DataFrame:
    """Exact area under the ROC curve from mean ranks, ties shared evenly.

    Rows are counted per distinct score and the scores positioned range by range,
    so no task sees the whole table. A null or NaN fails the job; with
    ``nulls="drop"`` such rows are left out and counted in ``dropped``.
    """
    value, positive = F.col(score).cast("double"), F.col(label).cast("double")
    if nulls == "drop":
        known = value.isNotNull() & positive.isNotNull() & ~F.isnan(value)
        every = rows.select(F.when(known, positive).alias("label"), F.when(known, value).alias("score"))
    else:
        every = rows.select(_insisted(positive, "the label").alias("label"), _insisted(value, "the score").alias("score"))
    scores = every.groupBy("score").agg(
        F.count("score").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"), F.count(F.lit(1)).alias("all")
    )
    placed = running_sums(scores, [], "score", ["n"])
    mean_rank = F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)
    sums = placed.agg(
        F.sum("positives").cast("double").alias("p"),
        F.sum("n").cast("double").alias("all"),
        F.sum(F.col("positives") * mean_rank).alias("ranks"),
        F.sum(F.when(F.col("score").isNull(), F.col("all"))).alias("missing"),
    )
    p, negatives = F.col("p"), F.col("all") - F.col("p")
    area = F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * negatives)
    missing = [F.coalesce("missing", F.lit(0)).alias("dropped")] if nulls == "drop" else []
    return sums.select(area.alias("roc_auc"), *missing)


def keyed_roc_auc(rows: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve per key, such as one model each, in one pass.

    Scores are counted and positioned as in ``roc_auc``, so a key may hold any
    share of the rows. A null or NaN fails the job; a key with one class has none.
    """
    value, positive = _insisted(F.col(score), "the score"), _insisted(F.col(label), "the label")
    scores = rows.select(*keys, positive.cast("long").alias("_label"), value.alias("_score")).groupBy(*keys, "_score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_label").alias("positives")
    )
    placed = running_sums(scores, keys, "_score", ["n"])
    mean_rank = F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)
    sums = placed.groupBy(*keys).agg(
        F.sum("positives").cast("double").alias("p"), F.sum("n").cast("double").alias("all"), F.sum(F.col("positives") * mean_rank).alias("ranks")
    )
    p, negatives = F.col("p"), F.col("all") - F.col("p")
    return sums.select(*keys, F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * negatives).alias("roc_auc"))
