"""Forests fitted in parts.

A forest of hundreds of deep trees is fitted some trees at a time, so that only
the nodes of one part grow at once. Scaled and indexed features are made once and
kept as vectors. Every part is saved, with a record written after it; a fit that
is begun again in the same folder goes on behind the last record. The saved parts
are put together as tables of nodes and loaded as one ordinary forest.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.learning.pipelines import fit_last, is_classification, laid_out, learner, prepare, robust_scales, usable
from apexframe.schemas import TASKS
from apexframe.session import scratch_dir, stage
from apexframe.sources.dump import is_missing

# Seeds of the parts lie this far apart.
_SEED_STEP = 1_000_003


def part_sizes(trees: int, part_trees: int) -> list[int]:
    """Trees of each part: as few parts as needed, as even as can be."""
    if trees < 1 or part_trees < 1:
        raise ValueError("a forest and its parts have at least one tree")
    parts = -(-trees // part_trees)
    return [trees // parts + (k < trees % parts) for k in range(parts)]


def fit_parts(
    training: DataFrame,
    task: str,
    folder: str,
    part_trees: int = 50,
    nulls: str = "error",
    at_most: int | None = None,
    **settings,
) -> tuple[int, int]:
    """Fit the parts that ``folder`` lacks, ``at_most`` of them in this call, and
    return how many are there and how many there will be.

    ``folder`` belongs to one forest: other rows or settings than those it was
    begun with are an error. ``settings`` replace the learner's own.
    """
    spark, chosen = training.sparkSession, TASKS[task]
    forest = learner(task, "forest", **settings)
    sizes, seed = part_sizes(forest.getNumTrees(), part_trees), forest.getSeed()
    rows = stage(usable(training, task, nulls))
    begun = _description(rows, task, forest, part_trees, nulls)
    if _recorded(spark, folder, "vectors") is None:
        scales = robust_scales(rows, chosen.numeric)
        prepared = prepare(rows, task, scales, nulls == "impute")
        prepared.write().overwrite().save(f"{folder}/prepared")
        laid_out(prepared, rows, task).write.mode("overwrite").parquet(f"{folder}/vectors")
        _record(spark, folder, "vectors", begun)
    elif _recorded(spark, folder, "vectors") != begun:
        raise ValueError(f"{folder} holds a forest of other rows or settings")
    vectors = spark.read.parquet(f"{folder}/vectors")
    missing = [k for k in range(len(sizes)) if _recorded(spark, folder, f"part-{k}") is None]
    now = missing if at_most is None else missing[:at_most]
    for k in now:
        part = forest.copy({forest.numTrees: sizes[k], forest.seed: seed + k * _SEED_STEP})
        fit_last(part, vectors, task).write().overwrite().save(f"{folder}/part-{k}")
        _record(spark, folder, f"part-{k}", str(sizes[k]))
    return len(sizes) - len(missing) + len(now), len(sizes)


def fit_in_parts(training: DataFrame, task: str, folder: str, part_trees: int = 50, nulls: str = "error", **settings) -> PipelineModel:
    """All parts, those of an earlier call included, as one fitted pipeline."""
    _, parts = fit_parts(training, task, folder, part_trees, nulls, **settings)
    spark = training.sparkSession
    whole = merge_forests(spark, [f"{folder}/part-{k}" for k in range(parts)], is_classification(task))
    return PipelineModel(stages=[*PipelineModel.load(f"{folder}/prepared").stages, whole])


def merge_forests(spark: SparkSession, parts: Sequence[str], classification: bool) -> Model:
    """One forest of the trees of all saved forests.

    Trees get new numbers, part by part. All parts share features and settings.
    Its prediction is the mean over all trees, so parts count by their trees.
    """
    folder = scratch_dir(spark, "forest")
    headers = [json.loads(spark.read.text(f"{part}/metadata").first()[0]) for part in parts]
    for key in ("class", "numFeatures", "numClasses"):
        if len({h.get(key) for h in headers}) > 1:
            raise ValueError(f"the forests differ in {key}")
    trees = [h["numTrees"] for h in headers]
    merged = headers[0] | {"numTrees": sum(trees)}
    merged["paramMap"] = merged["paramMap"] | {"numTrees": sum(trees)}
    spark.range(1).select(F.lit(json.dumps(merged)).alias("value")).coalesce(1).write.text(f"{folder}/metadata")
    for name, number in (("treesMetadata", "_1"), ("data", "treeID")):
        whole, start = None, 0
        for part, n in zip(parts, trees):
            own = spark.read.parquet(f"{part}/{name}").withColumn(number, (F.col(number) + start).cast("int"))
            whole = own if whole is None else whole.unionByName(own)
            start += n
        whole.write.parquet(f"{folder}/{name}")
    kind = RandomForestClassificationModel if classification else RandomForestRegressionModel
    return kind.load(folder)


def _description(rows: DataFrame, task: str, forest, part_trees: int, nulls: str) -> str:
    """What a folder is for: the settings, and number and digest of the rows."""
    digest = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")
    n, total = rows.agg(F.count(F.lit(1)), digest).first()
    given = {p.name: v for p, v in forest.extractParamMap().items()}
    return json.dumps({"task": task, "rows": n, "digest": total, "part_trees": part_trees, "nulls": nulls, "settings": given}, sort_keys=True)


def _record(spark: SparkSession, folder: str, name: str, text: str) -> None:
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/{name}")


def _recorded(spark: SparkSession, folder: str, name: str) -> str | None:
    """The text of a record; none if it wasn't written to its end."""
    try:
        row = spark.read.schema("value string").parquet(f"{folder}/done/{name}").first()
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise
    return row and row["value"]
