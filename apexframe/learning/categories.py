"""Categories numbered by a table in place of labels in the driver.

A fitted indexer keeps every label in the driver and in the model. Here the
labels of all columns stand in one staged table, numbered by running sums over
the distinct values, and rows get their numbers by joins. The driver only learns
how many labels a column has. ``Encoder`` does so as a stage of a pipeline, which
is saved and loaded with it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from apexframe.learning import pipelines
from apexframe.operators.groups import running_sums
from apexframe.schemas import TASKS
from apexframe.session import scratch_dir, stage

# So many labels of a column are sent to every task; more meet the rows in a shuffle.
SENT_LABELS = 10_000


@dataclass(frozen=True)
class Dictionary:
    """``table``: column_name, value, place, a row for each label, numbered from 0 in
    the order of the labels. ``sizes``: the number of labels of each column."""

    table: DataFrame
    sizes: dict[str, int]

    @property
    def width(self) -> int:
        return sum(self.sizes.values())


def dictionary(rows: DataFrame, columns: Sequence[str]) -> Dictionary:
    """The labels of the columns, as text. Null is no label."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    labels = rows.select(pairs).dropna().distinct().withColumn("n", F.lit(1).cast("long"))
    placed = stage(running_sums(labels, ["column_name"], "value", ["n"]).select("column_name", "value", F.col("n_below").alias("place")))
    # A row for each column.
    found = {r["column_name"]: r["n"] for r in placed.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Dictionary(placed, {c: found.get(c, 0) for c in columns})


def elements(rows: DataFrame, known: Dictionary, first: int = 0) -> DataFrame:
    """Add ``element_<c>`` per column: the place of the row's label in a vector that
    holds the columns one after another from ``first`` on. Null for a label that
    the dictionary lacks, and for null."""
    for c, size in known.sizes.items():
        own = known.table.filter(F.col("column_name") == c)
        own = own.select(F.col("value").alias("_label"), (F.col("place") + first).cast("int").alias(f"element_{c}"))
        own = F.broadcast(own) if size <= SENT_LABELS else own
        rows = rows.join(own, F.col(c).cast("string") == F.col("_label"), "left").drop("_label")
        first += size
    return rows


def encode(
    rows: DataFrame, known: Dictionary, scales: Mapping[str, tuple[float, float]], impute: bool = False, parts: bool = False
) -> DataFrame:
    """Add ``features``, staged: the scaled numbers, then a one for each known label.
    With ``parts`` also ``numbers`` and ``ones``, the places of the ones.

    The layout is that of ``pipelines.build_pipeline``. Vectors are written as the
    columns that a sparse vector consists of and read again as vectors, so no row
    passes through Python and no column carries a list of its labels.
    """
    numbers = [(F.col(c).cast("double") - centre) / width for c, (centre, width) in scales.items()]
    if impute:
        numbers = [F.coalesce(x, F.lit(0.0)) for x in numbers]
    numbers = [F.coalesce(x, F.lit(float("nan"))) for x in numbers]
    n = len(numbers)
    placed = elements(rows, known, n)
    ones = F.array_compact(F.array(*[F.col(f"element_{c}") for c in known.sizes]))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(n + known.width).alias("size"),
        F.concat(F.array(*[F.lit(k) for k in range(n)]), ones).alias("indices"),
        F.concat(F.array(*numbers), F.array_repeat(F.lit(1.0), F.size(ones))).alias("values"),
    )
    more = [F.array(*numbers).alias("numbers"), ones.alias("ones")] if parts else []
    folder = scratch_dir(rows.sparkSession, "vectors")
    made = placed.select(*rows.columns, *more, vector.alias("features"))
    made.write.parquet(folder)
    schema = StructType([*made.schema.fields[:-1], StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(folder)


class Encoder(Transformer, MLWritable, MLReadable):
    """``encode`` as a stage of a pipeline, in place of scaler, indexer and assembler."""

    def __init__(self, known: Dictionary, scales: Mapping[str, tuple[float, float]], impute: bool) -> None:
        super().__init__()
        self.known, self.scales, self.impute = known, scales, impute

    @property
    def size(self) -> int:
        return len(self.scales) + self.known.width

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encode(dataset, self.known, self.scales, self.impute)

    def laid_out(self, rows: DataFrame) -> DataFrame:
        """The rows with ``features``, ``numbers`` and ``ones``."""
        made = encode(rows, self.known, self.scales, self.impute, parts=True)
        return made.withMetadata("features", {"ml_attr": {"num_attrs": self.size}})

    def elements(self) -> DataFrame:
        """place, feature, source: a row for each element of the feature vector."""
        spark, first, starts = self.known.table.sparkSession, len(self.scales), []
        for c, n in self.known.sizes.items():
            starts.append((c, first))
            first += n
        numbers = spark.createDataFrame([(k, c, c) for k, c in enumerate(self.scales)], "place int, feature string, source string")
        # A row for each column.
        labels = self.known.table.join(F.broadcast(spark.createDataFrame(starts, "column_name string, start int")), "column_name")
        place, name = (F.col("place") + F.col("start")).cast("int"), F.concat("column_name", F.lit("_"), "value")
        return numbers.unionByName(labels.select(place.alias("place"), name.alias("feature"), F.col("column_name").alias("source")))

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def saveImpl(self, path: str) -> None:
        own = self.encoder
        kept = {"sizes": list(own.known.sizes.items()), "scales": [(c, *x) for c, x in own.scales.items()], "impute": own.impute}
        DefaultParamsWriter.saveMetadata(own, path, self.sparkSession, {"kept": kept})
        own.known.table.write.parquet(f"{path}/labels")


class _EncoderReader(MLReader):
    def load(self, path: str) -> Encoder:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kept = metadata["kept"]
        table = self.sparkSession.read.parquet(f"{path}/labels")
        scales = {c: (centre, width) for c, centre, width in kept["scales"]}
        encoder = Encoder(Dictionary(table, dict(kept["sizes"])), scales, kept["impute"])
        return encoder._resetUid(metadata["uid"])


@dataclass(frozen=True)
class TabledModel:
    """A fitted estimator with its dictionary; it transforms rows as a pipeline does."""

    known: Dictionary
    scales: Mapping[str, tuple[float, float]]
    impute: bool
    last: Model

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.last.transform(encode(rows, self.known, self.scales, self.impute))


def fit(training: DataFrame, task: str, estimator: str = "logistic", nulls: str = "error", **settings) -> TabledModel:
    """``pipelines.fit`` with categories numbered by a table. What the estimator
    itself keeps, such as a coefficient for each element, stays in the driver."""
    chosen = TASKS[task]
    rows = stage(pipelines.usable(training, task, nulls))
    if estimator == "logistic" and "regParam" not in settings:
        settings["regParam"] = 1 / (pipelines.LOGISTIC_C * max(rows.count(), 1))
    known = dictionary(rows, chosen.categorical)
    scales, impute = pipelines.robust_scales(rows, chosen.numeric), nulls == "impute"
    last = pipelines.learner(task, estimator, **settings).fit(encode(rows, known, scales, impute))
    return TabledModel(known, scales, impute, last)
