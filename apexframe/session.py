"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the plans count on. Spark sets most of them by default.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that exists already."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "apexframe", cores: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, as in tests, may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="apexframe-checkpoint-"))
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Address of a new folder, not yet made, in the application's own folder under
    the shared one, which is deleted when the application ends. It names its file
    system, so that what reads it without Spark looks in the same place."""
    context = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/apexframe-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    own = files.makeQualified(path).toString()
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder, so that several readers share
    the result and a lost executor costs no recomputation.

    The copy is Parquet, so readers only fetch the columns they need.
    """
    folder = scratch_dir(df.sparkSession, "stage")
    df.write.parquet(folder)
    # The schema is given, so nothing is read to infer it.
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_APART: dict[int, list[int]] = {}


def range_names(spark: SparkSession, buckets: int) -> list[int]:
    """Rising numbers, one for each bucket: no two of them meet in a bucket."""
    tried = 32 * buckets
    while buckets not in _APART:
        numbers = spark.range(0, tried, 1, 1).select(F.col("id").cast("int").alias("x"))
        firsts = numbers.groupBy(F.pmod(F.hash("x"), F.lit(buckets))).agg(F.min("x")).collect()
        if len(firsts) == buckets:
            _APART[buckets] = sorted(row[1] for row in firsts)
        tried *= 2
    return _APART[buckets]


def stage_ranges(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """``stage`` with the rows laid out in ranges of the columns ``by``, which are
    named in the new column ``column``, in rising order. The rows are bucketed by
    it, so that readers group by it, or by it and more columns, without a shuffle.
    A bucket holds one range, so that no reader's task has to take several.

    Spark keeps buckets for tables of the catalog only. The table has its files in
    the staging folder and leaves the catalog at once; the files stay.
    """
    spark = df.sparkSession
    name = f"apexframe_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    names = F.lit(range_names(spark, buckets))
    df = df.repartitionByRange(buckets, *by).withColumn(column, names[F.spark_partition_id()])
    writer = df.write.format("parquet").option("path", scratch_dir(spark, "ranges"))
    writer.bucketBy(buckets, column).saveAsTable(name)
    staged = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return staged
