"""The window plan and the split plan must agree, also with a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from apexframe import session
from apexframe.operators import groups

KEYS = ["a", "b"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, a third of these copies of one row."""
    rng = np.random.default_rng(7)
    n = 6000
    a = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))
    v = np.round(rng.normal(0, 1000, n), 1)
    v[np.arange(n) % 9 == 0] = 5.0
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": np.where(a == 0, "x", "y"), "v": v})
    pdf.loc[pdf.id % 101 == 0, "v"] = np.nan
    rows = [
        (int(r.id), None if r.id % 211 == 0 else int(r.a), r.b, None if np.isnan(r.v) else float(r.v))
        for r in pdf.itertuples()
    ]
    df = spark.createDataFrame(rows, "id long, a int, b string, v double")
    pdf = pdf.assign(a=pdf.a.where(pdf.id % 211 != 0))
    return df, pdf


def compare(df, out, expected):
    got = df.select("id", out).toPandas().set_index("id")[out].sort_index().astype(float)
    pd.testing.assert_series_equal(got, expected.astype(float), check_names=False, check_index_type=False)


def test_rank(skewed):
    df, pdf = skewed
    expected = pdf.groupby(KEYS).v.rank(method="min")
    out = groups.group_rank(df, KEYS, "v", "r")
    assert out.count() == len(pdf)
    compare(out, "r", expected)


def test_max_and_median(skewed):
    df, pdf = skewed
    compare(groups.group_max(df, KEYS, "v", "m"), "m", pdf.groupby(KEYS).v.transform("max"))
    compare(groups.group_median(df, KEYS, "v", "m"), "m", pdf.groupby(KEYS).v.transform("median"))


def test_median_table(skewed):
    df, pdf = skewed
    got = groups.median_table(df, KEYS, "v", "m").toPandas().sort_values(KEYS).m.to_numpy()
    assert np.array_equal(got, pdf.groupby(KEYS).v.median().sort_index().to_numpy())


def test_rank_without_keys(skewed):
    df, pdf = skewed
    compare(groups.group_rank(df, [], "v", "r"), "r", pdf.v.rank(method="min"))


def test_running_sums(skewed):
    df, pdf = skewed
    sums = df.dropna().groupBy(*KEYS, "v").agg(F.count("id").alias("n"))
    got = groups.running_sums(sums, KEYS, "v", ["n"]).toPandas().sort_values([*KEYS, "v"])
    want = pdf.dropna().groupby([*KEYS, "v"]).size().rename("n").reset_index()
    below = want.groupby(KEYS).n.cumsum() - want.n
    assert got.n_below.tolist() == below.tolist()
    assert got.n_total.tolist() == want.groupby(KEYS).n.transform("sum").tolist()


def test_even_median_is_interpolated(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 4, 10)], "k int, v double")
    assert groups.group_median(df, ["k"], "v", "m").first().m == 3.0


def test_missing_values_and_zeros(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0), (1, 2.0), (1, nan), (1, None), (2, nan), (2, None), (3, -0.0), (3, 0.0), (3, inf), (3, -inf), (None, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    out = groups.group_rank(groups.group_median(groups.group_max(df, ["k"], "v", "top"), ["k"], "v", "m"), ["k"], "v", "r")
    got = sorted((r.k or 0, str(r.v), r.top, r.m, r.r) for r in out.collect())
    assert got == sorted([
        (0, "1.0", None, None, None), (1, "1.0", 2.0, 1.5, 1), (1, "2.0", 2.0, 1.5, 2), (1, "nan", 2.0, 1.5, None),
        (1, "None", 2.0, 1.5, None), (2, "nan", None, None, None), (2, "None", None, None, None),
        (3, "-0.0", inf, 0.0, 2), (3, "0.0", inf, 0.0, 2), (3, "inf", inf, 0.0, 4), (3, "-inf", inf, 0.0, 1),
    ])


def test_ranks_outgrow_32_bits(spark):
    counts = spark.createDataFrame([(1, 1.0, 3_000_000_000), (1, 2.0, 1)], "k int, v double, n long")
    rows = groups.running_sums(counts, ["k"], "v", ["n"]).orderBy("v").collect()
    assert [(r.n_below, r.n_total) for r in rows] == [(0, 3_000_000_001), (3_000_000_000, 3_000_000_001)]


def test_ranks_of_several_values_in_one_pass(skewed):
    df, pdf = skewed
    df = df.withColumn("w", -F.col("v"))
    out = groups.group_ranks(df, KEYS, {"v": "r", "w": "s"})
    assert out.columns == [*df.columns, "r", "s"] and out.count() == len(pdf)
    compare(out, "r", pdf.groupby(KEYS).v.rank(method="min"))
    compare(out, "s", pdf.groupby(KEYS).v.rank(method="min", ascending=False))
    with pytest.raises(ValueError, match="several types"):
        groups.group_ranks(df, KEYS, {"v": "r", "id": "s"})


def test_sums_shuffle_the_ranges_once(skewed):
    df, _ = skewed
    counts = df.dropna().groupBy(*KEYS, "v").agg(F.count("id").alias("n"))
    text = groups.running_sums(counts, KEYS, "v", ["n"])._jdf.queryExecution().executedPlan().toString()
    # The staged ranges are read as buckets. What is shuffled or broadcast is the
    # edges: the only exchanges lie on the build side of the join.
    rows_side = text.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in rows_side and text.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in text


def test_edges_are_two_rows_a_partition_at_most(skewed):
    df, pdf = skewed
    counts = df.dropna().groupBy(*KEYS, "v").agg(F.count("id").alias("n"))
    dealt = counts.repartitionByRange(5, *KEYS, "v").withColumn("_range", F.spark_partition_id())
    edges = groups._edges(dealt, KEYS, ["n"])
    assert 5 <= edges.count() <= 10
    hot = edges.filter("a = 0").orderBy("_range").collect()
    assert len(hot) > 1 and hot[0]["_n_lower"] == 0
    assert {r["_n_whole"] for r in hot} == {int((pdf.dropna().a == 0).sum())}


def test_staged_tables_leave_the_catalog(spark, skewed):
    before = {t.name for t in spark.catalog.listTables()}
    groups.group_rank(skewed[0], KEYS, "v", "r").count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_bucket_holds_one_range(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("v"))
    staged = session.stage_ranges(df, ["v"], "_range")
    tasks = staged.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("_range").alias("n")).collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and {t["n"] for t in tasks} == {1}
    ranges = staged.groupBy("_range").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_range").collect()
    assert all(a["high"] < b["low"] for a, b in zip(ranges, ranges[1:], strict=False))


def test_derived_measures_are_summed_but_not_staged(spark):
    sums = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 4, 1), (2, 5, 1)], "k int, v int, n long")
    placed = groups.running_sums(sums, ["k"], "v", ["n"], {"s": F.col("n") * F.col("v")}).orderBy("k", "v")
    assert "s" not in placed.columns
    got = [(r["n_below"], r["n_total"], r["s_below"], r["s_total"]) for r in placed.collect()]
    assert got == [(0, 6, 0, 12), (2, 6, 2, 12), (5, 6, 8, 12), (0, 1, 0, 5)]
