from pyspark.sql import functions as F
import pytest

from apexframe import functions as fx


def values(spark, rows, ddl, *columns):
    out = spark.createDataFrame(rows, ddl).select(*columns).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in out]


@pytest.mark.parametrize(
    "text, ms, strict",
    [
        ("00:01:23.45", 83450, 83450),
        ("01:00:00", 3600000, 3600000),
        ("1:2:3", 3723000, 3723000),
        ("00:00:01.", 1000, 1000),
        ("00:00:01.456000", 457000, 1456),
        ("24:00:00", None, None),
        ("00:60:00", None, None),
        ("00:00:60", None, None),
        ("1:23.4", None, None),
        ("00:01:23.4.5", None, None),
        ("00:01:23\n", None, None),
        (" 00:01:23", None, None),
        ("99999999999999:1:1", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_time_to_ms(spark, text, ms, strict):
    t = F.col("t")
    got = values(spark, [(text,)], "t string", fx.time_to_ms(t), fx.time_to_ms(t, strict_fraction=True))
    assert got == [(ms, strict)]


def test_half_even(spark):
    rows = [(2.5,), (3.5,), (-0.5,), (1.4,), (None,)]
    assert values(spark, rows, "x double", fx.half_even(F.col("x"))) == [2.0, 4.0, 0.0, 1.0, None]


def test_flags(spark):
    rows = [("GBR", "GBR"), ("GBR", "ITA"), (None, None), ("GBR", None)]
    assert values(spark, rows, "a string, b string", fx.home_flag(F.col("a"), F.col("b"))) == [1, 0, 0, 0]
    weather = [("Rain",), ("rain",), ("Changeable",), ("Very changeable",), ("Dry",), (None,)]
    assert values(spark, weather, "w string", fx.rain_flag(F.col("w"))) == [1, 0, 1, 1, 0, 0]
    assert values(spark, [("t",), ("f",), (None,)], "c string", fx.dnf_label(F.col("c"))) == [0, 1, 1]


def test_dates(spark):
    rows = [("2020-03-01", "2020-02-01")]
    a, b = fx.parse_date(F.col("a")), fx.parse_date(F.col("b"))
    got = values(spark, rows, "a string, b string", fx.days_apart(b, a), fx.signed_days(b, a))
    assert got == [(29, -29)]
    assert values(spark, [("no date",)], "a string", fx.parse_date(F.col("a"), strict=False)) == [None]
    with pytest.raises(Exception):
        values(spark, [("no date",)], "a string", fx.parse_date(F.col("a")))


def test_text(spark):
    key = fx.race_id(F.lit(2023), F.lit(7), F.lit(4), F.lit("monza"))
    assert values(spark, [(1,)], "x int", key) == ["2023_7_4_monza"]
    assert values(spark, [("\t Hamilton \n",)], "s string", fx.strip(F.col("s"))) == ["Hamilton"]
    assert values(spark, [("x",), ("3",)], "s string", fx.lenient(F.col("s"))) == [None, 3.0]
    names = [("laps",), ("circuit_monza",), ("driver_home_1",), ("race_year",)]
    base = fx.base_feature(F.col("n"), ("laps", "race_year"))
    assert values(spark, names, "n string", base) == ["laps", "circuit", "driver", "race_year"]


def test_weights(spark):
    n = [(4,), (5,), (9,), (10,), (11,)]
    assert values(spark, n, "n int", fx.race_weight(F.col("n"))) == [0.2, 0.5, 0.5, 1.0, 1.0]
    assert values(spark, n, "n int", fx.position_weight(F.col("n"))) == [3, 3, 2, 2, 1]
