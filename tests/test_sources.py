import pytest
from fixtures import clock, small_dump

from apexframe.plans import build, mainrace, qualifying, rebuild, status
from apexframe.schemas import DUMP
from apexframe.sources import dump as raw
from apexframe.sources import tables

ENTRIES = [
    (1, 20, 1, "t", 1, "01:30:00", 12),
    (2, 20, 2, "f", 2, "01:31:00", 12),
    (3, 30, 1, "t", 1, "01:30:00", 12),
    (4, 21, 1, "t", None, None, None),
]
LAPS = [(e, n, clock(5000 + n)) for e in (1, 2, 3) for n in range(12)] + [(4, 1, clock(80000))]


@pytest.fixture(scope="module")
def dump(spark):
    return small_dump(spark, ENTRIES, LAPS)


@pytest.fixture(scope="module")
def folder(dump, tmp_path_factory):
    """The dump as CSV files, with the columns in another order and one extra."""
    root = tmp_path_factory.mktemp("raw")
    for name, df in dump.tables().items():
        columns = [*reversed(df.columns)]
        pdf = df.select(*columns).toPandas().astype(object)
        pdf = pdf.where(pdf.notna(), None)
        pdf["wikipedia"] = "a, page"
        pdf.to_csv(root / f"formula_one_{name}.csv", index=False)
    return root


def read(spark, folder):
    return raw.read_dump(
        spark, str(folder), str(folder / "formula_one_weather.csv"), str(folder / "formula_one_circuit_type.csv")
    )


def test_read_dump(spark, dump, folder):
    loaded = read(spark, folder)
    for name in DUMP:
        assert getattr(loaded, name).schema.simpleString() == getattr(dump, name).schema.simpleString(), name
    assert sorted(mainrace.training(loaded).collect()) == sorted(mainrace.training(dump).collect())


def test_missing_column_fails_early(spark, folder):
    with pytest.raises(ValueError, match="no_such"):
        raw.read_csv(spark, str(folder / "formula_one_lap.csv"), "number int, no_such string")


def test_csv_reads_only_what_is_needed(spark, folder):
    plan = raw.read_csv(spark, str(folder / "formula_one_lap.csv"), "number int")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<number:string>" in text


def test_text_table(spark, folder):
    df = raw.read_text_table(spark, str(folder / "formula_one_driver.csv"), ("reference",))
    assert {f.dataType.simpleString() for f in df.schema} == {"string"} and df.count() == 4
    empty = raw.read_text_table(spark, str(folder / "nothing.csv"), ("driverRef", "driver_nationality"))
    assert empty.columns == ["driverRef", "driver_nationality"] and empty.count() == 0


def test_options(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, None)], "ref string, n int")
    tables.write(df, str(tmp_path / "fallback"), "csv")
    got = tables.read_options(spark, str(tmp_path / "primary"), str(tmp_path / "fallback"), "csv")
    assert [tuple(r) for r in got.collect()] == [("a", "1")] or ("", "") in [tuple(r) for r in got.collect()]
    tables.write(df.limit(1), str(tmp_path / "primary"), "csv")
    got = tables.read_options(spark, str(tmp_path / "primary"), str(tmp_path / "fallback"), "csv")
    assert [tuple(r) for r in got.collect()] == [("a", "1")]
    with pytest.raises(FileNotFoundError):
        tables.read_options(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_build_all(spark, dump, tmp_path):
    root = str(tmp_path / "processed")
    build.build_all(dump, root)
    back = tables.read_training(spark, root, "mainrace")
    want = mainrace.training(dump)
    assert back.columns == want.columns
    assert sorted(back.collect()) == sorted(want.collect())
    assert tables.read_training(spark, root, "qualifying").count() == 1
    assert tables.read_dimensions(spark, root)["drivers"].count() == 2
    picks = tables.read_pick_lists(spark, f"{root}/pick_lists", "status")
    assert {r.circuitRef for r in picks["circuits"].collect()} == {"silverstone", "monza"}


def test_years_are_pruned(spark, dump, tmp_path):
    tables.write_training(status.training(dump), str(tmp_path), "status")
    late = tables.read_training(spark, str(tmp_path), "status", year_from=1990)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(race_year" in plan
    assert late.count() == 0


def test_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,word,day,x\n1,a,2020-01-01,1.5\nx,b,2020-13-01,\n3.0,"",,"two"\n""," ",2020-01-02,3\n')
    (tmp_path / "b.csv").write_text("n,word,day,x\nx,c,2020-01-01,1\n5,d\n6,e,2020-01-01,1,2\nx,f,2020-01-01,1\n")
    got = raw.csv_rejects(spark, str(tmp_path), "n int, word string, day date, x double")
    assert sorted(tuple(r) for r in got.fillna("-", ["column"]).collect()) == [
        ("a.csv", "field", "day", "2020-13-01", 1),
        ("a.csv", "field", "n", "x", 1),
        ("a.csv", "field", "x", "two", 1),
        ("b.csv", "field", "n", "x", 2),
        ("b.csv", "row", "-", "5,d", 1),
        ("b.csv", "row", "-", "6,e,2020-01-01,1,2", 1),
    ]
    # Only the columns that are asked for are looked at, but rows as a whole.
    assert {r.problem for r in raw.csv_rejects(spark, str(tmp_path), "word string").collect()} == {"row"}
    with pytest.raises(ValueError, match="no_such"):
        raw.csv_rejects(spark, str(tmp_path), "no_such int")


def test_rejects_of_a_dump(spark, folder):
    places = [str(folder / f"formula_one_{name}.csv") for name in ("weather", "circuit_type")]
    assert raw.dump_rejects(spark, str(folder), *places).count() == 0
    lap = (folder / "formula_one_lap.csv").read_text().splitlines()
    header, row = lap[0].split(","), lap[1].split(",")
    row[header.index("session_entry_id")] = "??"
    (folder / "bad_lap.csv").write_text("\n".join([lap[0], ",".join(row)]))
    assert raw.csv_rejects(spark, str(folder / "bad_lap.csv"), DUMP["lap"]).first().text == "??"


@pytest.mark.parametrize("task", ["mainrace", "status", "qualifying"])
def test_rebuilt_years_equal_a_full_build(spark, dump, tmp_path, task):
    root, source = str(tmp_path), {"mainrace": mainrace, "status": status, "qualifying": qualifying}[task]
    rebuild.build_years(dump, root, task, 1979)
    want = sorted(map(str, tables.read_training(spark, root, task).collect()))

    def stamps(before):
        return {
            p: p.stat().st_mtime_ns
            for p in tmp_path.rglob("*.parquet")
            if int(p.parent.name.split("=")[1]) < before
        }

    old = stamps(1985)
    rebuild.rebuild_years(dump, root, task, 1985, 1979)
    assert stamps(1985) == old
    assert sorted(map(str, tables.read_training(spark, root, task).collect())) == want
    assert sorted(map(str, source.training(dump, 1979).collect())) == want
    with pytest.raises(ValueError, match="starts in"):
        rebuild.rebuild_years(dump, root, task, 1970, 1979)


def test_replaced_years(spark, tmp_path):
    path = str(tmp_path / "t")

    def table(*rows):
        return spark.createDataFrame(rows, "v int, race_year int")

    tables.write_years(table((1, 2000), (2, 2001), (3, 2002)), path)
    tables.replace_years(table((4, 2001)), path, 2001)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 2000), (4, 2001)]
    with pytest.raises(ValueError, match="before 2001"):
        tables.replace_years(table((5, 2000)), path, 2001)
    tables.replace_years(table((4, 2001)).limit(0), path, 2001)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, 2000)]
