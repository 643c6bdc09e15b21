"""Reading and writing observation files."""

import datetime as dt

import pytest

from rulecast.operators.series import index_series
from rulecast.sources import observations as src


@pytest.fixture
def folder(tmp_path):
    for name, lines in {
        "ACME": ["2014/1/2\t10.5\t1\t2\t3\t4", "2014/12/31\t11\t1\t2\t3\t4\textra", "2015/1/5\t12\t-1e-3\t2\t3\t4"],
        "B+C d": ["2014/2/3\t7\t0\t0\t0\t0"],
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.txt").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_read(spark, folder):
    df = src.read_observations(spark, str(folder))
    assert df.columns == ["timestamp", "symbol", "price", "roc", "stod", "kdj", "macd"]
    rows = {(r["symbol"], r["timestamp"]): r["price"] for r in df.collect()}
    assert rows == {
        ("ACME/2014", dt.datetime(2014, 1, 2)): 10.5,
        ("ACME/2014", dt.datetime(2014, 12, 31)): 11.0,
        ("ACME/2015", dt.datetime(2015, 1, 5)): 12.0,
        ("B+C d/2014", dt.datetime(2014, 2, 3)): 7.0,
    }
    series = index_series(src.to_series_form(df))
    assert series.where("key = 'ACME/2014'").count() == 2
    assert series.columns == ["key", "i", "ts", "v0", "v1", "v2", "v3", "v4"]


@pytest.mark.parametrize("line", ["", "2014/1/2\t1\t2", "2014/13/2\t1\t2\t3\t4\t5", "2014/1/2\tx\t2\t3\t4\t5"])
def test_malformed(spark, folder, line):
    (folder / "ACME" / "bad.txt").write_text(line + "\n")
    with pytest.raises(Exception, match="malformed line"):
        src.read_observations(spark, str(folder)).collect()
    assert src.skip_malformed(spark, str(folder)).count() == 4
    rejects = src.read_observations(spark, str(folder), rejects=True).collect()
    assert [r["line"] for r in rejects] == [line]


def test_written_files_read_back(spark, folder, tmp_path):
    df = src.read_observations(spark, str(folder))
    target = str(tmp_path / "again")
    src.write_observations(
        df.selectExpr("split(symbol, '/')[0] as folder", "timestamp as ts", "price", "roc", "stod", "kdj", "macd"),
        target, ("price", "roc", "stod", "kdj", "macd"),
    )
    again = src.read_observations(spark, target)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def test_malformed_lines_stop_any_choice_of_columns(spark, folder):
    (folder / "ACME" / "bad.txt").write_text("2014/1/2\tx\t2\t3\t4\t5\n")
    df = src.read_observations(spark, str(folder))
    for action in (lambda: df.select("symbol", "price").collect(), df.count):
        with pytest.raises(Exception, match="malformed line"):
            action()


def test_folders_and_stray_files(spark, tmp_path):
    for name in ("x=B", "y=B", "folder=C"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.txt").write_text("2014/1/2\t1\t2\t3\t4\t5\n")
    (tmp_path / "stray.txt").write_text("2014/1/2\t1\t2\t3\t4\t5\n")
    rows = src.read_observations(spark, str(tmp_path)).collect()
    assert sorted(r["symbol"] for r in rows) == ["C/2014", "x=B/2014", "y=B/2014"]


def test_folders_by_name(spark, folder, tmp_path):
    """Only the named folders are opened: a malformed line elsewhere is not met."""
    (folder / "ACME" / "bad.txt").write_text("no line\n")
    one = src.read_observations(spark, str(folder), folders=["B+C d", "none"])
    assert [r["symbol"] for r in one.collect()] == ["B+C d/2014"]
    assert all("/ACME/" not in f for f in one.inputFiles())
    assert src.read_observations(spark, str(folder), folders=["none"]).count() == 0
    assert src.skip_malformed(spark, str(folder), folders=["ACME"]).count() == 3
    odd = ["a{b", "a*", "a", "x:y?", "p%q=r"]
    rows = spark.createDataFrame([(n, float(i)) for n in odd for i in range(40)], "folder string, v double")
    target = str(tmp_path / "odd")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # of such small tasks
    spark.conf.set(merging, "false")
    try:
        src.write_observations(rows.selectExpr("folder", "timestamp '2014-01-02' as ts", "v"), target, ("v",) * 5, rows_a_file=10)
    finally:
        spark.conf.unset(merging)
    counts = src.read_observations(spark, target).groupBy("symbol").count().collect()
    assert {tuple(r) for r in counts} == {(f"{n}/2014", 40) for n in odd}
    for name in odd:
        part = src.read_observations(spark, target, folders=[name])
        assert {r["symbol"] for r in part.collect()} == {f"{name}/2014"} and part.count() == 40
        assert len(part.inputFiles()) > 1
