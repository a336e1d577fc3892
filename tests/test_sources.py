"""Readers and sinks on small CSV files."""

import pytest

from seriesloom.sources import readers, schemas, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_header_csv_by_name(spark, tmp_path):
    path = write(tmp_path / "p.csv", 'extra,b,a\nq,"x, ""y""",1\nq,z,oops\n')
    df = readers.read_csv(spark, path, "a int, b string")
    assert df.dtypes == [("a", "int"), ("b", "string")]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted([(1, 'x, "y"'), (None, "z")], key=str)
    with pytest.raises(ValueError, match="nothere"):
        readers.read_csv(spark, path, "nothere int")


def test_scan_reads_wanted_columns_only(spark, tmp_path):
    path = write(tmp_path / "p.csv", "a,b,c\n1,2,3\n")
    plan = readers.read_csv(spark, path, "b int")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:string>" in plan


def test_tree_is_one_table(spark, tmp_path):
    for i, folder in enumerate(("01", "01/02", "03")):
        write(tmp_path / "tree" / folder / f"f{i}.csv", f"a,b\n{i},x\n")
    df = readers.read_csv_tree(spark, str(tmp_path / "tree"), "a int, b string")
    assert sorted(r["a"] for r in df.collect()) == [0, 1, 2]


def test_positional_csv(spark, tmp_path):
    path = write(tmp_path / "cases.csv", "03/01/2020,Adams,Ohio,39001,1,0\n25/03/2020,Adams,Ohio,,x,0\nshort\n")
    raw = readers.read_positional_csv(spark, path, schemas.CASES_US, corrupt="bad_line")
    parsed = readers.typed(raw, {"Confirmed_Cases": "long", "Deaths": "long"}, {"Date": schemas.CASE_DATE_FORMAT})
    rows = parsed.collect()
    assert str(rows[0]["Date"]) == "2020-03-01" and rows[0]["Confirmed_Cases"] == 1
    assert rows[1]["Date"] is None and rows[1]["Confirmed_Cases"] is None and rows[1]["fips_code"] is None
    assert [r["bad_line"] for r in rows] == [None, None, "short"]
    lost = {r["column"]: r["unreadable"] for r in readers.unreadable_counts(
        raw, parsed, ["Date", "Confirmed_Cases", "Deaths"]).collect()}
    assert lost == {"Date": 2, "Confirmed_Cases": 1, "Deaths": 0}


def test_save_and_drop_tables(spark):
    df = spark.range(3)
    sinks.save_result(df, "granger_result_table", "overwrite")
    sinks.save_result(df, "granger_result_table", "overwrite")
    assert spark.table("granger_result_table").count() == 3
    sinks.drop_results(spark)
    assert not spark.catalog.tableExists("granger_result_table")
    sinks.drop_results(spark, ["granger_result_table"])


def test_save_parquet(spark, tmp_path):
    sinks.save_parquet(spark.range(4).selectExpr("id", "id % 2 AS k"), str(tmp_path / "out"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "out")).where("k = 1").count() == 2


def test_schema_report(spark):
    rows = sinks.schema_report({"a": spark.range(1), "b": spark.sql("SELECT 1 AS x, 'y' AS z")}).collect()
    assert [(r["dataset"], r["position"], r["column"], r["type"]) for r in rows] == [
        ("a", 0, "id", "bigint"), ("b", 0, "x", "int"), ("b", 1, "z", "string")]


def test_files_with_different_column_orders_are_united_by_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two.csv").write_text("b,a\n2,1\n")
    deep = tmp_path / "deep"
    deep.mkdir()
    (deep / "three.csv").write_text("c,b,a\n9,2,1\n8,2,1\n")
    rows = readers.read_csv_tree(spark, str(tmp_path), "a int, b int").collect()
    assert [tuple(r) for r in rows] == [(1, 2)] * 4


def test_a_list_of_paths_is_one_table(spark, tmp_path):
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"{i}.csv"))
        (tmp_path / f"{i}.csv").write_text(f"a\n{i}\n")
    assert sorted(r.a for r in readers.read_csv(spark, paths, "a int").collect()) == [0, 1, 2]
    (tmp_path / "4.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, [*paths, str(tmp_path / "4.csv")], "a int")


class Counting:
    """A stream that counts the bytes read from it."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        piece = self.data[self.at:self.at + n]
        self.at += len(piece)
        return piece


@pytest.mark.parametrize("size", [10, 10_000, 5_000_000])
def test_probe_reads_the_same_bytes_of_any_file(size):
    stream = Counting(b"\n \r\na,b\n" + b"1,2\n" * size)
    assert readers.first_line(stream) == "a,b" and stream.at <= readers.PROBE_BYTES
    long_header = ",".join(f"column{i}" for i in range(20_000))
    assert readers.first_line(Counting(f"{long_header}\r\n1".encode())) == long_header
    assert readers.first_line(Counting(b"\xef\xbb\xbfa,b")) == "a,b" and readers.first_line(Counting(b" \n\n")) is None


def test_headers_of_odd_files(spark, tmp_path):
    import gzip
    folder = tmp_path / "with space"
    write(folder / "one.csv", "\n\na,b\n1,2\n")
    write(folder / "empty.csv", "")
    write(folder / "_hidden.csv", "x\n1\n")
    with gzip.open(folder / "two.csv.gz", "wt") as f:
        f.write("b,a\n2,1\n")
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(folder), "a int, b int").collect()) == [(1, 2)] * 2


def test_probe_lists_without_reading_and_falls_back(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "p.csv", "a,b\n1,2\n")
    plan = readers.first_lines(spark, [path], False)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "text" not in plan
    monkeypatch.setattr(readers, "first_lines", lambda spark, paths, recursive: spark.createDataFrame(
        [(f"file:{path}", None, False)], "file string, header string, opened boolean"))
    assert [tuple(r) for r in readers.read_csv(spark, path, "b int").collect()] == [(2,)]
