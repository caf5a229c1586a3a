"""Lines, CSV and TSV, and their writers."""

import io

import pytest
from pyspark.sql import functions as F

from rillframe.operators import effects as X
from rillframe.sources import memory as M
from rillframe.sources import text as C


def put(tmp_path, text, name="f.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def values(s, column="value"):
    return [r[column] for r in s.df.orderBy(*s.order).collect()]


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a,b,c\n1,2,3\n4,5,6")
    assert values(C.from_csv(spark, path)) == [["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"]]
    path = put(tmp_path, "name,age\nAlice,30\n\nBob,25\n", "h.csv")
    assert values(C.from_csv_with_header(spark, path), "record") == [{"name": "Alice", "age": "30"}, {"name": "Bob", "age": "25"}]
    assert values(C.from_csv_with_header(spark, put(tmp_path, "name,age", "only.csv")), "record") == []
    assert values(C.from_csv_with_header(spark, put(tmp_path, "a,a\n1,2", "twice.csv")), "record") == [{"a": "2"}]
    assert values(C.from_tsv(spark, put(tmp_path, "a\tb\n1\t2", "t.tsv"))) == [["a", "b"], ["1", "2"]]
    assert values(C.from_csv(spark, put(tmp_path, 'x,"y ""q"", z"\n,', "q.csv"))) == [["x", 'y "q", z'], ["", ""]]


def test_bad_csv(spark, tmp_path):
    path = put(tmp_path, "a,b,c\n1,2\n3,4,5")
    assert values(C.from_csv(spark, path)) == [["a", "b", "c"]]
    assert values(C.from_csv_err(spark, path), "ok") == [True, False, True]
    assert len(values(C.from_csv(spark, put(tmp_path, 'a,b\n"unclosed,2', "u.csv")))) == 1
    empty = put(tmp_path, "", "e.csv")
    assert values(C.from_csv(spark, empty)) == []
    assert values(C.from_csv_with_header_err(spark, empty), "err") == ["EOF"]
    assert values(C.from_csv_with_header_err(spark, path), "ok") == [False, True]


def test_record_fields(spark):
    df = spark.createDataFrame([({"a": "", "b": "1"},)], "r map<string,string>")
    got = df.select(C.record_get("r", "z"), C.record_get_or("r", "a", "d"), C.record_get_or("r", "z", "d")).first()
    assert tuple(got) == ("", "", "d")


def test_lines(spark, tmp_path):
    assert values(C.from_lines(spark, put(tmp_path, "x\r\ny\n\nz", "l.txt"))) == ["x", "y", "", "z"]
    long = put(tmp_path, "ok\n" + "x" * 5000 + "\nafter\n", "long.txt")
    assert values(C.from_lines_err(spark, long, longest=100), "ok") == [True, False]
    df = spark.createDataFrame([("a\nb\r\nc\n",), ("",)], "s string")
    assert values(C.from_string_lines(df, "s")) == ["a", "b", "c"]
    assert values(C.from_runes(spark.createDataFrame([("aé😀",)], "s string"), "s")) == [97, 233, 0x1F600]
    assert values(C.from_bytes(spark.createDataFrame([("aé",)], "s string"), "s")) == [97, 0xC3, 0xA9]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.from_lines(spark, str(tmp_path / "none"))


def test_string_lines_as_sql(spark, tmp_path):
    """Empty texts, nulls and several line ends at the end."""
    import duckdb

    from rillframe.plans import ORACLES, QUERIES

    texts = ["", None, "\n", "\n\n", "a", "a\n", "a\n\n\n", "\n\na\nb\n", "a\r\n\r\n", "\r\n", "a\rb\n", "a \n "]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert [tuple(r) for r in QUERIES["string_lines"](spark, str(tmp_path)).collect()] == con.execute(ORACLES["string_lines"]).fetchall() == [(16,)]


def test_writers(spark, tmp_path):
    out = io.StringIO()
    C.to_writer(M.of(spark, 1, 2, 3), out, F.chr(F.col("value") + 96))
    assert out.getvalue() == "a\nb\nc\n"
    s = M.from_rows(spark, [(["a", "b"],), (["1", 'x,"y"'],)], "value array<string>")
    out = io.StringIO()
    C.to_csv(s, out)
    assert out.getvalue() == 'a,b\n1,"x,""y"""\n'
    C.to_csv_file(s, str(tmp_path / "out"))
    assert values(C.from_csv(spark, str(tmp_path / "out"))) == [["a", "b"], ["1", 'x,"y"']]


def test_effects(spark):
    s, seen = M.of(spark, 1, 2, 3), []
    X.for_each_indexed(s, lambda i, r: seen.append((i, r.value)))
    assert seen == [(0, 1), (1, 2), (2, 3)]
    assert isinstance(X.for_each_err(s, lambda r: ValueError("two") if r.value == 2 else None), ValueError)
    bad = s.with_df(s.df.withColumn("value", F.when(F.col("value") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("value"))))
    ok, rows, err = X.try_collect(bad)
    assert not ok and rows is None and "boom" in err
    assert X.with_context(s, lambda x: x.df.count(), seconds=60) == 3
    with X.using(s.df) as kept:
        assert kept.count() == 3


def test_records_over_lines(spark, tmp_path):
    """Line ends in quoted fields, blank ones too; broken quotes end at their line and the next record is read."""
    path = put(tmp_path, 'a,b\n"x\ny",1\n\n"\n\n""q"", z\r\n",2\nz,"2\n"\n', "lines.csv")
    assert values(C.from_csv(spark, path)) == [["a", "b"], ["x\ny", "1"], ['\n\n"q", z\n', "2"], ["z", "2\n"]]
    path = put(tmp_path, 'a,b\nx"y,1\nc,"d\ne"\n"f" g,1\nh,"i\n"j,2\nk,l\nm,"n\n', "broken.csv")
    assert [tuple(r) for r in C.from_csv_err(spark, path).df.orderBy("__record").select("ok", "value").collect()] == [(True, ["a", "b"]), (False, None), (True, ["c", "d\ne"]), (False, None), (False, None), (True, ["k", "l"]), (False, None)]
    path = put(tmp_path, 'n,t\n1,"' + "y" * 30000 + '\n""' + "z" * 30000 + '"\n', "long.csv")
    assert values(C.from_csv_with_header(spark, path), "record") == [{"n": "1", "t": "y" * 30000 + '\n"' + "z" * 30000}]


def test_records_over_chunks(spark, tmp_path, monkeypatch):
    """The scan's state goes over chunks and files, and files begin outside of quotes."""
    import rillframe.ordered as O

    monkeypatch.setattr(O.Ordered.chunked, "__defaults__", (0, 0, 2))
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text('a,"1\n2\n3\n4\n5",c\nd,"open\n\n')
    (folder / "2.csv").write_text('e,f,g\nh,"\n\n\n\n",i\n')
    got = C.from_csv_err(spark, str(folder)).df.orderBy("__record").select("value").collect()
    assert [r[0] for r in got] == [["a", "1\n2\n3\n4\n5", "c"], None, ["e", "f", "g"], ["h", "\n\n\n\n", "i"]]
