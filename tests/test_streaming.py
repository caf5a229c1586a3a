"""Event-time windows in batch, and stateful streams run to the end of their input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillframe.streaming import stateful as K
from rillframe.streaming import windows as E

T0 = dt.datetime(2024, 1, 1)


def timed(spark, offsets):
    return spark.createDataFrame([(i + 1, T0 + dt.timedelta(milliseconds=m)) for i, m in enumerate(offsets)], "value bigint, ts timestamp")


def test_windows(spark):
    df = timed(spark, [10 * i for i in range(1, 11)])
    got = [r["values"] for r in E.tumbling(df, "35 milliseconds").orderBy("start").collect()]
    assert sum(got, []) == list(range(1, 11)) and all(got)
    slid = E.sliding(df, "40 milliseconds", "20 milliseconds", F.count(F.lit(1)).alias("n")).agg(F.sum("n")).first()[0]
    assert slid == 20


def test_sessions_debounce_sample(spark):
    df = timed(spark, [10, 20, 30, 90, 100])
    assert [r["values"] for r in E.session(df, "30 milliseconds").orderBy("start").collect()] == [[1, 2, 3], [4, 5]]
    assert [r["values"] for r in E.session(df.withColumn("k", F.lit(1)), "30 milliseconds", by=["k"]).orderBy("start").collect()] == [[1, 2, 3], [4, 5]]
    assert sorted(r.value for r in E.debounce(df, "30 milliseconds").collect()) == [3, 5]
    assert [r.value for r in E.sample(df, "50 milliseconds").orderBy("start").collect()] == [3, 4, 5]


def test_timeouts(spark):
    s = E.timeout_gaps(timed(spark, [0, 30, 80]), "20 milliseconds")
    assert [r.ok for r in s.df.orderBy(*s.order).collect()] == [True, False, True, False, False, True]
    assert E.rate_limit(timed(spark, [0]), 0).count() == 0


def test_timeouts_of_equal_times(spark):
    """A row at the time of the one before, or without a time, comes once."""
    df = timed(spark, [0, 0, 0, 30, 30]).union(spark.createDataFrame([(9, None), (10, None)], "value bigint, ts timestamp"))
    rows = E.timeout_gaps(df, "20 milliseconds").df.collect()
    assert sorted(r.value for r in rows if r.ok) == [1, 2, 3, 4, 5, 9, 10] and [r.ts for r in rows if not r.ok] == [T0 + dt.timedelta(milliseconds=20)]


@pytest.fixture
def stream(spark, tmp_path):
    def start(rows, schema, build, watermark=None):
        for i, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if watermark:
            source = source.withWatermark("ts", watermark)
        name = f"t{abs(hash(str(tmp_path))) % 10**9}"
        build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    return start


def test_stream_scan_and_changes(stream):
    at = lambda m: T0 + dt.timedelta(milliseconds=m)
    rows = [[(1, 5, at(0)), (1, 5, at(1)), (2, 7, at(0)), (1, 6, at(2))]]
    got = stream(rows, "k bigint, value bigint, ts timestamp", lambda df: K.scan(df, ["k"], 0, lambda a, x: a + int(x), "bigint"))
    assert sorted((r.k, r.value) for r in got.collect()) == [(1, 5), (1, 10), (1, 16), (2, 7)]


def test_stream_scan_query(spark, tmp_path, monkeypatch):
    """As its SQL where a user has several rows at one time, or none; and no sink gathers the rows in the driver."""
    import duckdb
    from pyspark.sql.streaming import DataStreamWriter

    from rillframe.plans import ORACLES, QUERIES

    made = [(i, T0 + dt.timedelta(seconds=i // 4) if i % 11 else None, i % 3) for i in range(60)]
    spark.createDataFrame(made, "event_id bigint, ts timestamp_ntz, user_id bigint").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sinks, start = [], DataStreamWriter.format
    monkeypatch.setattr(DataStreamWriter, "format", lambda self, source: (sinks.append(source), start(self, source))[1])
    got = QUERIES["stream_scan"](spark, str(tmp_path)).select("user_id", "ts", "value").collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = con.execute(f"SELECT user_id, ts, value FROM ({ORACLES['stream_scan']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == 60
    assert sinks == ["parquet"]


def test_stream_distinct_until_changed(stream):
    at = lambda m: T0 + dt.timedelta(milliseconds=m)
    rows = [[(1, 5, at(0)), (1, 5, at(1)), (1, 6, at(2)), (1, 5, at(3))]]
    got = stream(rows, "k bigint, value bigint, ts timestamp", lambda df: K.distinct_until_changed(df, ["k"], "bigint"))
    assert [r.value for r in got.orderBy("ts").collect()] == [5, 6, 5]


def test_stream_debounce(stream):
    at = lambda m: T0 + dt.timedelta(milliseconds=m)
    rows = [[(1, 1, at(0)), (1, 2, at(10)), (1, 3, at(500))], [(2, 9, at(60_000))]]
    got = stream(rows, "k bigint, value bigint, ts timestamp", lambda df: K.debounce(df, ["k"], 100, "bigint"), "1 second")
    assert {(r.k, r.value) for r in got.collect()} >= {(1, 2)}


def test_stream_timeout(stream):
    at = lambda m: T0 + dt.timedelta(milliseconds=m)
    got = stream([[(1, 1, at(0)), (1, 2, at(250))]], "k bigint, value bigint, ts timestamp", lambda df: K.timeout(df, ["k"], 100, "bigint"), "1 second")
    assert [r.ok for r in got.where("at <= 1704067200250").orderBy("at").collect()] == [True, False, False, True]


def test_unbounded_sources(spark):
    """Streams by the clock, run until they have given rows; a bounded frame is no channel."""
    import time

    import pytest

    from rillframe.sources import memory as M

    def some(df, name):
        running = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(300):
                if spark.table(name).count() >= 3:
                    break
                time.sleep(0.2)
            return spark.table(name).collect()
        finally:
            running.stop()

    every = some(M.from_channel(M.interval(spark, 20)), "by_the_clock")
    assert sorted(r.value for r in every) == list(range(len(every))) and len(every) >= 3
    assert {r.value for r in some(M.from_channel_ctx(M.repeat_forever(spark, 7, 20)), "for_ever")} == {7}
    with pytest.raises(ValueError):
        M.from_channel(spark.range(3))
