"""Event-time windows over the events, and the same as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.plans.registry import Tables, query
from rillframe.session import scratch
from rillframe.streaming import windows as E


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


def _edges(df: DataFrame, *others: str) -> DataFrame:
    """Times as microseconds, which both engines compare alike."""
    return df.select(_micros("start"), _micros("end"), *others)


_N = "count(*) AS n, round(sum(value), 4) AS total"


def _aggregates() -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")


@query(f"SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start, epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) + 21600000000 AS end, {_N} FROM events GROUP BY 1, 2")
def tumbling(t: Tables):
    return _edges(E.tumbling(t.events, "6 hours", *_aggregates()), "n", "total")


@query(f"""SELECT epoch_us(s) AS start, epoch_us(s) + 14400000000 AS end, user_id, {_N} FROM
(SELECT *, unnest([b, b - INTERVAL 1 HOUR, b - INTERVAL 2 HOURS, b - INTERVAL 3 HOURS]) AS s FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY 1, 2, 3""")
def sliding(t: Tables):
    return _edges(E.sliding(t.events, "4 hours", "1 hour", *_aggregates(), by=["user_id"]), "user_id", "n", "total")


_RUNS = "SELECT *, sum(CASE WHEN was IS NULL OR ts > was + INTERVAL '{gap}' THEN 1 ELSE 0 END) OVER (ORDER BY {by}ts) AS run FROM (SELECT *, lag(ts) OVER ({part}ORDER BY ts) AS was FROM events)"


@query(f"SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 300000000 AS end, {_N} FROM ({_RUNS.format(gap='5 minutes', by='', part='')}) GROUP BY run")
def session(t: Tables):
    """Over all events: runs found in chunks of positions."""
    return _edges(E.session(t.events, "5 minutes", *_aggregates()), "n", "total")


@query(f"""SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 86400000000 AS end, user_id, {_N} FROM
(SELECT *, sum(CASE WHEN was IS NULL OR ts > was + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events)) GROUP BY user_id, run""")
def session_by_user(t: Tables):
    return _edges(E.session(t.events, "1 day", *_aggregates(), by=["user_id"]), "user_id", "n", "total")


@query("SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (ORDER BY ts) AS next FROM events) WHERE next IS NULL OR next > ts + INTERVAL 10 MINUTES")
def debounce(t: Tables):
    return E.debounce(t.events, "10 minutes").select("event_id")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS start, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def sample(t: Tables):
    return E.sample(t.events, "1 hour", value="event_id").select(_micros("start"), "event_id")


@query("""SELECT count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_late FROM
(SELECT true AS ok FROM events UNION ALL SELECT false FROM (SELECT unnest(range(CAST(greatest((epoch_us(ts) - epoch_us(was) - 1) // 300000000, 0) AS BIGINT))) FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS was FROM events) WHERE was IS NOT NULL))""")
def timeout_gaps(t: Tables):
    out = E.timeout_gaps(t.events, "5 minutes")
    return out.df.agg(F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("ok"), 1)).alias("n_late"))


@query("SELECT event_id, epoch_us(ts + INTERVAL 90 SECONDS) AS ts FROM events")
def delay(t: Tables):
    return E.delay(t.events, "90 seconds").select("event_id", _micros("ts"))


def _streamed(t: Tables, build, name: str, mode: str = "append") -> DataFrame:
    """The rows that a stream over the events table gives by the end of its input.

    Rows that are appended, as many as the input may have, go to files. A complete result, which a file sink doesn't take, is held by the
    driver: only for a few windows.
    """
    spark = t.spark
    source = spark.readStream.schema(t.events.schema).parquet(f"{t._folder}/events.parquet*")
    rows = build(source.withColumn("ts", F.col("ts").cast("timestamp")))
    if mode == "append":
        path = scratch(spark)
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/rows")
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    rows.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(table)


@query(f"SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start, {_N} FROM events GROUP BY 1")
def stream_tumbling(t: Tables):
    """Complete mode: the state after the last micro-batch."""
    return _streamed(t, lambda df: E.tumbling(df, "6 hours", *_aggregates()), "tumbling", "complete").select(_micros("start"), "n", "total")


@query("SELECT user_id, epoch_us(ts) AS ts, CAST(sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS value FROM events")
def stream_scan(t: Tables):
    from rillframe.streaming.stateful import scan

    out = _streamed(t, lambda df: scan(df.withColumn("value", F.col("event_id") % 10), ["user_id"], 0, lambda a, x: a + int(x), "bigint"), "scan")
    # of a user's rows at one time, all have the sum after the last of them, as in the SQL; it is the largest, as nothing added is below 0
    return out.select("user_id", _micros("ts"), F.max("value").over(Window.partitionBy("user_id", "ts")).alias("value"))
