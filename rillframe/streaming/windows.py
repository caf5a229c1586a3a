"""Event-time windows. Each function takes a frame with a timestamp column; on a streaming frame give a watermark and write in append mode.

The times are those in the rows and not those of arrival, so results don't depend on speed. Windows are [start, end), aligned to the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.ordered import IDX, Ordered, in_order


def _timed(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    if df.schema[ts].dataType.typeName() == "timestamp_ntz" and df.isStreaming:
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs a zone; sessions run in UTC
    return df.withWatermark(ts, watermark) if watermark and df.isStreaming else df


def _grouped(df: DataFrame, window: Column, by: list[str] | None, aggregates: tuple[Column, ...], value: str, ts: str) -> DataFrame:
    made = aggregates or (in_order(value, ts).alias("values"),)
    out = df.groupBy(window.alias("__w"), *(by or [])).agg(*made)
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *[c for c in out.columns if c != "__w"])


def new_timestamped(value: Column) -> Column:
    return F.struct(value.alias("value"), F.current_timestamp().alias("ts"))


def new_timestamped_at(value: Column, ts: Column) -> Column:
    return F.struct(value.alias("value"), ts.alias("ts"))


def with_timestamp(df: DataFrame, name: str = "ts") -> DataFrame:
    """With the time of the batch or micro-batch."""
    return df.withColumn(name, F.current_timestamp())


def tumbling(df: DataFrame, size: str, *aggregates: Column, by: list[str] | None = None, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(start, end, [by], aggregates or values): windows one after another; empty ones don't appear."""
    df = _timed(df, ts, watermark)
    return _grouped(df, F.window(ts, size), by, aggregates, value, ts)


def sliding(df: DataFrame, size: str, slide: str, *aggregates: Column, by: list[str] | None = None, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """Windows of one size that begin at each slide."""
    df = _timed(df, ts, watermark)
    return _grouped(df, F.window(ts, size, slide), by, aggregates, value, ts)


def session(df: DataFrame, gap: str, *aggregates: Column, by: list[str] | None = None, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """Runs of rows, in each group of `by`, that lie no more than `gap` apart.

    Without a group all rows are one chain; then the batch form finds breaks by the row before and numbers runs in chunks of positions,
    so that no task gets all rows.
    """
    if by or df.isStreaming:
        return _grouped(_timed(df, ts, watermark), F.session_window(ts, gap), by, aggregates, value, ts)
    from rillframe.operators.windows import running_sum

    span = F.expr(f"interval {gap}")
    s = Ordered(df, [ts]).over(1, 0, __was=lambda w: F.lag(ts).over(w))
    s = s.with_df(s.df.withColumn("__new", F.coalesce(F.col(ts) > F.col("__was") + span, F.lit(True)).cast("int")))
    runs = running_sum(s, "__new", "__run").df
    made = aggregates or (in_order(value, ts).alias("values"),)
    out = runs.groupBy("__run").agg(F.min(ts).alias("start"), (F.max(ts) + span).alias("end"), *made)
    return out.drop("__run")


def debounce(df: DataFrame, quiet: str, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Rows after which nothing comes for longer than `quiet` (in their group), and the last."""
    span = F.expr(f"interval {quiet}")
    if by:
        from pyspark.sql import Window

        rows = df.withColumn("__next", F.lead(ts).over(Window.partitionBy(*by).orderBy(ts)))
    else:
        rows = Ordered(df, [ts]).over(0, 1, __next=lambda w: F.lead(ts).over(w)).df
    return rows.where(F.col("__next").isNull() | (F.col("__next") > F.col(ts) + span)).drop("__next", IDX)


def sample(df: DataFrame, every: str, by: list[str] | None = None, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(start, end, [by], value): the last value of each tick that has one."""
    df = _timed(df, ts, watermark)
    return _grouped(df, F.window(ts, every), by, (F.max_by(value, ts).alias(value),), value, ts)


def timeout_gaps(df: DataFrame, limit: str, ts: str = "ts", value: str = "value") -> Ordered:
    """(ok, value, err, ts): each row, and before it an error for each time that `limit` passed since the row before."""
    span = F.expr(f"interval {limit}")
    s = Ordered(df, [ts]).over(1, 0, __was=lambda w: F.lag(ts).over(w))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    length = micros(F.timestamp_seconds(F.lit(0)) + span)
    # greatest() passes over nulls: none is missed before the first row, at the same time or beside a row without one
    missed = F.greatest(F.floor((micros(F.col(ts)) - micros(F.col("__was")) - 1) / length), F.lit(0)).cast("int")
    k = F.explode(F.sequence(F.lit(0), missed))
    rows = s.df.withColumn("__missed", missed).withColumn("__k", k)
    late = F.col("__k") < F.col("__missed")
    out = rows.select(
        (~late).alias("ok"), F.when(~late, F.col(value)).alias("value"), F.when(late, F.lit("deadline exceeded")).alias("err"),
        F.when(late, F.col("__was") + (F.col("__k") + 1) * span).otherwise(F.col(ts)).alias("ts"), IDX, "__k",
    )
    return Ordered(out, [IDX, "__k"])


def delay(df: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """Rows at a later event time."""
    return df.withColumn(ts, F.col(ts) + F.expr(f"interval {by}"))


delay_ctx = delay


def throttle(df: DataFrame, interval: str | None = None) -> DataFrame:
    """Rows as they are: pace belongs to the trigger; see paced()."""
    return df


throttle_ctx = throttle


def rate_limit(df: DataFrame, n: int, per: str | None = None) -> DataFrame:
    """No rows if n <= 0, else rows as they are; see paced()."""
    return df if n > 0 else df.limit(0)


rate_limit_ctx = rate_limit


def paced(writer, interval: str):
    """A stream writer that starts a micro-batch at most once in each interval."""
    return writer.trigger(processingTime=interval)


tumbling_time_window, sliding_time_window, session_window = tumbling, sliding, session
