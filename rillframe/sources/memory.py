"""Rows from values, generators and clocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from rillframe.ordered import Ordered

O = "__o"  # noqa: E741
_LONG_MAX = 2**63 - 1


def from_rows(spark: SparkSession, rows: Iterable, schema: str | StructType) -> Ordered:
    """Rows in the order given; a schema of one bare type makes rows of one column, `value`."""
    rows = list(rows)
    kind = schema if isinstance(schema, StructType) else _struct(spark, schema)
    body = [tuple(r) if isinstance(r, (tuple, list)) and len(kind) > 1 else r if isinstance(r, tuple) and len(r) == 1 else (r,) for r in rows]
    full = StructType([*kind.fields, StructField(O, LongType(), False)])
    return Ordered(spark.createDataFrame([(*r, i) for i, r in enumerate(body)], full), [O])


def _struct(spark: SparkSession, ddl: str) -> StructType:
    kind = DataType.fromDDL(ddl)
    return kind if isinstance(kind, StructType) else StructType([StructField("value", kind)])


def of(spark: SparkSession, *values, kind: str = "bigint") -> Ordered:
    return from_rows(spark, values, kind)


from_slice = from_rows


def from_frame(df: DataFrame, *order: str) -> Ordered:
    """Any frame with columns that order it."""
    return Ordered(df, list(order))


def pairs_of(spark: SparkSession, pairs: Iterable[tuple], key: str = "string", value: str = "bigint") -> Ordered:
    """Key/value rows; keys may repeat."""
    return from_rows(spark, pairs, f"key {key}, value {value}")


from2 = pairs_of


def from_map(spark: SparkSession, entries: dict, key: str = "string", value: str = "bigint") -> DataFrame:
    """Key/value rows of a dictionary, in no order."""
    return spark.createDataFrame(list(entries.items()), f"key {key}, value {value}")


def empty(spark: SparkSession, kind: str = "bigint") -> Ordered:
    return from_rows(spark, [], kind)


def empty2(spark: SparkSession, key: str = "string", value: str = "bigint") -> Ordered:
    return pairs_of(spark, [], key, value)


def range_(spark: SparkSession, start: int, end: int) -> Ordered:
    """start to end - 1; none if start >= end."""
    return Ordered(spark.range(start, max(start, end)).select(F.col("id").alias("value"), F.col("id").alias(O)), [O])


def range_closed(spark: SparkSession, start: int, end: int) -> Ordered:
    """start to end; none if start > end."""
    if end == _LONG_MAX:
        raise ValueError("the last value of 64 bits can't be an end")
    return range_(spark, start, end + 1)


def generate(spark: SparkSession, n: int, value: Callable[[Column], Column]) -> Ordered:
    """n rows of value(position). For state from row to row use iterate()."""
    return Ordered(spark.range(max(n, 0)).select(value(F.col("id")).alias("value"), F.col("id").alias(O)), [O])


def generate_rows(spark: SparkSession, n: int, supplier: Callable[[], object], kind: str = "bigint") -> Ordered:
    """n calls of a Python supplier, made on the driver one after another, since it may hold state."""
    return from_rows(spark, (supplier() for _ in range(max(n, 0))), kind)


def iterate(spark: SparkSession, seed: Column, step: Callable[[Column], Column], n: int) -> Ordered:
    """seed, step(seed), step(step(seed)), … n values, of any column function."""
    if n <= 0:
        return Ordered(spark.range(0).select(seed.alias("value"), F.col("id").alias(O)), [O])
    values = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>"), F.array(seed), lambda acc, _: F.concat(acc, F.array(step(F.element_at(acc, -1)))))
    return Ordered(spark.range(1).select(F.posexplode(values).alias(O, "value")).select("value", F.col(O).cast("long").alias(O)), [O])


def repeat(spark: SparkSession, value, n: int) -> Ordered:
    """The value n times; none if n <= 0."""
    return generate(spark, n, lambda _: F.lit(value))


def repeat_forever(spark: SparkSession, value, rows_per_second: int = 1) -> DataFrame:
    """An unbounded stream of the value."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.lit(value).alias("value"), "timestamp")


def cycle(spark: SparkSession, values: Sequence, n: int) -> Ordered:
    """n rows going round the values; none if there are no values."""
    if not values:
        return Ordered(spark.range(0).select(F.lit(None).alias("value"), F.col("id").alias(O)), [O])
    array = F.array(*[F.lit(v) for v in values])
    return generate(spark, n, lambda i: F.element_at(array, (i % len(values) + 1).cast("int")))


def from_results(spark: SparkSession, results: Iterable[tuple], kind: str = "bigint") -> Ordered:
    """Rows of (ok, value, err)."""
    return from_rows(spark, results, f"ok boolean, value {kind}, err string")


def interval(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """An unbounded stream 0, 1, 2, … by the clock: value and timestamp."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def interval_between(spark: SparkSession, start: str, end: str, every: str) -> Ordered:
    """The same over a stretch of event time: value 0, 1, … and ts, the first one interval after the start."""
    times = F.expr(f"sequence(timestamp'{start}' + interval {every}, timestamp'{end}', interval {every})")
    fits = F.expr(f"timestamp'{start}' + interval {every} <= timestamp'{end}'")
    rows = spark.range(1).where(fits).select(F.posexplode(times).alias("value", "ts"))
    return Ordered(rows.select(F.col("value").cast("long").alias("value"), "ts", F.col("value").cast("long").alias(O)), [O])


def timer(spark: SparkSession, value, at: str) -> Ordered:
    """One value at a time of the event clock."""
    return Ordered(spark.range(1).select(F.lit(value).alias("value"), F.expr(f"timestamp'{at}'").alias("ts"), F.col("id").alias(O)), [O])


def from_channel(df: DataFrame) -> DataFrame:
    """An unbounded source: any frame of readStream; iterate it with writeStream."""
    if not df.isStreaming:
        raise ValueError("a channel is a streaming frame; a bounded one is from_frame()")
    return df


def seq(s: Ordered):
    """The rows one by one on the driver, in order."""
    return s.sorted().toLocalIterator()


seq2, range_ctx, generate_ctx, iterate_ctx, from_channel_ctx = seq, range_, generate, iterate, from_channel
