"""Projections, filters and element transforms. Column functions stay in the JVM; a Python function runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillframe.ordered import IDX, Ordered

Fn = Callable[[Column], Column]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def map_(s: Ordered, fn: Fn, value: str = "value") -> Ordered:
    """value replaced by fn(value)."""
    return s.with_df(s.df.withColumn(value, fn(F.col(value))))


map_to = map_


def map_rows(s: Ordered, fn: Callable, schema: str | StructType) -> Ordered:
    """A Python function of one row (a dict), giving a dict; rows go through in Arrow batches. The order columns are kept."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    order = s.order
    full = StructType([f for f in kind if f.name not in order] + [s.df.schema[c] for c in order])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [fn(r) for r in pdf.to_dict("records")]
            out = pd.DataFrame(rows, columns=[f.name for f in kind])
            yield out.assign(**{c: pdf[c].to_numpy() for c in order})[[f.name for f in full]]

    return s.with_df(s.df.mapInPandas(run, full))


def filter_(s: Ordered, pred: Column) -> Ordered:
    """Rows where pred holds; a null pred drops the row."""
    return s.with_df(s.df.where(pred))


filter2 = filter_ctx = parallel_filter = parallel_filter_ctx = filter_
map_ctx = map_to_ctx = parallel_map = parallel_map_ctx = map_


def peek(s: Ordered, name: str, *metrics: Column) -> Ordered:
    """Rows unchanged, with named metrics that an Observation or listener gets when a job runs."""
    return s.with_df(s.df.observe(name, *metrics))


peek2 = peek


def flat_map(s: Ordered, array: Column, value: str = "value") -> Ordered:
    """A row for each element of the array, in order; empty and null arrays give none."""
    at = f"__o{len(s.order)}"
    others = [c for c in s.df.columns if c != value]
    return Ordered(s.df.select(*others, F.posexplode(array).alias(at, value)), [*s.order, at])


flat_map_seq = parallel_flat_map = parallel_flat_map_ctx = flat_map


def flatten(s: Ordered, value: str = "value") -> Ordered:
    return flat_map(s, F.col(value), value)


flatten_seq = flatten


def flat_map_rows(s: Ordered, fn: Callable[[dict], Iterable], kind: str, value: str = "value") -> Ordered:
    """flat_map with a Python function of one row that gives values of the type `kind`."""
    at, order = f"__o{len(s.order)}", s.order
    schema = StructType([s.df.schema[c] for c in order] + list(StructType.fromDDL(f"`{at}` int, `{value}` {kind}")))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(*[r[c] for c in order], i, v) for r in pdf.to_dict("records") for i, v in enumerate(fn(r))]
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return Ordered(s.df.mapInPandas(run, schema), [*s.order, at])


def intersperse(s: Ordered, separator, value: str = "value") -> Ordered:
    """The separator between rows, as rows of their own with nulls in other columns."""
    at = f"__o{len(s.order)}"
    first = F.struct(*s.order)
    head = s.df.agg(F.min(first).alias("__head"))
    others = [c for c in s.df.columns if c != value]
    kind = s.df.schema[value].dataType
    both = F.when(first == F.col("__head"), F.array(F.struct(F.lit(1).alias("k"), F.col(value).alias("v")))).otherwise(
        F.array(F.struct(F.lit(0).alias("k"), F.lit(separator).cast(kind).alias("v")), F.struct(F.lit(1).alias("k"), F.col(value).alias("v")))
    )
    rows = s.df.crossJoin(F.broadcast(head)).withColumn("__both", F.explode(both))  # one row
    kept = [F.col(c) if c in s.order else F.when(F.col("__both.k") == 1, F.col(c)).alias(c) for c in others]
    return Ordered(rows.select(*kept, F.col("__both.v").alias(value), F.col("__both.k").alias(at)), [*s.order, at])


def zip_with_index(s: Ordered, out: str = "index") -> Ordered:
    """With the 0-based position."""
    at = s.index()
    return Ordered(at.df.withColumn(out, F.col(IDX)), [IDX])


# key and value


def map_keys(s: Ordered, fn: Fn) -> Ordered:
    return map_(s, fn, "key")


def map_values(s: Ordered, fn: Fn) -> Ordered:
    return map_(s, fn, "value")


map_keys_to, map_values_to, parallel_map_values = map_keys, map_values, map_values


def map_pairs(s: Ordered, key: Column, value: Column) -> Ordered:
    return s.with_df(s.df.withColumns({"key": key, "value": value}))


def swap_key_value(s: Ordered) -> Ordered:
    return map_pairs(s, F.col("value"), F.col("key"))


def keys(s: Ordered) -> Ordered:
    return s.with_df(s.df.select("key", *[c for c in s.order if c != "key"]))


def values(s: Ordered) -> Ordered:
    return s.with_df(s.df.select("value", *[c for c in s.order if c != "value"]))


def to_pairs(s: Ordered) -> Ordered:
    """value: struct<first, second> of key and value."""
    return s.with_df(s.df.select(F.struct(F.col("key").alias("first"), F.col("value").alias("second")).alias("value"), *[c for c in s.order if c not in ("key", "value")]))


# numbers


def clamp(s: Ordered, low, high, value: str = "value") -> Ordered:
    """Values cut to [low, high]; NaN stays."""
    x = F.col(value)
    kind = s.df.schema[value].dataType
    is_nan = F.isnan(x) if kind.typeName() in ("double", "float") else F.lit(False)
    return s.with_df(s.df.withColumn(value, F.when(is_nan, x).when(x < low, F.lit(low).cast(kind)).when(x > high, F.lit(high).cast(kind)).otherwise(x)))


def abs_(s: Ordered, value: str = "value") -> Ordered:
    return map_(s, F.abs, value)


abs_float = abs_


def scale(s: Ordered, factor, value: str = "value") -> Ordered:
    return map_(s, lambda x: x * F.lit(factor), value)


def offset(s: Ordered, by, value: str = "value") -> Ordered:
    return map_(s, lambda x: x + F.lit(by), value)


def positive(s: Ordered, value: str = "value") -> Ordered:
    """Values over 0; NaN isn't."""
    x = F.col(value)
    return filter_(s, (x > 0) & ~_nan(s.df, value))


def negative(s: Ordered, value: str = "value") -> Ordered:
    return filter_(s, F.col(value) < 0)


def non_zero(s: Ordered, value: str = "value") -> Ordered:
    return filter_(s, F.col(value) != 0)


def _nan(df: DataFrame, value: str) -> Column:
    return F.isnan(value) if df.schema[value].dataType.typeName() in ("double", "float") else F.lit(False)
