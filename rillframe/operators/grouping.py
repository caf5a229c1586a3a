"""Grouped results as frames of one row for each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.operators.transforms import _col
from rillframe.ordered import Ordered, in_order

Value = Column | str


def group_by(s: Ordered, key: Value, value: Value = "value") -> DataFrame:
    """(key, values): arrays in order. A key's values meet in one row; where that is too much, aggregate instead."""
    return s.df.groupBy(_col(key).alias("key")).agg(in_order(_col(value), s.order).alias("values"))


group_by_to = group_by


def group_values(s: Ordered) -> DataFrame:
    return group_by(s, "key", "value")


def partition_by(s: Ordered, pred: Column) -> tuple[Ordered, Ordered]:
    """Rows for which pred holds, and the others."""
    holds = F.coalesce(pred, F.lit(False))
    return s.with_df(s.df.where(holds)), s.with_df(s.df.where(~holds))


def count_by(s: Ordered, key: Value) -> DataFrame:
    return s.df.groupBy(_col(key).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def frequencies(s: Ordered, value: Value = "value") -> DataFrame:
    return s.df.groupBy(_col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))


frequency = frequencies


def most_common(s: Ordered, n: int, value: Value = "value") -> DataFrame:
    """(value, count) of the n most frequent, ties by value."""
    return frequencies(s, value).orderBy(F.desc("count"), "value").limit(max(n, 0))


def to_map(s: Ordered, key: Value, value: Value = "value") -> DataFrame:
    """(key, value): the last value of each key."""
    last = F.max_by(F.struct(_col(value).alias("v")), F.struct(*s.order))["v"]
    return s.df.groupBy(_col(key).alias("key")).agg(last.alias("value"))


associate = to_map


def to_map2(s: Ordered) -> DataFrame:
    return to_map(s, "key", "value")


def associate_by(s: Ordered, key: Value) -> DataFrame:
    """(key, value): the last row of each key, as a struct."""
    return to_map(s, key, F.struct(*s.columns))


index_by = associate_by


def reduce_by_key(s: Ordered, aggregate: Column) -> DataFrame:
    """(key, value) by an aggregate such as F.sum("value"): partial in each task, then merged."""
    return s.df.groupBy("key").agg(aggregate.alias("value"))


def fold_by_key(s: Ordered, fn: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, value) by a left fold of any column function in order, beginning with the first value."""
    values = s.df.groupBy("key").agg(in_order("value", s.order).alias("__all"))
    folded = F.aggregate(F.slice(F.col("__all"), F.lit(2), F.greatest(F.size("__all"), F.lit(1))), F.element_at("__all", 1), lambda a, x: fn(a, x))
    return values.select("key", folded.alias("value"))


def reduce_by_key_with_init(s: Ordered, init: Column, fn: Callable[[Column, Column], Column]) -> DataFrame:
    return s.df.groupBy("key").agg(F.aggregate(in_order("value", s.order), init, lambda a, x: fn(a, x)).alias("value"))


def joining(s: Ordered, separator: str = "", prefix: str = "", suffix: str = "", value: Value = "value") -> DataFrame:
    """One string of all, in order; empty ones keep their separator."""
    items = F.transform(in_order(_col(value), s.order), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return s.df.agg(F.concat(F.lit(prefix), F.array_join(items, separator), F.lit(suffix)).alias("value"))


joining_with_prefix_suffix = joining
histogram = group_by
