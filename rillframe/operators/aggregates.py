"""Whole-frame results: each is a frame of one row (or none), so that it can be joined and written; scalar() takes the value out."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.operators.transforms import _col
from rillframe.ordered import Ordered, in_order

Value = Column | str


def scalar(frame: DataFrame):
    """The only value of a frame of one row and column; None if there is no row."""
    row = frame.first()
    return None if row is None else row[0]


def count(s: Ordered) -> DataFrame:
    return s.df.agg(F.count(F.lit(1)).alias("count"))


count2 = count_ctx = count


def reduce_(s: Ordered, identity: Column, fn: Callable[[Column, Column], Column], value: Value = "value") -> DataFrame:
    """A left fold in order with any column function. It holds all values in one array: for sums and the like use their own aggregates."""
    return s.df.agg(F.aggregate(in_order(_col(value), s.order), identity, lambda a, x: fn(a, x)).alias("value"))


fold = fold_to = reduce_ctx = reduce2 = reduce_


def reduce_optional(s: Ordered, fn: Callable[[Column, Column], Column], value: Value = "value") -> DataFrame:
    """A left fold that begins with the first value; null of no rows."""
    items = in_order(_col(value), s.order)
    folded = F.aggregate(F.slice(F.col("__all"), F.lit(2), F.greatest(F.size("__all"), F.lit(1))), F.try_element_at("__all", F.lit(1)), lambda a, x: fn(a, x))
    return s.df.agg(items.alias("__all")).select(F.when(F.size("__all") > 0, folded).alias("value"))


def parallel_reduce(s: Ordered, aggregate: Column) -> DataFrame:
    """A fold that is associative and commutative, as an aggregate: partial in each task, then merged."""
    return s.df.agg(aggregate.alias("value"))


def tree_reduce(df: DataFrame, value: str, identity, op: Callable, depth: int = 2):
    """The same for a Python function: folds in partitions, then a tree of merges."""
    return df.select(value).rdd.map(lambda r: r[0]).treeAggregate(identity, op, op, depth)


def any_match(s: Ordered, pred: Column) -> DataFrame:
    return s.df.agg(F.coalesce(F.bool_or(pred), F.lit(False)).alias("value"))


def all_match(s: Ordered, pred: Column) -> DataFrame:
    return s.df.agg(F.coalesce(F.bool_and(pred), F.lit(True)).alias("value"))


def none_match(s: Ordered, pred: Column) -> DataFrame:
    return s.df.agg((~F.coalesce(F.bool_or(pred), F.lit(False))).alias("value"))


any_match2 = any_match_ctx = any_match
all_match2 = all_match_ctx = all_match
none_match2 = none_match


def exists(s: Ordered, pred: Column) -> bool:
    """any_match as a Python value; stops at the first match."""
    return not s.df.where(pred).isEmpty()


def contains(s: Ordered, target, value: str = "value") -> DataFrame:
    return any_match(s, F.col(value) == F.lit(target))


def is_empty(s: Ordered) -> bool:
    return s.df.isEmpty()


def is_not_empty(s: Ordered) -> bool:
    return not s.df.isEmpty()


def sum_(s: Ordered, value: Value = "value") -> DataFrame:
    """0 of no rows."""
    return s.df.agg(F.coalesce(F.sum(_col(value)), F.lit(0)).alias("sum"))


def average(s: Ordered, value: Value = "value") -> DataFrame:
    return s.df.agg(F.avg(_col(value)).alias("average"))


def product(s: Ordered, value: Value = "value") -> DataFrame:
    """1 of no rows; a double."""
    return s.df.agg(F.coalesce(F.product(_col(value)), F.lit(1.0)).alias("product"))


sum_by, average_by = sum_, average


def _plain(x: Column) -> Column:
    """NaN as null, so that it is never an extreme; integers pass."""
    return F.nanvl(x, F.lit(None))


def min_value(s: Ordered, value: str = "value") -> DataFrame:
    return s.df.agg(F.min(_skip_nan(s, value)).alias("min"))


def max_value(s: Ordered, value: str = "value") -> DataFrame:
    return s.df.agg(F.max(_skip_nan(s, value)).alias("max"))


def min_max(s: Ordered, value: str = "value") -> DataFrame:
    """(min, max); no row of no rows."""
    x = _skip_nan(s, value)
    return s.df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")


def _skip_nan(s: Ordered, value: str) -> Column:
    return _plain(F.col(value)) if s.df.schema[value].dataType.typeName() in ("double", "float") else F.col(value)


def min_by(s: Ordered, *keys: Value) -> DataFrame:
    """The row of the least key, the first on ties; none of no rows."""
    return _extreme(s, keys, True)


def max_by(s: Ordered, *keys: Value) -> DataFrame:
    """The row of the greatest key, the first on ties."""
    return _extreme(s, keys, False)


min_, max_ = min_by, max_by


def _extreme(s: Ordered, keys, least: bool) -> DataFrame:
    by = [_col(k).asc() if least else _col(k).desc() for k in (keys or ("value",))]
    return s.df.orderBy(*by, *s.order).limit(1).select(*s.columns)


def get_statistics(s: Ordered, value: str = "value") -> DataFrame:
    """(count, sum, min, max, average); no row of no rows."""
    x = F.col(value)
    all_ = s.df.agg(F.count(F.lit(1)).alias("count"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"))
    return all_.where("count > 0").withColumn("average", F.col("sum").cast("double") / F.col("count"))


def quantile(s: Ordered, q: float, value: str = "value") -> DataFrame:
    """The value at place floor(q * (n - 1)) of the sorted values, q held in [0, 1]; null of no rows.

    Counts of distinct values are parted by range; the parts' totals, a row each, tell which part holds the place, and prefix sums run there alone.
    """
    counts = s.df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("__n"))
    parts = Ordered(counts, ["value"]).parts()
    sizes = sorted((r["__chunk"], r["n"]) for r in parts.groupBy("__chunk").agg(F.sum("__n").alias("n")).collect())  # a row for each partition
    at, before, part = math.floor(min(max(q, 0.0), 1.0) * (sum(n for _, n in sizes) - 1)), 0, -1
    for part, n in sizes:
        if before + n > at:
            break
        before += n
    end = F.sum("__n").over(Window.partitionBy("__chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.where(F.col("__chunk") == part).withColumn("__end", end + before).where(F.col("__end") > at).agg(F.min("value").alias("value"))


def median(s: Ordered, value: str = "value") -> DataFrame:
    """The lower median."""
    return quantile(s, 0.5, value)


def percentile(s: Ordered, p: float, value: str = "value") -> DataFrame:
    """p from 0 to 100."""
    return quantile(s, p / 100, value)


def collect(s: Ordered) -> list:
    return s.collect()


collect_pairs = collect_ctx = parallel_collect = collect


def collect_to(s: Ordered, *aggregates: Column, by: list[str] | None = None) -> DataFrame:
    """Collectors (aggregate columns) over all rows or over groups, all in one pass."""
    return s.df.groupBy(*(by or [])).agg(*aggregates) if by else s.df.agg(*aggregates)
