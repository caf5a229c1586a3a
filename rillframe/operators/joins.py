"""Equi-joins of key/value frames and of frames on key expressions.

Spark picks the strategy: a side under the broadcast threshold is broadcast, others are shuffled and skewed keys split. null_safe joins null
keys to each other. Results are frames in no order; the order columns of the left side stay in them, for those who need left order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.ordered import Ordered, in_order


def _frames(left, right) -> tuple[DataFrame, DataFrame]:
    return tuple(x.df if isinstance(x, Ordered) else x for x in (left, right))


def _joined(left, right, how: str, null_safe: bool) -> DataFrame:
    """key, left, right, and whether each side is there."""
    l, r = _frames(left, right)
    l = l.select(F.col("key").alias("__lk"), F.col("value").alias("__lv"), F.lit(True).alias("__l"))
    r = r.select(F.col("key").alias("__rk"), F.col("value").alias("__rv"), F.lit(True).alias("__r"))
    on = F.col("__lk").eqNullSafe(F.col("__rk")) if null_safe else F.col("__lk") == F.col("__rk")
    out = l.join(r, on, how)
    key = F.when(F.col("__l").isNotNull(), F.col("__lk")).otherwise(F.col("__rk"))
    return out.select(key.alias("key"), F.col("__lv").alias("left"), F.col("__rv").alias("right"), F.coalesce("__l", F.lit(False)).alias("has_left"), F.coalesce("__r", F.lit(False)).alias("has_right"))


def inner_join(left, right, null_safe: bool = False) -> DataFrame:
    """(key, left, right) for each pair of values of a key."""
    return _joined(left, right, "inner", null_safe).select("key", "left", "right")


def left_join(left, right, null_safe: bool = False) -> DataFrame:
    """(key, left, right, has_right): unmatched left rows have a null right; has_right tells it from a null value."""
    return _joined(left, right, "left", null_safe).select("key", "left", "right", "has_right")


def right_join(left, right, null_safe: bool = False) -> DataFrame:
    return _joined(left, right, "right", null_safe).select("key", "left", "right", "has_left")


def full_join(left, right, null_safe: bool = False) -> DataFrame:
    return _joined(left, right, "full", null_safe)


def left_join_with(left, right, default, null_safe: bool = False) -> DataFrame:
    """Left join with a default for missing right values; null values stay null."""
    out = left_join(left, right, null_safe)
    return out.select("key", "left", F.when(F.col("has_right"), F.col("right")).otherwise(F.lit(default)).alias("right"))


def right_join_with(left, right, default, null_safe: bool = False) -> DataFrame:
    out = right_join(left, right, null_safe)
    return out.select("key", F.when(F.col("has_left"), F.col("left")).otherwise(F.lit(default)).alias("left"), "right")


def co_group(left: Ordered, right: Ordered) -> DataFrame:
    """(key, left, right): the values of each key of either side as arrays in order, empty where a side has none."""
    l = left.df.groupBy("key").agg(in_order("value", left.order).alias("left"))
    r = right.df.groupBy("key").agg(in_order("value", right.order).alias("right"))
    none = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    return l.join(r, "key", "full").select("key", none("left", l).alias("left"), none("right", r).alias("right"))


Keys = Callable[[DataFrame], Column] | Column | str


def _on(l: DataFrame, r: DataFrame, left_key: Column | str, right_key: Column | str) -> tuple[DataFrame, DataFrame, Column]:
    one = lambda k: F.col(k) if isinstance(k, str) else k
    l, r = l.withColumn("__lk", one(left_key)), r.withColumn("__rk", one(right_key))
    return l, r, F.col("__lk") == F.col("__rk")


def _pairs(left, right, left_key, right_key, how: str) -> DataFrame:
    l, r = _frames(left, right)
    names_l, names_r = ([c for c in x.columns if not c.startswith("__")] for x in (l, r))
    l, r, on = _on(l, r, left_key, right_key)
    l, r = l.select("__lk", F.struct(*names_l).alias("first")), r.select("__rk", F.struct(*names_r).alias("second"))
    return l.join(r, on, how).select("first", "second")


def join_by(left, right, left_key: Column | str, right_key: Column | str) -> DataFrame:
    """(first, second): pairs of whole rows with equal keys."""
    return _pairs(left, right, left_key, right_key, "inner")


def left_join_by(left, right, left_key: Column | str, right_key: Column | str) -> DataFrame:
    """(first, second): second is null for left rows without a match."""
    return _pairs(left, right, left_key, right_key, "left")


def _kept(left, right, left_key, right_key, how: str):
    l, r = _frames(left, right)
    keep = l.columns
    l, r, on = _on(l, r, left_key, right_key)
    out = l.join(r.select("__rk"), on, how).select(*keep)
    return left.with_df(out) if isinstance(left, Ordered) else out


def semi_join(left, right):
    """Left rows with a match, each once."""
    return _kept(left, right, "key", "key", "left_semi")


def anti_join(left, right):
    """Left rows without a match."""
    return _kept(left, right, "key", "key", "left_anti")


def semi_join_by(left, right, left_key: Column | str, right_key: Column | str):
    return _kept(left, right, left_key, right_key, "left_semi")


def anti_join_by(left, right, left_key: Column | str, right_key: Column | str):
    return _kept(left, right, left_key, right_key, "left_anti")
