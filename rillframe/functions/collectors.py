"""Collectors: functions that build aggregate columns, for collect_to() or any agg(). `order` names the columns that order the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.ordered import Ordered, in_order

Order = Sequence[str] | str
Value = Column | str


def _col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _at(order: Order) -> Column:
    return F.struct(*([order] if isinstance(order, str) else order))


def to_slice(value: Value, order: Order) -> Column:
    return in_order(_col(value), order)


def to_set(value: Value) -> Column:
    return F.collect_set(_col(value))


def joining(value: Value, order: Order, separator: str = "", prefix: str = "", suffix: str = "") -> Column:
    """One string; empty strings at the very start lose their separator, unlike in grouping.joining()."""
    items = in_order(_col(value), order)
    kept = F.aggregate(items, F.lit(""), lambda acc, x: F.when(F.length(acc) > 0, F.concat(acc, F.lit(separator), x)).otherwise(x))
    return F.concat(F.lit(prefix), kept, F.lit(suffix))


joining_full = joining


def counting() -> Column:
    return F.count(F.lit(1))


def summing(value: Value) -> Column:
    return F.coalesce(F.sum(_col(value)), F.lit(0))


def averaging(value: Value) -> Column:
    return F.avg(_col(value))


def max_by(row: Value, key: Value, order: Order) -> Column:
    """The row of the greatest key, the first on ties: of each key's rows the first by place, then the greatest key of these.

    A descending place isn't a value for every type, so the rows of the group are folded; max_by_number() is the form for one numeric place.
    """
    items = F.collect_list(F.struct(_col(key).alias("k"), _at(order).alias("o"), _col(row).alias("r")))
    better = lambda a, x: (x["k"] > a["k"]) | ((x["k"] == a["k"]) & (x["o"] < a["o"]))
    return F.aggregate(items, F.try_element_at(items, F.lit(1)), lambda a, x: F.when(better(a, x), x).otherwise(a))["r"]


def max_by_number(row: Value, key: Value, place: str) -> Column:
    """The same with a numeric place, by a plain aggregate that is combined before the shuffle."""
    return F.max_by(_col(row), F.struct(_col(key).alias("k"), (-F.col(place)).alias("o")))


def min_by(row: Value, key: Value, order: Order) -> Column:
    return F.min_by(_col(row), F.struct(_col(key).alias("k"), _at(order).alias("o")))


def partitioning_by(value: Value, pred: Column, order: Order) -> Column:
    """struct(true, false) of arrays, both always there."""
    items = in_order(F.struct(pred.alias("p"), _col(value).alias("v")), order)
    part = lambda want: F.transform(F.filter(items, lambda x: F.coalesce(x["p"], F.lit(False)) == want), lambda x: x["v"])
    return F.struct(part(True).alias("true"), part(False).alias("false"))


def first(value: Value, order: Order) -> Column:
    return F.min_by(_col(value), _at(order))


def last(value: Value, order: Order) -> Column:
    return F.max_by(_col(value), _at(order))


def reducing(value: Value, identity: Column, fn: Callable[[Column, Column], Column], order: Order) -> Column:
    return F.aggregate(in_order(_col(value), order), identity, fn)


def mapping(mapper: Callable[[Column], Column], downstream: Callable[[Column], Column], value: Value = "value") -> Column:
    return downstream(mapper(_col(value)))


def filtering(pred: Column, downstream: Callable[[Column], Column], value: Value = "value") -> Column:
    """downstream over the values for which pred holds; for aggregates that skip nulls."""
    return downstream(F.when(pred, _col(value)))


def flat_mapping(array: Column, downstream: Callable[[Column], Column]) -> Column:
    """downstream, a function of an array, over all elements of the rows' arrays."""
    return downstream(F.flatten(F.collect_list(array)))


def teeing(one: Column, two: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Two collectors in one pass, merged."""
    return merge(one, two)


def top_k(value: Value, k: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(_col(value)), asc=False), 1, max(k, 0))


def bottom_k(value: Value, k: int) -> Column:
    return F.slice(F.array_sort(F.collect_list(_col(value))), 1, max(k, 0))


def quantile(value: Value, q: float) -> Column:
    """Lower nearest rank, from all values of a group; aggregates.quantile() is the form for whole frames."""
    values = F.array_sort(F.collect_list(_col(value)))
    place = F.greatest(F.floor(F.lit(min(max(q, 0.0), 1.0)) * (F.size(values) - 1)), F.lit(0)) + 1
    return F.try_element_at(values, place.cast("int"))


def median(value: Value) -> Column:
    return quantile(value, 0.5)


def percentile(value: Value, p: float) -> Column:
    return quantile(value, p / 100)


# those that give maps: frames of (key, ...) rows


def grouping_by(s: Ordered, key: Value, value: Value = "value") -> DataFrame:
    from rillframe.operators.grouping import group_by

    return group_by(s, key, value)


histogram = grouping_by


def to_map(s: Ordered, key: Value, value: Value = "value") -> DataFrame:
    from rillframe.operators.grouping import to_map as build

    return build(s, key, value)


def to_map_merging(s: Ordered, key: Value, aggregate: Column) -> DataFrame:
    """(key, value): values of equal keys merged by an aggregate."""
    return s.df.groupBy(_col(key).alias("key")).agg(aggregate.alias("value"))


def frequency(s: Ordered, value: Value = "value") -> DataFrame:
    from rillframe.operators.grouping import frequencies

    return frequencies(s, value)
