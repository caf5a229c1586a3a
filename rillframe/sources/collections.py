"""Arrays and maps as sets, lists, queues and sorted maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.ordered import Ordered, in_order
from rillframe.sources.memory import O

# from a column of a frame; each row's collection is exploded, order within it in O


def _exploded(df: DataFrame, array: Column) -> Ordered:
    return Ordered(df.select(F.posexplode(array).alias(O, "value")).select("value", F.col(O).cast("long").alias(O)), [O])


def _entries(df: DataFrame, entries: Column) -> Ordered:
    rows = _exploded(df, entries).df
    return Ordered(rows.select(F.col("value.key").alias("key"), F.col("value.value").alias("value"), O), [O])


def from_set(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(column)).alias("value"))


def from_sorted_set(df: DataFrame, column: str) -> Ordered:
    return _exploded(df, F.array_sort(F.array_distinct(column)))


def from_sorted_set_descending(df: DataFrame, column: str) -> Ordered:
    return _exploded(df, F.sort_array(F.array_distinct(column), asc=False))


def from_list(df: DataFrame, column: str) -> Ordered:
    return _exploded(df, F.col(column))


from_queue = from_deque = from_list


def from_stack(df: DataFrame, column: str) -> Ordered:
    """Last in, first out."""
    return _exploded(df, F.reverse(column))


from_deque_reversed = from_stack


def from_map_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("key", "value"))


def from_sorted_map(df: DataFrame, column: str) -> Ordered:
    return _entries(df, F.array_sort(F.map_entries(column)))


def from_sorted_map_descending(df: DataFrame, column: str) -> Ordered:
    return _entries(df, F.sort_array(F.map_entries(column), asc=False))


def from_priority_queue(df: DataFrame, column: str) -> DataFrame:
    """The elements in no order: a heap's own order means nothing."""
    return df.select(F.explode(column).alias("value"))


def from_priority_queue_sorted(df: DataFrame, column: str) -> Ordered:
    return from_sorted_set_keep(df, column)


def from_sorted_set_keep(df: DataFrame, column: str) -> Ordered:
    """Ascending, repeated elements kept."""
    return _exploded(df, F.array_sort(column))


# to collections: one-row frames with the collection in one column, and frames of entries, which scale


def to_hash_set(s: Ordered, value: str = "value") -> DataFrame:
    """Distinct values as rows."""
    return s.df.select(value).distinct()


def to_tree_set(s: Ordered, value: str = "value") -> Ordered:
    """Distinct values as rows in ascending order."""
    return Ordered(to_hash_set(s, value), [value])


def to_array_list(s: Ordered, value: str = "value") -> DataFrame:
    return s.df.agg(in_order(value, s.order).alias("list"))


to_linked_list = to_array_list


def to_hash_map(s: Ordered, key: Column | str = "key", value: Column | str = "value") -> DataFrame:
    """(key, value): the last value of each key."""
    from rillframe.operators.grouping import to_map

    return to_map(s, key, value)


def to_tree_map(s: Ordered, key: Column | str = "key", value: Column | str = "value") -> Ordered:
    return Ordered(to_hash_map(s, key, value), ["key"])


to_hash_map2, to_tree_map2 = to_hash_map, to_tree_map


def group_by_to_hash_map(s: Ordered, key: Column | str, value: Column | str = "value") -> DataFrame:
    from rillframe.operators.grouping import group_by

    return group_by(s, key, value)


def group_by_to_tree_map(s: Ordered, key: Column | str, value: Column | str = "value") -> Ordered:
    return Ordered(group_by_to_hash_map(s, key, value), ["key"])


def group_values_to_hash_map(s: Ordered) -> DataFrame:
    return group_by_to_hash_map(s, "key", "value")


def frequency_to_hash_map(s: Ordered, value: Column | str = "value") -> DataFrame:
    from rillframe.operators.grouping import frequencies

    return frequencies(s, value)


histogram_to_hash_map = group_by_to_hash_map
collect_to_set, collect_to_list, collect_to_map = to_hash_set, to_array_list, to_hash_map


# aggregate columns


def hash_set_collector(value: Column | str) -> Column:
    return F.collect_set(value)


def tree_set_collector(value: Column | str) -> Column:
    return F.array_sort(F.collect_set(value))


def array_list_collector(value: Column | str, order) -> Column:
    return in_order(value, order)


def map_of_groups(frame: DataFrame, key: str = "key", value: str = "value", sort: bool = False) -> DataFrame:
    """One row with the entries of a frame of distinct keys as a map (sorted by key, if asked); for small frames."""
    entries = F.collect_list(F.struct(key, value))
    return frame.agg(F.map_from_entries(F.array_sort(entries) if sort else entries).alias("map"))


# set algebra on frames of values


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
