"""Zips, merges, products and combinatorics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillframe.operators.transforms import _col
from rillframe.ordered import IDX, Ordered


def _side(s: Ordered, name: str, value: str) -> DataFrame:
    return s.index().df.select(IDX, F.col(value).alias(name), F.lit(True).alias(f"__{name}"))


def _zipped(streams: list[Ordered], names: list[str], how: str, value: str) -> DataFrame:
    sides = [_side(s, n, value) for s, n in zip(streams, names, strict=True)]
    return reduce(lambda a, b: a.join(b, IDX, how), sides)


def zip_(a: Ordered, b: Ordered, value: str = "value") -> Ordered:
    """(first, second) by position, as long as the shorter."""
    return Ordered(_zipped([a, b], ["first", "second"], "inner", value).select("first", "second", IDX), [IDX])


def zip3(a: Ordered, b: Ordered, c: Ordered, value: str = "value") -> Ordered:
    names = ["first", "second", "third"]
    return Ordered(_zipped([a, b, c], names, "inner", value).select(*names, IDX), [IDX])


def zip_longest(a: Ordered, b: Ordered, value: str = "value") -> Ordered:
    """(first, second, has_first, has_second) by position, as long as the longer."""
    rows = _zipped([a, b], ["first", "second"], "full", value)
    there = lambda c: F.coalesce(F.col(f"__{c}"), F.lit(False)).alias(f"has_{c}")
    return Ordered(rows.select("first", "second", there("first"), there("second"), IDX), [IDX])


def zip_longest_with(a: Ordered, b: Ordered, default_a, default_b, value: str = "value") -> Ordered:
    rows = zip_longest(a, b, value)
    fill = lambda c, d: F.when(F.col(f"has_{c}"), F.col(c)).otherwise(F.lit(d)).alias(c)
    return rows.with_df(rows.df.select(fill("first", default_a), fill("second", default_b), IDX))


def unzip(s: Ordered, first: str = "first", second: str = "second") -> tuple[Ordered, Ordered]:
    """Two frames of values, in the same order."""
    one = lambda c: s.with_df(s.df.select(F.col(c).alias("value"), *[o for o in s.order if o != "value"]))
    return one(first), one(second)


def interleave(a: Ordered, b: Ordered) -> Ordered:
    """a0, b0, a1, b1, … and then the rest of the longer."""
    x, y = (s.index().df.withColumn("__src", F.lit(i)) for i, s in enumerate((a, b)))
    keep = [*[c for c in a.columns], IDX, "__src"]
    return Ordered(x.select(keep).unionByName(y.select(keep)), [IDX, "__src"])


def concat(*streams: Ordered) -> Ordered:
    """One after another. Inputs ordered by columns of like names and types need no exchange."""
    if not streams:
        raise ValueError("nothing to concatenate; use empty()")
    first = streams[0]
    alike = all(s.order == first.order and [s.df.schema[c].dataType for c in s.order] == [first.df.schema[c].dataType for c in first.order] for s in streams)
    if not alike:
        streams = tuple(s.index() for s in streams)
    order = streams[0].order
    extra = [c for c in order if c not in first.columns]
    parts = [s.df.select(*first.columns, *extra).withColumn("__src", F.lit(i)) for i, s in enumerate(streams)]
    return Ordered(reduce(DataFrame.unionByName, parts), ["__src", *order])


def merge_sorted(a: Ordered, b: Ordered, *keys: Column | str) -> Ordered:
    """Inputs sorted by the keys as one sequence; on ties the first input's rows come first."""
    return merge_sorted_n([a, b], *keys)


def merge_sorted_n(streams: list[Ordered], *keys: Column | str) -> Ordered:
    merged = concat(*streams)
    named = {f"__m{i}": _col(k) for i, k in enumerate(keys or ("value",))}
    return Ordered(merged.df.withColumns(named), [*named, *merged.order])


merge_sorted_n_heap = merge_sorted_n


def cartesian(a: Ordered, b: Ordered, value: str = "value") -> Ordered:
    """(first, second): each of a with each of b. It has as many rows as the product of theirs; that is what it is."""
    x = a.df.select(F.col(value).alias("first"), *[F.col(c).alias(f"__a{i}") for i, c in enumerate(a.order)])
    y = b.df.select(F.col(value).alias("second"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(b.order)])
    return Ordered(x.crossJoin(y), [*[f"__a{i}" for i in range(len(a.order))], *[f"__b{i}" for i in range(len(b.order))]])


def cartesian_self(s: Ordered, value: str = "value") -> Ordered:
    return cartesian(s, s, value)


def cross_product(*streams: Ordered, value: str = "value") -> Ordered:
    """value: an array with one of each input, in lexicographic order; none without inputs."""
    if not streams:
        raise ValueError("no inputs: the product of nothing is empty")
    frames, order = [], []
    for i, s in enumerate(streams):
        names = [f"__c{i}_{j}" for j in range(len(s.order))]
        frames.append(s.df.select(F.col(value).alias(f"__v{i}"), *[F.col(c).alias(n) for c, n in zip(s.order, names, strict=True)]))
        order += names
    rows = reduce(DataFrame.crossJoin, frames)
    return Ordered(rows.select(F.array(*[f"__v{i}" for i in range(len(streams))]).alias("value"), *order), order)


def combinations(s: Ordered, k: int, value: str = "value") -> Ordered:
    """value: arrays of k values at ascending positions, in order of the positions; none if k <= 0 or over the number of rows."""
    at = s.index().df.select(F.col(IDX).alias("__p0"), F.col(value).alias("__v0"))
    if k <= 0:
        return Ordered(at.limit(0).select(F.array("__v0").alias("value"), "__p0"), ["__p0"])
    rows = at
    for i in range(1, k):
        nxt = at.select(F.col("__p0").alias(f"__p{i}"), F.col("__v0").alias(f"__v{i}"))
        rows = rows.join(nxt, F.col(f"__p{i - 1}") < F.col(f"__p{i}"))
    places = [f"__p{i}" for i in range(k)]
    return Ordered(rows.select(F.array(*[f"__v{i}" for i in range(k)]).alias("value"), *places), places)


def heap_permutations(items: list) -> list[list]:
    """All permutations in the order of Heap's algorithm (the smallest change from one to the next)."""
    found, a = [], list(items)

    def go(n):
        if n <= 1:
            found.append(list(a))
            return
        for i in range(n):
            go(n - 1)
            if i < n - 1:
                j = i if n % 2 == 0 else 0
                a[j], a[n - 1] = a[n - 1], a[j]

    if a:
        go(len(a))
    return found


def permutations(s: Ordered, value: str = "value", most: int = 10) -> Ordered:
    """value: arrays of all values in the order of Heap's algorithm; none of no rows. Over `most` rows it refuses: n! rows aren't data."""
    from rillframe.ordered import in_order

    rows = s.df.agg(in_order(value, s.order).alias("__all"))
    kind = rows.schema["__all"].dataType
    schema = StructType().add("__o", "long").add("value", kind)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for values in pdf["__all"]:
                if len(values) > most:
                    raise ValueError(f"{len(values)} rows have too many permutations")
                found = heap_permutations(list(values))
                yield pd.DataFrame({"__o": range(len(found)), "value": pd.Series(found, dtype=object)})

    return Ordered(rows.mapInPandas(run, schema), ["__o"])


def combine_with(a: Ordered, b: Ordered, fn: Callable[[Column, Column], Column], value: str = "value") -> Ordered:
    """value: fn of the values at equal positions."""
    z = zip_(a, b, value)
    return z.with_df(z.df.select(fn(F.col("first"), F.col("second")).alias("value"), IDX))
