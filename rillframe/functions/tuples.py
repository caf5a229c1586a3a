"""Pairs, triples and quads as structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]
NAMES = ("first", "second", "third", "fourth")


def _tuple(*parts: Column) -> Column:
    return F.struct(*[p.alias(n) for p, n in zip(parts, NAMES, strict=False)])


def new_pair(first: Column, second: Column) -> Column:
    return _tuple(first, second)


def new_triple(first: Column, second: Column, third: Column) -> Column:
    return _tuple(first, second, third)


def new_quad(first: Column, second: Column, third: Column, fourth: Column) -> Column:
    return _tuple(first, second, third, fourth)


def swap(p: Column) -> Column:
    return _tuple(p["second"], p["first"])


def map_first(t: Column, fn: Fn) -> Column:
    return t.withField("first", fn(t["first"]))


def map_second(t: Column, fn: Fn) -> Column:
    return t.withField("second", fn(t["second"]))


def map_third(t: Column, fn: Fn) -> Column:
    return t.withField("third", fn(t["third"]))


def to_pair(t: Column) -> Column:
    """The first two of a triple or quad."""
    return _tuple(t["first"], t["second"])


def to_triple(q: Column) -> Column:
    return _tuple(q["first"], q["second"], q["third"])


def unpack(df: DataFrame, column: str) -> DataFrame:
    """The fields of a tuple column as columns of their own, beside the others."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")
