"""Optional values as nullable columns: null is absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def some(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def none(kind: str = "void") -> Column:
    return F.lit(None) if kind == "void" else F.lit(None).cast(kind)


def optional_of(x: Column) -> Column:
    """A nullable column is one already."""
    return x


to_pointer = optional_of


def optional_from_condition(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def is_present(x: Column) -> Column:
    return x.isNotNull()


def is_empty(x: Column) -> Column:
    return x.isNull()


def get(x: Column, message: str = "no value present") -> Column:
    """The value; a null fails the job."""
    return F.when(x.isNotNull(), x).otherwise(F.raise_error(F.lit(message)))


def get_or_else(x: Column, default: Column) -> Column:
    return F.coalesce(x, default)


get_or_else_get = or_else = or_else_get = get_or_else

#: Zero values by type.
ZEROS = {"string": "", "boolean": False, "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0}


def get_or_zero(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.lit(ZEROS[kind]).cast(kind))


def if_present(value, action: Callable) -> None:
    """On the driver, with a value that was collected."""
    if value is not None:
        action(value)


def if_present_or_else(value, action: Callable, otherwise: Callable) -> None:
    action(value) if value is not None else otherwise()


def filter_(x: Column, pred: Fn) -> Column:
    return F.when(pred(x), x)


def map_(x: Column, fn: Fn) -> Column:
    return F.when(x.isNotNull(), fn(x))


optional_map = optional_flat_map = map_


def to_slice(x: Column) -> Column:
    """An array of one or no element."""
    return F.array_compact(F.array(x))


def to_stream(s, value: str = "value"):
    """The rows whose value is present."""
    return s.with_df(s.df.where(F.col(value).isNotNull()))


def string(x: Column) -> Column:
    return F.when(x.isNotNull(), F.lit("Some(...)")).otherwise(F.lit("None"))


def optional_zip(a: Column, b: Column) -> Column:
    """A pair if both are present."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("second")))


def optional_equals(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
