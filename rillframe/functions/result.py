"""Results as structs (ok, value, err), and frames of such rows with the columns ok, value and err."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.functions.optional import ZEROS
from rillframe.ordered import Ordered, in_order

Fn = Callable[[Column], Column]


def _result(is_ok: Column, value: Column, err: Column) -> Column:
    return F.struct(is_ok.alias("ok"), value.alias("value"), err.alias("err"))


def ok(value: Column) -> Column:
    return _result(F.lit(True), value, F.lit(None).cast("string"))


def err(message: Column, kind: str = "bigint") -> Column:
    """A failure; a null message counts as success without a value."""
    return _result(message.isNull(), F.lit(None).cast(kind), message)


def err_msg(message: str, kind: str = "bigint") -> Column:
    return err(F.lit(message), kind)


def is_ok(r: Column) -> Column:
    return r["ok"]


def is_err(r: Column) -> Column:
    return ~r["ok"]


def unwrap(r: Column) -> Column:
    """The value; an error fails the job."""
    return F.when(r["ok"], r["value"]).otherwise(F.raise_error(r["err"]))


def unwrap_or(r: Column, default: Column) -> Column:
    return F.when(r["ok"], r["value"]).otherwise(default)


def unwrap_or_else(r: Column, fn: Fn) -> Column:
    return F.when(r["ok"], r["value"]).otherwise(fn(r["err"]))


def unwrap_err(r: Column) -> Column:
    return F.when(~r["ok"], r["err"]).otherwise(F.raise_error(F.lit("not an error")))


def error(r: Column) -> Column:
    return r["err"]


def value(r: Column, kind: str = "bigint") -> Column:
    """The value or its type's zero."""
    return F.coalesce(r["value"], F.lit(ZEROS[kind]).cast(kind))


def get(r: Column) -> tuple[Column, Column]:
    return r["value"], r["err"]


def to_optional(r: Column) -> Column:
    return F.when(r["ok"], r["value"])


def map_(r: Column, fn: Fn) -> Column:
    """fn of the value; an error stays."""
    return _result(r["ok"], F.when(r["ok"], fn(r["value"])), r["err"])


map_result_to = map_


def flat_map_result(r: Column, fn: Fn) -> Column:
    """fn gives a result itself."""
    next_ = fn(r["value"])
    return _result(r["ok"] & next_["ok"], F.when(r["ok"], next_["value"]), F.when(r["ok"], next_["err"]).otherwise(r["err"]))


def map_err(r: Column, fn: Fn) -> Column:
    return _result(r["ok"], r["value"], F.when(~r["ok"], fn(r["err"])))


def and_(r: Column, other: Column) -> Column:
    return F.when(r["ok"], other).otherwise(r)


def or_(r: Column, other: Column) -> Column:
    return F.when(r["ok"], r).otherwise(other)


# frames


def map_err_to(s: Ordered, attempt: Fn, message: Fn | str, value: str = "value") -> Ordered:
    """attempt(value) is null where it fails (try_cast, try_divide and the like): (ok, value, err) for each row."""
    x = F.col(value)
    got = attempt(x)
    failed = got.isNull() & x.isNotNull()
    text = F.lit(message) if isinstance(message, str) else message(x)
    rows = s.df.select(*[c for c in s.df.columns if c not in (value, "ok", "err")], (~failed).alias("ok"), F.when(~failed, got).alias("value"), F.when(failed, text).alias("err"))
    return s.with_df(rows)


def filter_err(s: Ordered, test: Fn, message: Fn | str, value: str = "value") -> Ordered:
    """test(value) is null where it fails: kept rows are ok, failed ones errors, and false ones go."""
    x = F.col(value)
    passed = test(x)
    failed = passed.isNull()
    text = F.lit(message) if isinstance(message, str) else message(x)
    rows = s.df.where(failed | passed).select(*[c for c in s.df.columns if c not in (value, "ok", "err")], (~failed).alias("ok"), F.when(~failed, x).alias("value"), F.when(failed, text).alias("err"))
    return s.with_df(rows)


def flat_map_err(s: Ordered, attempt: Fn, message: Fn | str, value: str = "value") -> Ordered:
    """attempt(value) gives an array, or null where it fails: a row for each element, or one error."""
    x = F.col(value)
    got = attempt(x)
    text = F.lit(message) if isinstance(message, str) else message(x)
    none = F.lit(None).cast("string")
    element = F.element_at(F.array_append(F.filter(got, lambda _: F.lit(False)), F.lit(None)), 1)  # a null of the elements' type
    failed = F.array(F.struct(F.lit(False).alias("ok"), element.alias("value"), text.alias("err")))
    fine = F.transform(got, lambda e: F.struct(F.lit(True).alias("ok"), e.alias("value"), none.alias("err")))
    at = f"__o{len(s.order)}"
    rows = s.df.select(*[c for c in s.df.columns if c not in (value, "ok", "err")], F.posexplode(F.when(got.isNotNull(), fine).otherwise(failed)).alias(at, "__r"))
    return Ordered(rows.select(*[c for c in rows.columns if c != "__r"], "__r.*"), [*s.order, at])


def python_map_err(s: Ordered, fn: Callable, kind: str, value: str = "value") -> Ordered:
    """A Python function of the value, whose exceptions become errors; over Arrow batches."""
    from pyspark.sql.types import StructType

    order = s.order
    kept = [s.df.schema[c] for c in order]
    schema = StructType(kept + list(StructType.fromDDL(f"ok boolean, value {kind}, err string")))

    def attempt(x):
        try:
            return True, fn(x), None
        except Exception as e:
            return False, None, str(e)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = pd.DataFrame([attempt(x) for x in pdf[value]], columns=["ok", "value", "err"], dtype=object)
            yield pd.concat([pdf[order].reset_index(drop=True), found], axis=1)

    return s.with_df(s.df.mapInPandas(run, schema))


def filter_ok(s: Ordered) -> Ordered:
    return s.with_df(s.df.where("ok").drop("ok", "err"))


def filter_errs(s: Ordered) -> Ordered:
    return s.with_df(s.df.where("not ok").drop("ok", "value"))


def unwrap_results(s: Ordered) -> Ordered:
    """Values; the first error that a task meets fails the job."""
    return s.with_df(s.df.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise(F.raise_error("err"))).drop("ok", "err"))


def unwrap_or_default(s: Ordered, default) -> Ordered:
    return s.with_df(s.df.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise(F.lit(default))).drop("ok", "err"))


def take_until_err(s: Ordered) -> Ordered:
    """Values before the first error."""
    from rillframe.operators.slicing import take_while

    taken = take_while(s, F.col("ok"))
    return taken.with_df(taken.df.drop("ok", "err"))


def collect_results(s: Ordered) -> tuple[list, str | None]:
    """Values before the first error, in order, and that error."""
    first = s.df.where("not ok").orderBy(*s.order).select("err").first()
    return [r["value"] for r in take_until_err(s).collect()], None if first is None else first[0]


def collect_results_all(s: Ordered) -> DataFrame:
    """One row: (values, errors) as arrays in order."""
    items = in_order(F.struct("ok", "value", "err"), s.order)
    return s.df.agg(items.alias("__all")).select(
        F.transform(F.filter("__all", lambda r: r["ok"]), lambda r: r["value"]).alias("values"), F.transform(F.filter("__all", lambda r: ~r["ok"]), lambda r: r["err"]).alias("errors")
    )


partition_results = collect_results_all
