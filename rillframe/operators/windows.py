"""Windows over positions and running folds: within chunks of positions, never over all rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.ordered import IDX, Ordered, in_order


def chunk(s: Ordered, size: int, value: str = "value") -> Ordered:
    """value: arrays of `size` values one after another; the last may be shorter; none if size <= 0."""
    at = s.index()
    if size <= 0:
        return Ordered(at.df.limit(0).select(F.array(value).alias("value"), IDX), [IDX])
    groups = at.df.groupBy(F.floor(F.col(IDX) / size).alias("__c")).agg(in_order(value, IDX).alias("value"))
    return Ordered(groups.select("value", F.col("__c").alias(IDX)), [IDX])


def window(s: Ordered, size: int, value: str = "value") -> Ordered:
    """value: arrays of each `size` values in a row; none if size <= 0."""
    return window_with_step(s, size, 1, False, value)


def window_with_step(s: Ordered, size: int, step: int, partial: bool = False, value: str = "value") -> Ordered:
    """Arrays that begin at each step-th position: full ones, and with `partial` the one after the last full one, if rows remain there."""
    at = s.index()
    if size <= 0 or step <= 0:
        return Ordered(at.df.limit(0).select(F.array(value).alias("value"), IDX), [IDX])
    if step > 1:  # each row goes to the frames that hold it, size / step of them
        first, last = F.greatest(F.ceil((F.col(IDX) - (size - 1)) / step), F.lit(0)), F.floor(F.col(IDX) / step)
        dealt = at.df.select(F.col(value).alias("x"), F.col(IDX).alias("__p"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("__f"))
        rows = dealt.groupBy((F.col("__f") * step).alias(IDX)).agg(F.array_sort(F.collect_list(F.struct("__p", "x"))).alias("__w"))
    else:
        frame = lambda w: F.collect_list(F.struct(F.col(value).alias("x"))).over(w.rowsBetween(0, size - 1))
        rows = at.over(0, size - 1, __w=frame).df
    full = F.size("__w") == size
    if partial:
        n = at.df.agg(F.count(F.lit(1)).alias("__n"))
        after = F.when(F.col("__n") < size, F.lit(0)).otherwise(F.floor((F.col("__n") - size) / step) + 1) * step
        rows = rows.crossJoin(F.broadcast(n)).where(full | (F.col(IDX) == after))  # one row
    else:
        rows = rows.where(full)
    return Ordered(rows.select(F.transform("__w", lambda e: e["x"]).alias("value"), IDX), [IDX])


def pairwise(s: Ordered, value: str = "value") -> Ordered:
    """(first, second): each value and the one before it."""
    rows = s.over(1, 0, first=lambda w: F.lag(value).over(w))
    return Ordered(rows.df.where(F.col(IDX) >= 1).select("first", F.col(value).alias("second"), IDX), [IDX])


def triples(s: Ordered, value: str = "value") -> Ordered:
    rows = s.over(2, 0, first=lambda w: F.lag(value, 2).over(w), second=lambda w: F.lag(value, 1).over(w))
    return Ordered(rows.df.where(F.col(IDX) >= 2).select("first", "second", F.col(value).alias("third"), IDX), [IDX])


def differences(s: Ordered, value: str = "value") -> Ordered:
    """Each value less the one before it."""
    rows = s.over(1, 0, __was=lambda w: F.lag(value).over(w))
    return Ordered(rows.df.where(F.col(IDX) >= 1).select((F.col(value) - F.col("__was")).alias("value"), IDX), [IDX])


def running_sum(s: Ordered, value: str = "value", out: str = "running") -> Ordered:
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return s.running(out, lambda w: F.sum(value).over(w), lambda: F.sum(value), lambda w: F.sum("__total").over(w), add)


def running_product(s: Ordered, value: str = "value", out: str = "running") -> Ordered:
    """Prefix products, as doubles."""
    return s.running(out, lambda w: F.product(value).over(w), lambda: F.product(value), lambda w: F.product("__total").over(w), lambda a, b: a * b)


def running_max(s: Ordered, value: str = "value", out: str = "running") -> Ordered:
    return s.running(out, lambda w: F.max(value).over(w), lambda: F.max(value), lambda w: F.max("__total").over(w), lambda a, b: F.greatest(a, b))


def running_min(s: Ordered, value: str = "value", out: str = "running") -> Ordered:
    return s.running(out, lambda w: F.min(value).over(w), lambda: F.min(value), lambda w: F.min("__total").over(w), lambda a, b: F.least(a, b))


def running_count(s: Ordered, out: str = "running") -> Ordered:
    at = s.index()
    return Ordered(at.df.withColumn(out, F.col(IDX) + 1), [IDX])


def scan(s: Ordered, init: Column, step: Callable[[Column, Column], Column], by: list[str] | None = None, value: str = "value", out: str = "value") -> Ordered:
    """All states of a left fold of any column function, one for each row (init isn't one), one fold for each group of `by`.

    Such a fold goes row by row, so a group's values are one array in one task. For sums, products, extremes and counts use the running
    forms, which don't.
    """
    by = by or []
    kind = s.df.sparkSession.range(1).select(init.alias("x")).schema["x"].dataType
    states = F.aggregate(
        F.col("__items"), F.struct(init.alias("now"), F.array().cast(f"array<{kind.simpleString()}>").alias("all")),
        lambda acc, x: F.transform(F.array(step(acc["now"], x).cast(kind)), lambda n: F.struct(n.alias("now"), F.concat(acc["all"], F.array(n)).alias("all")))[0],
        lambda acc: acc["all"],
    )
    order = F.struct(*s.order)
    rows = s.df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(value).alias("x")))).alias("__rows"))
    rows = rows.withColumn("__items", F.transform("__rows", lambda r: r["x"])).withColumn("__states", states)
    flat = rows.select(*by, F.explode(F.arrays_zip("__rows", "__states")).alias("__z"))
    return s.with_df(flat.select(*[c for c in by if c not in s.order], F.col("__z.__states").alias(out), *[F.col(f"__z.__rows.o.{c}").alias(c) for c in s.order]))


def scan_python(s: Ordered, init, step: Callable, by: list[str], kind: str, value: str = "value", out: str = "value") -> Ordered:
    """The same with a Python function, group by group."""
    from pyspark.sql.types import StructType

    schema = StructType([s.df.schema[c] for c in dict.fromkeys([*by, *s.order])] + list(StructType.fromDDL(f"`{out}` {kind}")))

    order = s.order

    def run(pdf):
        pdf = pdf.sort_values(order)
        now, states = init, []
        for x in pdf[value]:
            now = step(now, x)
            states.append(now)
        return pdf.assign(**{out: states})[[f.name for f in schema]]

    return s.with_df(s.df.groupBy(*by).applyInPandas(run, schema))


def session_ids(df: DataFrame, order: str, gap: Column, by: list[str]) -> DataFrame:
    """With `session`, 0-based in each group: a new one where the value of `order` is over `gap` past the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w)) > gap, F.lit(False)).cast("int")
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")
