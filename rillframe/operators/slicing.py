"""Prefixes, suffixes, distinct rows, sorts and single rows.

What depends on one place in the order takes it from an aggregate (the first row where a condition fails), so rows are only filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.ordered import IDX, Ordered
from rillframe.operators.transforms import _col, _nan


def _none(s: Ordered) -> Ordered:
    return s.with_df(s.df.limit(0))


def _against(s: Ordered, cut: DataFrame, keep: Callable[[Column, Column], Column]) -> Ordered:
    """Rows kept by their place against the one in `cut` (one row; null: no such place)."""
    rows = s.df.crossJoin(F.broadcast(cut))
    return s.with_df(rows.where(keep(F.struct(*s.order), F.col("__cut"))).drop("__cut"))


def take_while(s: Ordered, pred: Column) -> Ordered:
    """Rows before the first for which pred isn't true."""
    first = s.df.where(~F.coalesce(pred, F.lit(False))).agg(F.min(F.struct(*s.order)).alias("__cut"))
    return _against(s, first, lambda at, cut: cut.isNull() | (at < cut))


def drop_while(s: Ordered, pred: Column) -> Ordered:
    """Rows from the first for which pred isn't true."""
    first = s.df.where(~F.coalesce(pred, F.lit(False))).agg(F.min(F.struct(*s.order)).alias("__cut"))
    return _against(s, first, lambda at, cut: cut.isNotNull() & (at >= cut))


take_while2, drop_while2 = take_while, drop_while


def limit(s: Ordered, n: int) -> Ordered:
    return s.with_df(s.df.orderBy(*s.order).limit(max(n, 0)))


def skip(s: Ordered, n: int) -> Ordered:
    """All but the first n: rows after the nth, which a top-k finds."""
    if n <= 0:
        return s
    nth = s.df.select(F.struct(*s.order).alias("__at")).orderBy("__at").limit(n).agg(F.max("__at").alias("__cut"))
    return _against(s, nth, lambda at, cut: at > cut)


limit2, skip2 = limit, skip


def take_last(s: Ordered, n: int) -> Ordered:
    return s.with_df(s.df.orderBy(*[F.desc(c) for c in s.order]).limit(max(n, 0)))


def drop_last(s: Ordered, n: int) -> Ordered:
    if n <= 0:
        return s
    nth = s.df.select(F.struct(*s.order).alias("__at")).orderBy(F.desc("__at")).limit(n).agg(F.min("__at").alias("__cut"))
    return _against(s, nth, lambda at, cut: at < cut)


def step(s: Ordered, n: int) -> Ordered:
    """Every nth row from the first; all if n <= 1."""
    if n <= 1:
        return s
    at = s.index()
    return Ordered(at.df.where(F.col(IDX) % n == 0), [IDX])


def distinct_by(s: Ordered, *keys: Column | str) -> Ordered:
    """The first row of each key.

    By an aggregate of whole rows, so frequent keys are combined before the shuffle. NaN keys count as one key.
    """
    columns = s.df.columns
    named = [_col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    row = F.struct(*columns)
    one = s.df.groupBy(*named).agg(F.min_by(row, F.struct(*s.order)).alias("__row"))
    return s.with_df(one.select("__row.*"))


def distinct(s: Ordered, value: str = "value") -> Ordered:
    """The first of each value; every NaN is kept, as no NaN equals another."""
    if s.df.schema[value].dataType.typeName() not in ("double", "float"):
        return distinct_by(s, value)
    # a NaN is a key of its own by its place
    return distinct_by(s, value, F.when(F.isnan(value), F.to_json(F.struct(*s.order))))


def distinct_keys(s: Ordered) -> Ordered:
    return distinct_by(s, "key")


def distinct_values(s: Ordered) -> Ordered:
    return distinct(s, "value")


def distinct_until_changed(s: Ordered, value: Column | str = "value") -> Ordered:
    """Rows whose value isn't that of the row before; NaN never equals."""
    x = _col(value)
    marked = s.with_df(s.df.withColumn("__x", x)).over(1, 0, __was=lambda w: F.lag("__x").over(w))
    nan = _nan(marked.df, "__x")
    keep = (F.col(IDX) == 0) | nan | ~F.col("__x").eqNullSafe(F.col("__was"))
    return Ordered(marked.df.where(keep).drop("__x", "__was"), [IDX])


def distinct_until_changed_by(s: Ordered, eq: Callable[[Column, Column], Column], by: list[str] | None = None, value: str = "value") -> Ordered:
    """Rows that eq(last kept value, value) doesn't hold for, in each group of `by`.

    Each depends on the last kept one. The groups, one after another, are one chain, whose parts are folded at once; see chain.kept().
    """
    from rillframe.operators import chain

    groups, places = [f"__g{i}" for i in range(len(by or []))], [f"__o{i}" for i in range(len(s.order))]
    keys = [F.col(c).alias(k) for c, k in zip([*(by or []), *s.order], [*groups, *places], strict=True)]
    at = Ordered(s.df.select(F.struct(*s.df.columns).alias("__row"), *keys), [*groups, *places]).index().df

    def same(a: Column, b: Column) -> Column:
        held = F.coalesce(eq(a["x"], b["x"]), F.lit(False))
        for g in reversed(groups):
            held = a[g].eqNullSafe(b[g]) & held
        return held

    kept = chain.kept(at, F.struct(F.col(IDX).alias("p"), F.col("__row")[value].alias("x"), *groups), same)
    return s.with_df(at.join(kept, IDX).select("__row.*"))


# sorts


def sorted_by(s: Ordered, *keys: Column | str) -> Ordered:
    """Ordered by the keys, and by the old order where they tie (so every sort is stable); NaN below all."""
    names, columns = [], {}
    for i, k in enumerate(keys):
        columns[f"__s{i}"] = _col(k)
    df = s.df.withColumns(columns)
    for name in columns:
        if df.schema[name].dataType.typeName() in ("double", "float"):
            df = df.withColumn(f"{name}n", ~F.isnan(name))
            names.append(f"{name}n")
        names.append(name)
    return Ordered(df, [*names, *s.order])


sorted_, sorted_stable, sorted_stable_by = sorted_by, sorted_by, sorted_by


def sorted_with(s: Ordered, compare: Callable[[Column, Column], Column]) -> Ordered:
    """Ordered by any comparison of two rows (structs) that gives a negative, zero or positive int. It holds all rows in one array."""
    from rillframe.ordered import in_order

    rows = F.array_sort(in_order(F.struct(*s.df.columns), s.order), compare)
    out = s.df.agg(rows.alias("__all")).select(F.posexplode("__all").alias("__rank", "__row")).select("__row.*", F.col("__rank").cast("long").alias("__s"))
    return Ordered(out, ["__s"])


def reverse(s: Ordered) -> Ordered:
    at = s.index()
    return Ordered(at.df.withColumn("__back", -F.col(IDX)).drop(IDX), ["__back"])


# top and bottom


def top_k(s: Ordered, k: int, *keys: Column | str) -> Ordered:
    """The k largest by keys, largest first; ties by the order."""
    by = [_col(x).desc() for x in (keys or ("value",))]
    return _ranked(s, k, by)


def bottom_k(s: Ordered, k: int, *keys: Column | str) -> Ordered:
    by = [_col(x).asc() for x in (keys or ("value",))]
    return _ranked(s, k, by)


def _ranked(s: Ordered, k: int, by: list[Column]) -> Ordered:
    few = s.df.orderBy(*by, *s.order).limit(max(k, 0))
    return Ordered(few.withColumn("__rank", F.row_number().over(Window.orderBy(*by, *s.order))), ["__rank"])  # k rows


def top_k_by_group(s: Ordered, group: list[str], k: int, *keys: Column | str, largest: bool = True) -> DataFrame:
    """The k largest (or smallest) rows of each group, with rank from 1; Spark keeps k rows of a group for each task before it shuffles."""
    by = [_col(x).desc() if largest else _col(x).asc() for x in (keys or ("value",))]
    w = Window.partitionBy(*group).orderBy(*by, *s.order)
    return s.df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))


# single rows


def first(s: Ordered) -> DataFrame:
    return s.df.orderBy(*s.order).limit(1).select(*s.columns)


def last(s: Ordered) -> DataFrame:
    return s.df.orderBy(*[F.desc(c) for c in s.order]).limit(1).select(*s.columns)


first2 = first


def find_first(s: Ordered, pred: Column) -> DataFrame:
    return first(s.with_df(s.df.where(pred)))


find_first_ctx = find_first


def find_last(s: Ordered, pred: Column) -> DataFrame:
    return last(s.with_df(s.df.where(pred)))


def at(s: Ordered, i: int) -> DataFrame:
    """The row at a 0-based position; none if i is negative or beyond."""
    if i < 0:
        return s.df.limit(0).select(*s.columns)
    few = s.df.orderBy(*s.order).limit(i + 1)
    return few.orderBy(*s.order).offset(i).select(*s.columns)


nth = at


def single(s: Ordered) -> DataFrame:
    """The only row, or none."""
    two = s.df.orderBy(*s.order).limit(2).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    return two.where("__n = 1").select(*s.columns)
