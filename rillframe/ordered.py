"""Ordered frames: a DataFrame and the columns whose total order its rows have.

A DataFrame has no order, so operators that need one take it from named columns. Positions come from one exchange by range, chunked work
from the positions, so no operator gathers all rows in one task:

* index(): a dense position, from per-partition counts after a range sort;
* chunked(): rows by chunks of positions, with copies of a neighbour chunk's rows where a frame looks over the border;
* running(): prefix aggregates in two levels, within a sorted partition (or, of indexed frames, a chunk) and over their totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.session import shuffle_partitions, stable

#: Positions of a chunk.
CHUNK = 1 << 16
IDX = "__idx"
_ROWS = (1 << 33) - 1


class Ordered:
    """df ordered by the columns `order`, a total order. Columns whose names begin with two underscores are the library's own."""

    def __init__(self, df: DataFrame, order: Sequence[str] | str):
        self.df = df
        self.order = [order] if isinstance(order, str) else list(order)

    # frames

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def rows(self) -> DataFrame:
        """The rows without the library's own columns."""
        return self.df.select(*self.columns)

    def sorted(self) -> DataFrame:
        """The rows, sorted."""
        return self.df.orderBy(*self.order).select(*self.columns)

    def collect(self) -> list:
        return self.sorted().collect()

    def with_df(self, df: DataFrame, order: Sequence[str] | None = None) -> Ordered:
        return Ordered(df, self.order if order is None else order)

    def transform(self, fn: Callable[..., Ordered], *args, **kwargs) -> Ordered:
        return fn(self, *args, **kwargs)

    def position(self) -> Column:
        """The order columns as one comparable value."""
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)

    # positions

    def index(self) -> Ordered:
        """With a dense 0-based position in IDX, which becomes the order.

        One range exchange. A row's number in its sorted partition is in the low bits of its increasing id; the partitions' offsets are as
        many rows as partitions.
        """
        if self.order == [IDX]:
            return self
        spark = self.df.sparkSession
        base = self.df.drop(IDX)
        ranged = base.repartitionByRange(shuffle_partitions(spark), *self.order).sortWithinPartitions(*self.order)
        placed = stable(ranged.withColumn("__id", F.monotonically_increasing_id()))
        part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(_ROWS)
        counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
        # one row for each partition at most
        out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(IDX, F.col("__offset") + row)
        return Ordered(out.drop("__id", "__part", "__offset"), [IDX])

    def chunked(self, before: int = 0, after: int = 0, chunk: int = CHUNK) -> tuple[DataFrame, Column, object]:
        """(rows by chunk, whether a row is the chunk's own, the window of a chunk).

        A row is copied into each chunk that looks at it: `before` rows back or `after` rows ahead.
        """
        at = self.index()
        first = F.floor(F.greatest(F.col(IDX) - after, F.lit(0)) / chunk)
        last = F.floor((F.col(IDX) + before) / chunk)
        home = F.floor(F.col(IDX) / chunk)
        if not before and not after:
            rows = at.df.withColumn("__chunk", home)
        else:
            chunks = F.when((first == home) & (last == home), F.array(home)).otherwise(F.sequence(first, last))
            rows = at.df.withColumn("__chunk", F.explode(chunks))
        return rows, F.col("__chunk") == home, Window.partitionBy("__chunk").orderBy(IDX)

    def over(self, before: int, after: int, **new: Callable[[object], Column]) -> Ordered:
        """With columns computed over a window that sees `before` rows back and `after` rows ahead; each takes the window."""
        rows, own, window = self.chunked(before, after)
        out = rows.withColumns({name: make(window) for name, make in new.items()})
        return Ordered(out.where(own).drop("__chunk"), [IDX])

    def running(self, out: str, within: Callable[[object], Column], total: Callable[[], Column], over_totals: Callable[[object], Column], join: Callable[[Column, Column], Column]) -> Ordered:
        """With a prefix aggregate in `out`: within(window) inside a part of the rows, total() of a part, over_totals(window) of what is before it.

        An indexed frame's parts are chunks of positions; another frame's are the partitions of one exchange by range, and it keeps its order.
        """
        indexed = self.order == [IDX]
        if indexed:
            rows, _, window = self.chunked()
            rows = stable(rows)
        else:
            rows, window = self.parts(), Window.partitionBy("__chunk").orderBy(*self.order)
        totals = rows.groupBy("__chunk").agg(total().alias("__total"))
        # one row for each chunk of positions or partition
        carried = totals.select("__chunk", over_totals(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
        carried = carried if indexed else F.broadcast(carried)
        inside = rows.withColumn("__in", within(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        done = inside.join(carried, "__chunk").withColumn(out, F.when(F.col("__carry").isNull(), F.col("__in")).otherwise(join(F.col("__carry"), F.col("__in"))))
        return Ordered(done.drop("__chunk", "__in", "__carry"), self.order)

    def parts(self) -> DataFrame:
        """The rows with the number of their partition, `__chunk`, after one exchange by range: parts one after another in order."""
        ranged = self.df.repartitionByRange(shuffle_partitions(self.df.sparkSession), *self.order)
        return stable(ranged.withColumn("__chunk", F.spark_partition_id().cast("long")))


def ordered(df: DataFrame, *order: str) -> Ordered:
    return Ordered(df, list(order))


def in_order(value: Column | str, order: Sequence[str] | str) -> Column:
    """Aggregate: the values as an array in order, nulls kept. collect_list alone has no order after a shuffle and drops nulls."""
    order = [order] if isinstance(order, str) else list(order)
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), value.alias("x")))), lambda e: e["x"])
