"""A query is a function of a session and a folder of tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillframe.ordered import Ordered
from rillframe.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def by(self, name: str, *order: str) -> Ordered:
        return Ordered(getattr(self, name), list(order))

    @property
    def events_in_order(self) -> Ordered:
        return self.by("events", "event_id")


def query(sql: str | None = None):
    """Registers a function of Tables under its name; it gives a frame or an ordered frame, whose own columns are left out."""

    def register(fn: Callable[[Tables], DataFrame | Ordered]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(ship(spark), folder))
            return out.rows() if isinstance(out, Ordered) else out

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register
