"""Side effects, resources and cancellation."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from rillframe.ordered import IDX, Ordered


def for_each(s: Ordered, action: Callable) -> None:
    """action(row) on the driver, in order; rows stream through."""
    for row in s.sorted().toLocalIterator():
        action(row)


for_each2 = for_each


def for_each_indexed(s: Ordered, action: Callable) -> None:
    for i, row in enumerate(s.sorted().toLocalIterator()):
        action(i, row)


def for_each_err(s: Ordered, action: Callable) -> Exception | None:
    """Stops at the first row for which the action gives or raises an error, and returns that."""
    return for_each_indexed_err(s, lambda _, row: action(row))


def for_each_indexed_err(s: Ordered, action: Callable) -> Exception | None:
    for i, row in enumerate(s.sorted().toLocalIterator()):
        try:
            found = action(i, row)
        except Exception as e:
            return e
        if isinstance(found, Exception):
            return found
    return None


def parallel_for_each(s: Ordered, action: Callable) -> None:
    """action(row) on the executors, in no order; a task that is tried again repeats its rows."""
    s.df.select(*s.columns).foreach(action)


def for_each_partition(s: Ordered, action: Callable[[Iterator], None]) -> None:
    s.df.select(*s.columns).foreachPartition(action)


def try_collect(s: Ordered) -> tuple[bool, list | None, str | None]:
    """(ok, rows, err): an error of the job instead of a raise, and no partial rows."""
    try:
        return True, s.collect(), None
    except Exception as e:
        return False, None, str(e)


@contextlib.contextmanager
def using(df: DataFrame):
    """df kept by Spark's cache within the block."""
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


class ContextError(Exception):
    """A job that was cancelled or ran out of time; the cause is Spark's error."""

    def unwrap(self) -> BaseException | None:
        return self.__cause__


def with_context(s: Ordered, job: Callable[[Ordered], object], seconds: float | None = None, done: threading.Event | None = None):
    """job(s) with its Spark jobs interrupted when time is up or `done` is set; raises ContextError then. Spark gives no partial results."""
    spark = s.df.sparkSession
    tag = f"rillframe-{uuid.uuid4().hex}"
    over, hit = threading.Event(), threading.Event()

    def watch():
        waited = 0.0
        while not over.is_set():
            if (done is not None and done.is_set()) or (seconds is not None and waited >= seconds):
                hit.set()
                spark.interruptTag(tag)
            over.wait(0.05)
            waited += 0.05

    spark.addTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        if done is not None and done.is_set():
            raise ContextError("cancelled before it began")
        result = job(s)
    except ContextError:
        raise
    except Exception as e:
        if hit.is_set():
            raise ContextError("cancelled") from e
        raise
    finally:
        over.set()
        spark.removeTag(tag)
    return result


with_context2 = with_context
for_each_ctx = collect_within = with_context


def for_each_position(s: Ordered) -> Ordered:
    """With the position at hand as the column IDX, for sinks that want it."""
    return Ordered(s.index().df, [IDX])
