"""Operators that keep state between micro-batches, one state for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def _times(pdf: pd.DataFrame, ts: str) -> pd.Series:
    return pd.to_datetime(pdf[ts], utc=True).astype("int64") // 1_000_000 if str(pdf[ts].dtype) == "object" else pdf[ts].astype("datetime64[ms]").astype("int64")


def scan(df: DataFrame, by: list[str], init, step: Callable, kind: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """(by…, ts, value): all states of a fold for each key, rows of a micro-batch in order of ts."""
    schema = StructType([df.schema[c] for c in [*by, ts]] + list(StructType.fromDDL(f"value {kind}")))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else init
        rows = pd.concat(list(batches)).sort_values(ts)
        states = []
        for x in rows[value]:
            now = step(now, x)
            states.append(now)
        state.update((now,))
        yield pd.DataFrame({**{c: [k] * len(rows) for c, k in zip(by, key, strict=True)}, ts: rows[ts].to_numpy(), "value": states})

    return df.groupBy(*by).applyInPandasWithState(run, schema, StructType.fromDDL(f"now {kind}"), "append", GroupStateTimeout.NoTimeout)


def distinct_until_changed(df: DataFrame, by: list[str], kind: str, value: str = "value", ts: str = "ts", eq: Callable | None = None) -> DataFrame:
    """(by…, ts, value): rows that differ from the last kept one of their key."""
    same = eq or (lambda a, b: a == b)
    schema = StructType([df.schema[c] for c in [*by, ts]] + list(StructType.fromDDL(f"value {kind}")))

    def run(key, batches, state):
        has, last = state.exists, state.get[0] if state.exists else None
        rows, kept = pd.concat(list(batches)).sort_values(ts), []
        for x in rows[value]:
            keep = not has or not same(last, x)
            kept.append(keep)
            if keep:
                has, last = True, x
        state.update((last,))
        rows = rows[kept]
        yield pd.DataFrame({**{c: [k] * len(rows) for c, k in zip(by, key, strict=True)}, ts: rows[ts].to_numpy(), "value": rows[value].to_numpy()})

    return df.groupBy(*by).applyInPandasWithState(run, schema, StructType.fromDDL(f"last {kind}"), "append", GroupStateTimeout.NoTimeout)


def debounce(df: DataFrame, by: list[str], quiet_ms: int, kind: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """(by…, at, value): the last value of each key before a quiet time, once the watermark has passed it. at: milliseconds.

    df needs a watermark on ts; late rows are dropped by it.
    """
    schema = StructType([df.schema[c] for c in by] + list(StructType.fromDDL(f"at bigint, value {kind}")))

    def run(key, batches, state):
        out = []
        if state.hasTimedOut:
            at, last = state.get
            out.append((at, last))
            state.remove()
        else:
            rows = pd.concat(list(batches))
            rows = rows.assign(__t=_times(rows, ts)).sort_values("__t")
            at, last = state.get if state.exists else (None, None)
            for t, x in zip(rows["__t"].tolist(), rows[value].tolist(), strict=True):
                if at is not None and t - at > quiet_ms:
                    out.append((at, last))
                if at is None or t >= at:
                    at, last = t, x
            state.update((at, last))
            state.setTimeoutTimestamp(max(at + quiet_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{c: [k] * len(out) for c, k in zip(by, key, strict=True)}, "at": [a for a, _ in out], "value": [x for _, x in out]})

    return df.groupBy(*by).applyInPandasWithState(run, schema, StructType.fromDDL(f"at bigint, last {kind}"), "append", GroupStateTimeout.EventTimeTimeout)


def timeout(df: DataFrame, by: list[str], limit_ms: int, kind: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """(by…, ok, value, err, at): each row, and an error for each time that `limit_ms` passed without one of its key."""
    schema = StructType([df.schema[c] for c in by] + list(StructType.fromDDL(f"ok boolean, value {kind}, err string, at bigint")))
    late = "deadline exceeded"

    def run(key, batches, state):
        out = []
        if state.hasTimedOut:
            (at,) = state.get
            at += limit_ms
            out.append((False, None, late, at))
            state.update((at,))
            state.setTimeoutTimestamp(max(at + limit_ms, state.getCurrentWatermarkMs() + 1))
        else:
            rows = pd.concat(list(batches))
            rows = rows.assign(__t=_times(rows, ts)).sort_values("__t")
            at = state.get[0] if state.exists else None
            for t, x in zip(rows["__t"].tolist(), rows[value].tolist(), strict=True):
                while at is not None and t - at > limit_ms:
                    at += limit_ms
                    out.append((False, None, late, at))
                at = t
                out.append((True, x, None, t))
            state.update((at,))
            state.setTimeoutTimestamp(max(at + limit_ms, state.getCurrentWatermarkMs() + 1))
        names = ("ok", "value", "err", "at")
        yield pd.DataFrame({**{c: [k] * len(out) for c, k in zip(by, key, strict=True)}, **{n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)}})

    return df.groupBy(*by).applyInPandasWithState(run, schema, StructType.fromDDL("at bigint"), "append", GroupStateTimeout.EventTimeTimeout)
