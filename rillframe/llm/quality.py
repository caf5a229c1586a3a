"""Quality classifier: ridge scores on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import annotate, plain, quoted, remainder, rolling, stored, substring_hash, tidied, word_bounds

#: Byte classes, each a statistic of its own (share and logarithm of the count).
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".", ",", "!?", "|", "#$%&*", "\"'()[]{}<>", ":;=/\\", "-_+~^`@")
_CLASS = np.full(256, len(CLASSES), np.int64)  # bytes of other characters are the last class
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _i
N_CLASSES = len(CLASSES) + 1
N_STATS = 2 * N_CLASSES + 7


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATS finite numbers for each document; an empty one has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    starts, ends, words = word_bounds(data, offsets)
    sums = rolling(data)
    word_doc = np.repeat(np.arange(n), words)

    def distinct(hashes, of):
        order = np.lexsort((hashes, of))
        h, d = hashes[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n)

    length = (ends - starts).astype(float)
    distinct_words = distinct(substring_hash(sums, starts, ends), word_doc)
    breaks = np.flatnonzero(data == 10)
    full = size > 0
    line_starts = np.unique(np.concatenate([offsets[:-1][full], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    distinct_lines = distinct(substring_hash(sums, line_starts, line_ends), line_doc) if len(line_starts) else np.zeros(n)
    per = np.maximum(words, 1)
    mean_length = np.bincount(word_doc, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(word_doc, length**2, n) / per - mean_length**2, 0))
    return np.column_stack([counts / np.maximum(size, 1)[:, None], np.log1p(counts), np.log1p(words), mean_length, spread, distinct_words / per, np.log1p(lines), distinct_lines / np.maximum(lines, 1), words / np.maximum(lines, 1)]).astype(np.float32)


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "stats") -> DataFrame:
    def compute(data, offsets):
        rows = statistics(data, offsets)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, N_STATS), pa.int32()), pa.array(rows.ravel()))]

    return annotate(docs, compute, f"`{out}` array<float>", text, keep)


@dataclass
class QualityModel:
    """Standardization, random features, ridge weights and the steps of the calibration; its size doesn't depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(x @ self.freq + self.phase) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1) if len(stats) else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(float)


def _sums(df: DataFrame, compute, width: int) -> np.ndarray:
    """The sum over all rows of compute(statistics, labels), `width` numbers; partitions add up theirs, a few tasks add those, the driver the rest."""
    def part(batches):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += compute(_matrix(b.column("stats")), b.column("label").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merge(batches):
        total = np.zeros(width)
        for b in batches:
            for x in b.column("sums"):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = df.select("stats", "label").mapInArrow(tidied(part), "sums binary").repartition(4).mapInArrow(tidied(merge), "sums binary")
    return sum((np.frombuffer(r[0]) for r in parts.collect()), np.zeros(width))


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit_quality(labelled: DataFrame, calibrate, n_features: int = 384, width: float = 0.18, ridge: float = 1e-6, bins: int = 512, seed: int = 3) -> QualityModel:
    """Fit on rows of (stats, label 0/1); `calibrate` is a condition on the rows that calibrate and don't fit.

    Three passes over the statistics: moments, normal equations, and counts by bins of the raw score. Each pass returns sums of a fixed size.
    Without any labelled row, every score is 0.5.
    """
    fitted = labelled.where(~calibrate)
    d = N_STATS
    sums = _sums(fitted, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 2 * d + 1)
    n = max(sums[0], 1)
    mean = sums[1 : d + 1] / n
    scale = np.sqrt(np.maximum(sums[d + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    m = n_features + 1
    model = QualityModel(mean, scale, rng.standard_normal((d, n_features)) * width, rng.uniform(0, 2 * np.pi, n_features), np.zeros(m), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not sums[0]:
        return model

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sums(fitted, normal, m * m + m)
    model.weights = np.linalg.solve(sums[: m * m].reshape(m, m) + ridge * n * np.eye(m), sums[m * m :])
    low, high = -0.5, 1.5

    def binned(x, y):
        i = np.clip(((model.raw(x) - low) / (high - low) * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(i, minlength=bins), np.bincount(i, y, bins)])

    sums = _sums(labelled.where(calibrate), binned, 2 * bins)
    if not sums[:bins].sum():
        sums = _sums(fitted, binned, 2 * bins)
    some = np.flatnonzero(sums[:bins])
    count, good = sums[:bins][some], sums[bins:][some]
    levels = pool_adjacent(good / count, count)
    slope = 1e-4 * (some + 0.5) / bins  # keeps the order within a level
    model.knots, model.levels = low + (some + 0.5) / bins * (high - low), np.clip(levels * (1 - 1e-4) + slope, 0, 1)
    return model


def score_statistics(stats: DataFrame, model: QualityModel, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """`keep` columns with score and predicted."""
    from pyspark.sql.types import StructType

    schema = StructType([stats.schema[c] for c in keep]).add("score", "double").add("predicted", "integer")

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column("stats"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=[*keep, "score", "predicted"])

    return stats.select(*keep, "stats").mapInArrow(tidied(run), schema)


def _labelled(stats: DataFrame, labels: DataFrame, key: str, label: str, learn) -> DataFrame:
    """Statistics of labelled rows; several labels of a key are averaged, null keys and labels don't count."""
    one = labels.where(quoted(key).isNotNull() & quoted(label).isNotNull()).groupBy(quoted(key).alias("_label_key")).agg(F.avg(quoted(label)).alias("label"))
    return stats.where(learn).join(one, F.col("_key") == F.col("_label_key")).drop("_label_key")


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = 0.3, **fit) -> DataFrame:
    """(key, held_out, score, predicted) of each row, learnt from labels of rows whose crc32(key) modulo `folds` isn't 0.

    Only statistics of the text are inputs. Of the rows that may be learnt from, those of the last fold calibrate. Null and empty texts have
    all-zero statistics and get a score like others. Null keys are scored and not learnt from. Repeated rows are scored each and learnt
    from each; an empty table gives no rows. Other columns don't matter.
    """
    stats, model = _fit(docs, labels, key, text, label, folds, fit)
    return score_statistics(stats, model, ["_key", "held_out"], threshold).withColumnRenamed("_key", key)


def _fit(docs, labels, key, text, label, folds, fit):
    slim = docs.select(quoted(key).alias("_key"), quoted(text).alias("text")).withColumn("_fold", remainder("_key", folds)).withColumn("held_out", F.col("_fold") == 0)
    stats = stored(with_statistics(slim, keep=["_key", "_fold", "held_out"]), "quality")
    labelled = stored(_labelled(stats, labels, key, label, ~F.col("held_out")).select("stats", "label", "_fold"), "labelled")
    return stats, fit_quality(labelled, F.col("_fold") == folds - 1, **fit)


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = 0.3, **fit) -> DataFrame:
    """The rows of docs, all columns as they were, that the classifier doesn't reject (score at least `threshold`).

    Learnt as in classify_quality. Null and empty texts are judged by their all-zero statistics, null keys and repeated rows like others, each by
    its own text; texts of any length are read whole. An empty table gives no rows. Columns may have any names and types.
    """
    _, model = _fit(docs, labels, key, text, label, folds, fit)
    rows, (text,) = plain(docs, text)

    def compute(data, offsets):
        return [model.score(statistics(data, offsets).astype(float)) >= threshold]

    return annotate(rows, compute, "kept boolean", text).where("kept").drop("kept").toDF(*docs.columns)
