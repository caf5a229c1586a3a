"""Pieces that several training-data operators share.

Text reaches Python as UTF-8 bytes (one Arrow binary column); whole blocks of documents are handled with numpy at once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.session import ship as ship_package

#: Bytes of text that one numpy block holds at most (a longer document is a block of its own).
BLOCK = 1_000_000

#: What one Arrow batch holds at most; texts differ in length by a factor of thousands, so rows alone don't bound it.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "5000"}

def _lean_malloc() -> None:
    """Arrays of a block reuse the memory of the block before, without the system's clearing pages anew; tidy() gives it back after a task."""
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except OSError:  # another C library
        return


_lean_malloc()


def tidy() -> None:
    """Give unused memory back at the end of a task: workers stay for the next one."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        return


@lru_cache(maxsize=1)
def _one_thread() -> None:
    """Products of matrices in this worker run in one thread: the cores are dealt to tasks already, and small products lose by more."""
    import ctypes
    import glob
    import os

    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def tidied(run):
    """A function over batches for a worker, which tidies up when its batches are done."""

    def tidy_run(batches):
        _one_thread()
        yield from run(batches)
        tidy()

    return tidy_run


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BYTE_KEYS = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the rolling base (up) or of its inverse (down) modulo 2**64, at least n of them."""
    got = _powers.get(kind)
    if got is None or len(got) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        size = max(n, BLOCK + 1)
        got = np.full(size, step, np.uint64)
        got[0] = 1
        got = np.cumprod(got)
        _powers[kind] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which substring_hash() takes the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * _power("up", len(data))[: len(data)], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal strings have equal hashes wherever they stand."""
    down = _power("down", len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ([^\\x20\\x09-\\x0D]+) and the number of words of each document."""
    inside = ~_WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word with A-Z lowered, and the number of words of each document."""
    starts, ends, counts = word_bounds(data, offsets)
    return substring_hash(rolling(_LOWER[data]), starts, ends), counts


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of at most `most` bytes; null texts are empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type)
    raw = texts.buffers()
    ends = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        stop = min(stop, len(texts))
        yield slice(row, stop), data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def text_bytes(text: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one if that is unset (single machine only)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rillframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_kept: dict[str, SparkSession] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rillframe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(path: str) -> None:
    spark = _kept.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path in _kept:
            _delete(path)


def forget_stored() -> None:
    """Delete all that stored() wrote and release() hasn't. Frames that still read it stop working."""
    while _kept:
        try:
            _delete(next(iter(_kept)))
        except Exception:  # the session is over; the folder is the cluster's to clean
            return


atexit.register(forget_stored)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for columns of any names, on both sides; schema: the result's StructType."""
    from pyspark.sql.types import StructField, StructType

    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    made = StructType([StructField(f"r{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])

    def renamed(batches):
        out = [f"r{i}" for i in range(len(made))]
        for b in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=out)

    return plain.mapInArrow(tidied(renamed), made).toDF(*[f.name for f in schema])


def annotate(df: DataFrame, compute, fields: str, text: str = "text", keep: list[str] | None = None, most: int = BLOCK) -> DataFrame:
    """df's columns (or those in `keep`) and the new ones that compute(bytes, offsets) returns for each block of texts.

    fields: DDL of the new columns, in the order of the arrays that compute returns. A new column replaces one of the same name.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    new = [f.name for f in added]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    work = "__text_bytes"
    while work in keep:
        work += "_"
    fed = df.select(*[quoted(c) for c in keep], text_bytes(quoted(text)).alias(work))
    schema = StructType([df.schema[c] for c in keep] + list(added))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch, work, most):
                part = batch.slice(rows.start, rows.stop - rows.start)
                arrays = compute(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=keep + new)

    return map_arrow(fed, run, schema)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(docs: DataFrame, *names: str | None) -> tuple[DataFrame, list[str | None]]:
    """docs with its columns named c0, c1, … by their places, and those names of `names` (None where docs has none such).

    Operators that return docs' own columns work on these, so that no name of theirs meets one of the user's, and rename at the end.
    """
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    loose = {c.lower(): place for c, place in places.items()}
    return docs.toDF(*places.values()), [None if n is None else places.get(n, loose.get(n.lower())) for n in names]


def ship(spark: SparkSession) -> SparkSession:
    """The package on all workers, and texts in small batches."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return ship_package(spark)
