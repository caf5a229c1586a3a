"""Searching vectors in shards: a task holds a group of shards, and every block of queries streams past every group once."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from rillframe.llm.common import quoted, stored, tidied

#: Vectors of a shard and queries of a block, about; numbers of the shards that a task holds at once, at most (but for one shard).
SHARD, BLOCK, HELD = 4096, 1024, 1 << 23
#: The place of blocks in the order of a task's rows: after all shards.
AFTER = 2**31 - 1


def rows_of(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(row, id, v) of the vectors that take part: not null, all components finite, and, if asked, not all zero; `row` tells repeated rows apart."""
    v = quoted(vector)
    if not isinstance(getattr(df.select(v).schema[0].dataType, "elementType", None), FloatType):
        v = v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = quoted(vector).isNotNull() & ~bad
    if nonzero:
        keep = keep & F.exists(v, lambda x: x != 0)
    slim = df.select(F.monotonically_increasing_id().alias("row"), quoted(key).cast("long").alias("id"), v.alias("v"), keep.alias("ok"))
    return stored(slim.where("ok").drop("ok"), "vectors")


def _matrix(found: list[pa.RecordBatch], prepare: Callable[[np.ndarray], object]) -> dict:
    """Rows and ids of batches, the padded matrix, and what prepare() makes of the matrix."""
    t = pa.Table.from_batches(found)
    lists = t.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    # null ids come last
    absent = t.column("id").is_null().to_numpy()
    ids = t.column("id").fill_null(2**63 - 1).to_numpy()
    return {"row": t.column("row").to_numpy(), "id": ids, "absent": absent, "x": x, "made": prepare(x)}


def _blocks(queries: DataFrame, parts: int, prepare: Callable[[np.ndarray], object]) -> DataFrame:
    """One pickled block for each of `parts` partitions; its matrix in single precision if that loses nothing."""

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        body = _matrix(found, prepare)
        short = body["x"].astype(np.float32) if np.abs(body["x"]).max(initial=0) < 2.0**120 else body["x"]
        if (short == body["x"]).all():
            body["x"] = short
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(body, protocol=5)], pa.binary())], names=["body"])

    return stored(queries.repartition(parts).mapInArrow(tidied(run), "body binary"), "blocks")


def _padded(side: dict, width: int) -> dict:
    x = side["x"]
    return side if x.shape[1] == width else side | {"x": np.pad(x, ((0, 0), (0, width - x.shape[1])))}


def _meet(block: dict, shards: list[dict], k: int, find) -> tuple[np.ndarray, ...]:
    """The k best of all shards for each query, as (query's place, score, candidate's id, whether that is null)."""
    kept: tuple[np.ndarray, ...] = ()
    # the kth score so far, for those that can use it
    block = block | {"x": block["x"].astype(float), "least": np.full(len(block["x"]), -np.inf)}
    for shard in shards:
        width = max(block["x"].shape[1], shard["x"].shape[1])
        shard = _padded(shard, width)
        q, c, score = find(_padded(block, width), shard, k)
        new = (q, score, shard["id"][c], shard["absent"][c])
        kept = tuple(np.concatenate(x) for x in zip(kept, new, strict=True)) if kept else new
        down = ~kept[1] if kept[1].dtype.kind == "i" else -kept[1]
        by = np.lexsort((kept[3], kept[2], down, kept[0]))
        sorted_q = kept[0][by]
        place = np.arange(len(by)) - np.searchsorted(sorted_q, sorted_q)
        kept = tuple(x[by[place < k]] for x in kept)
        block["least"][sorted_q[place == k - 1]] = kept[1][place[place < k] == k - 1]
    return kept


def search(rows: DataFrame, queries: DataFrame, k: int, prepare_shard, prepare_block, find, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score): find(block, shard, k) gives (query's place, candidate's place, score) of up to k for each query.

    block["least"] holds each query's kth score in the shards before: what is below it needn't be found.

    A shard's vectors go to one task, which holds as many shards as HELD allows, at most, and then reads the blocks. So queries are sent once
    for each group of shards, nothing is joined, and the driver gets counts alone. (Joined, blocks times shards is a side that Spark takes
    for as small as the blocks, and broadcasts.)
    """
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    m = queries.count()
    parts = max(1, -(-n // SHARD))
    held = max(1, HELD // (SHARD * max(1, width or 0)))
    groups = max(-(-parts // held), min(parts, 4 * rows.sparkSession.sparkContext.defaultParallelism))

    shard = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    blocks = _blocks(queries, max(1, -(-m // BLOCK)), prepare_block)
    none = lambda name, of: F.lit(None).cast(of.schema[name].dataType).alias(name)
    one = rows.select((shard % groups).alias("part"), shard.alias("shard"), "row", "id", "v", none("body", blocks))
    two = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(AFTER).alias("shard"), none("row", rows), none("id", rows), none("v", rows), "body")
    dealt = one.unionByName(two).repartitionById(groups, "part").sortWithinPartitions("part", "shard")

    def met(block: dict, shards: list[dict]) -> Iterator[pa.RecordBatch]:
        if shards:
            q, score, ids, absent = _meet(block, shards, k, find)
            yield pa.RecordBatch.from_arrays([pa.array(block["row"][q]), pa.array(block["id"][q], mask=block["absent"][q]), pa.array(ids, mask=absent), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

    def run(batches):
        shards, found, at = [], [], None
        for batch in batches:
            part, number = batch.column("part").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(number) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if a == b:
                    continue
                if at != (part[a], number[a]):
                    if found:
                        shards.append(_matrix(found, prepare_shard))
                        found = []
                    if at and at[0] != part[a]:
                        shards = []
                    at = (part[a], number[a])
                if number[a] == AFTER:
                    for body in batch.column("body").slice(a, b - a):
                        yield from met(pickle.loads(body.as_py()), shards)
                else:
                    found.append(batch.slice(a, b - a))

    best = dealt.mapInArrow(tidied(run), f"row bigint, query_id bigint, vec_id bigint, score {kind}")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Best:
    """The k best candidates of each query so far, by score and then by smaller id; none below `least`, if that is given."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.least = np.full(queries, -np.inf) if least is None else least
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.place = np.full((queries, k), -1)

    def worst(self, of) -> np.ndarray:
        return np.maximum(self.score[of, -1], self.least[of])

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """score: queries `of`, each once, by candidates; -inf is none."""
        k = self.score.shape[1]
        r, c = np.nonzero((score >= self.worst(of)[:, None]) & (score > -np.inf))
        if not len(r):
            return
        q = of[r]
        hit = np.unique(q)
        q = np.concatenate([np.repeat(hit, k), q])
        score, ids, places = (np.concatenate([old[hit].ravel(), new]) for old, new in ((self.score, score[r, c]), (self.id, ids[c]), (self.place, places[c])))
        by = np.lexsort((ids, -score, q))
        by = by[np.arange(len(by)) - np.searchsorted(q[by], q[by]) < k].reshape(len(hit), k)
        self.score[hit], self.id[hit], self.place[hit] = score[by], ids[by], places[by]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.place >= 0)
