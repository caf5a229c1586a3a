"""Mixing sources to target weights.

Each document gets a hash-random key; documents are range-sorted by (source, key), prefix sums of their sizes run over the sorted
partitions, and each source is cut at its exact budget after as many whole epochs as the budget holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import annotate, partitions, plain, quoted, stored, tidied, word_bounds

#: Weights by the rank of a source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many epochs.
EPOCHS = 3


def word_counts(df: DataFrame, text: str = "text", out: str = "size", keep: list[str] | None = None) -> DataFrame:
    """df with the number of words ([^\\x20\\x09-\\x0D]+) of each text; a null text has none."""

    def count(data, offsets):
        return [word_bounds(data, offsets)[2].astype(np.int64)]

    return annotate(df, count, f"`{out}` bigint", text, keep)


def _sorted_runs(df: DataFrame, order: list[str], group: list[str], label: str) -> DataFrame:
    """df range-sorted by `order` (which starts with `group`), with the partition's number and, in it, the sum of `size` before each row of the group."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id().cast("long"))
    schema = ranged.withColumn("_before", F.lit(0).cast("long")).schema

    def run(batches):
        held, total = None, 0  # the last row's group, and its sum so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)  # where a group begins
            for g in group:
                column = batch.column(g)
                fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = [batch.column(g)[0].as_py() for g in group]
            fresh[0] = first != held
            sizes = batch.column("size").to_numpy()
            before = np.cumsum(sizes) - sizes
            heads = np.flatnonzero(fresh)
            start = np.where(np.arange(n) < (heads[0] if len(heads) else n), -total, 0)
            if len(heads):
                start[heads[0] :] = np.repeat(before[heads], np.diff(np.append(heads, n)))
            before = before - start
            held, total = [batch.column(g)[n - 1].as_py() for g in group], int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "_before"])

    return stored(ranged.mapInArrow(tidied(run), schema), label)


def prefix_sums(df: DataFrame, order: list[str], group: list[str], label: str = "runs") -> DataFrame:
    """df with `start`: the sum of `size` over all rows of the same group that come earlier by `order`.

    One exchange by range, so a group of any size spreads over many tasks; what the driver plans with is a row for each (partition, group).
    The group columns must not hold nulls.
    """
    from pyspark.sql import Window

    runs = _sorted_runs(df, order, group, label)
    ends = runs.groupBy("_part", *group).agg(F.sum("size").alias("_sum"))
    offsets = ends.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = runs.join(offsets.drop("_sum"), ["_part", *group])
    return joined.withColumn("start", F.col("_before") + F.col("_offset")).drop("_part", "_before", "_offset")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The target of each source of (absent, name, source_size): shares of all words by weight, none above `epochs` times its size.

    Weights go to sources by code point order of the name, the absent (null) one last. Words that a full source can't give are shared out
    again by weight, until none is above its limit. Each round is one small aggregate over the sources; rounds end, as sources only fill up.
    """
    # ranks by a distributed prefix sum too: the number of sources has no bound
    ranked = prefix_sums(sources.withColumn("size", F.lit(1).cast("long")), ["absent", "name"], [], "sources").drop("size")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("start") % len(weights) + 1).cast("int"))).drop("start")
    limit = F.col("source_size") * epochs
    all_words = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1]) >= limit
        taken, weight, n = ranked.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        new = (float(all_words - taken), float(weight), n)
        if new == level or not weight:
            break
        level = new
    if level is None or not level[1]:
        return ranked.withColumn("target", limit.cast("double"))
    return ranked.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(level[0]) / F.lit(level[1])))


def random_key(key: str | Column, seed: int) -> Column:
    """A hash-random key that depends on the seed and the row's own key alone."""
    key = quoted(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """(key, size, source_size, target, taken) of each row: the words that the mix takes from it, repeats counted.

    Rows of a source stand in order of a seeded hash of their key. The mix takes as many whole epochs as the target holds and then rows from
    the start until the target, rounded to words, is met exactly; the row at the cut gives its first words only. So a row gives its size
    times a whole number, and one row of each source a part more, never over `epochs` times its size. Null texts have size 0 and give 0;
    null sources are a source of their own, last; null and repeated keys are rows like others (ties by size, then alike in all that matters).
    An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    plan = _plan(docs, key, source, text, F.lit(0).cast("long"), weights, epochs, seed)
    return plan.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def _plan(docs: DataFrame, key: str, source: str, text: str, tag: Column, weights: tuple[int, ...], epochs: int, seed: int) -> DataFrame:
    slim = word_counts(docs.select(quoted(key).alias("key"), tag.alias("tag"), quoted(text).alias("text"), quoted(source).isNull().alias("absent"), F.coalesce(quoted(source).cast("string"), F.lit("")).alias("name")), keep=["key", "tag", "absent", "name"])
    slim = stored(slim, "sizes")  # the range partitioner reads its input twice
    runs = prefix_sums(slim.withColumn("_random", random_key("key", seed)), ["absent", "name", "_random", "key", "size", "tag"], ["absent", "name"], "mix")
    goal = targets(runs.groupBy("absent", "name").agg(F.sum("size").alias("source_size")), weights, epochs)
    mixed = runs.join(goal, ["absent", "name"])
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    mixed = mixed.withColumn("_whole", whole).withColumn("_rest", budget - F.col("_whole") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("start")))
    return mixed.withColumn("taken", (F.col("_whole") * F.col("size") + part).cast("long"))


def take_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", n_chars: str | None = "n_chars", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """The mixed rows themselves, in docs' columns: a row for each whole epoch and, at a source's cut, one whose text ends there.

    Rows that the mix takes nothing from are gone, null, empty and blank texts among them. Repeated rows count one by one, as in mix_sources;
    null keys and sources are as there. Texts of any length are counted and cut whole. An empty table gives no rows. Other columns stay as they
    are, whatever their names and types.
    """
    names = docs.columns
    rows, (key, source, text, n_chars) = plain(docs, key, source, text, n_chars)
    # a number for each row, stored with it, so that the plan meets its very row
    rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    plan = _plan(rows, key, source, text, F.col("number"), weights, epochs, seed).where("taken > 0").select(F.col("tag").alias("number"), "size", "taken")
    # how many words each output row holds: whole epochs, then a part; `epochs` of them at most
    held = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")), lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))
    out = rows.join(plan, "number").withColumn("hold", F.explode(held))
    # one row of a source ends at its cut; only such texts go to Python
    cut = _first_words(F.when(F.col("hold") < F.col("size"), F.col(text)), F.col("hold"))
    out = out.withColumn("cut", cut).withColumn("taken_text", F.coalesce("cut", text))
    fresh = {text: F.col("taken_text")} | ({n_chars: F.length("taken_text").cast(rows.schema[n_chars].dataType)} if n_chars else {})
    return out.select(*[fresh.get(c, F.col(c)).alias(c) for c in rows.columns if c != "number"]).toDF(*names)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word; null stays null."""
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(texts, counts, strict=True):
            if t is None or t != t:
                out.append(None)
                continue
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            ends = word_bounds(raw, np.array([0, len(raw)]))[1]
            out.append(raw[: ends[int(k) - 1]].tobytes().decode("utf-8", "surrogatepass") if int(k) <= len(ends) else t)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(cut, "string")(text, n)
