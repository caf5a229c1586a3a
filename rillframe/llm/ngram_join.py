"""Similarity self-join of documents on sets of word n-grams by Jaccard, as a blocked sparse product of the incidence matrix.

A document's row of the incidence matrix has a one for each n-gram hash. If two rows are similar enough, the sizes bound their overlap from
below, and then they share a column among the first few of each row, in any one order of all columns. So the product runs in two steps:
over those leading columns alone, which gives the pairs whose bound can be met, and over whole rows for these pairs, block by block, adding
up overlaps. Columns are ordered from rare to frequent as far as a sample tells, so that few rows meet.

Rows with equal sets are one row from the start. Of rows that meet in a column, first each meets one of them only; pairs whose ends are
linked by then need no product, so a large group of near copies costs its size and not its square. Then all other pairs follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillframe.llm.common import annotate, blocks, mix, partitions, plain, quoted, release, remainder, stored, text_bytes, tidied, word_hashes
from rillframe.llm.graph import components

_U = np.uint64
#: A document in so many tells which n-grams are frequent, and at least so many of these must hold one; the order of columns alone
#: depends on that, never the result. At most FREQUENT are told apart.
SAMPLE, SEEN, FREQUENT = 16, 2, 1 << 18
#: Rows that meet in a column are paired one by one up to so many; more are paired in blocks of about as many.
GROUP = 256
#: Up to so many rows of fixed width (a key of a text, a number, a hash) are sent to all executors; more are joined by a shuffle.
SENT = 400_000
#: A row with more partners than this is joined with them in several parts.
HUB = 512
#: Bytes of a hash in the least columns of a row (a bound) and in whole rows (the overlap).
SHORT, WHOLE = 5, 8


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `width`-word n-grams of each text, ascending, and their numbers; a shorter text is one n-gram, one without words has none."""
    words, counts = word_hashes(data, offsets)
    n = len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(n), counts)
    many = np.maximum(counts - width + 1, 0)
    key = np.zeros(len(words), np.uint64)
    for k in range(width):
        key[: len(words) - k] += mix(words[k:] + _U(k + 1)) if k else mix(words + _U(1))
    place = np.arange(len(words)) - starts[doc] if len(words) else np.zeros(0, np.int64)
    take = place < many[doc] if len(words) else np.zeros(0, bool)
    hashes, of = mix(key[take] + _U(width)), doc[take]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        rows = [int(np.sum(mix(words[starts[i] : ends[i]] + np.arange(1, counts[i] + 1).astype(np.uint64)), dtype=np.uint64)) for i in short]
        hashes = np.concatenate([hashes, mix(np.array(rows, np.uint64) + counts[short].astype(np.uint64))])
        of = np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.bincount(of[new], minlength=n)


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of n-grams that many documents hold, the more frequent later; at most FREQUENT."""
    def run(batches):
        for batch in batches:
            for _, data, offsets in blocks(batch):
                hashes, _ = shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["gram"])

    sample = docs.where(remainder("key", SAMPLE) == 0).select(text_bytes().alias("text")).mapInArrow(tidied(run), "gram bigint")
    often = sample.groupBy("gram").count().where(F.col("count") >= SEEN).orderBy(F.desc("count"), "gram").limit(FREQUENT)
    return np.array([r[0] for r in reversed(often.collect())], np.int64).view(np.uint64)


def _rows(docs: DataFrame, width: int, per_cent: int, frequent: np.ndarray) -> DataFrame:
    """key, mark, n (size of the set), node (a hash of the set), lead (the leading columns of the row), low (the least hashes of the set, packed)."""
    order = np.argsort(frequent)
    known, rank = frequent[order], order

    def compute(data, offsets):
        hashes, counts = shingles(data, offsets, width)
        n = len(counts)
        of = np.repeat(np.arange(n), counts)
        late = np.zeros(len(hashes), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            late = np.where(known[at] == hashes, rank[at] + 1, 0)
        lead = np.where(counts > 0, counts - (counts * per_cent + 99) // 100 + 1, 0)
        by = np.lexsort((hashes, late, of))
        first = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(lead, counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lead)]), pa.int32()), pa.array(hashes[by][first].view(np.int64)))
        least = np.where(counts > 0, np.minimum(counts, 16 + counts * (100 - per_cent) // 100), 0)
        some = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(least, counts)
        return [counts.astype(np.int64), _nodes(hashes, counts), lists, _packed(hashes[some], least, SHORT)]

    return annotate(docs, compute, "n bigint, node bigint, lead array<bigint>, low binary", keep=["key", "mark"])


def _nodes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(hashes + _U(0xABCD)), dtype=np.uint64))
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _packed(hashes: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """The first `width` bytes of each hash of each row, as binary; they keep the hashes' order."""
    cut = np.ascontiguousarray((hashes >> _U(64 - 8 * width)).view(np.uint8).reshape(-1, 8)[:, :width]).ravel()
    ends = np.concatenate([[0], np.cumsum(counts) * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(cut)])


def _unique(rows: DataFrame) -> DataFrame:
    """One row for each set: node, n, lead, low, and key and mark of one text that has it. Copies are combined before the shuffle."""
    text = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("one")
    sets = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("low").alias("low"), text)
    return stored(sets.select("node", "n", "lead", "low", F.col("one.key").alias("key"), F.col("one.mark").alias("mark")), "unique")


def _meeting(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(gram, node, n, place) for leading columns that several different rows share; place: how many columns lead it in the row."""
    spark = rows.sparkSession
    cells = rows.select(F.posexplode("lead").alias("place", "gram"), "node", "n").select("gram", "node", F.col("n").cast("int").alias("n"), "place")
    known = np.sort(frequent.view(np.int64))

    def common(want):
        def run(batches):
            for b in batches:
                gram = b.column("gram").to_numpy()
                at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                is_known = known[at] == gram if len(known) else np.zeros(len(gram), bool)
                yield b.filter(pa.array(is_known == want))
        return run

    def runs(batches):
        """Of rows sorted by (gram, node): different ones whose gram another node has too."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            gram, node = t.column("gram").to_numpy(), t.column("node").to_numpy()
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            t, gram = t.filter(pa.array(fresh)), gram[fresh]
            cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0  # the last gram may go on
            yield from _several(t.slice(0, cut), gram[:cut])
            held = t.slice(cut)
        if held is not None:
            yield from _several(held, held.column("gram").to_numpy())

    def _several(t, gram):
        if len(gram) > 1:
            same = gram[1:] == gram[:-1]
            keep = np.zeros(len(gram), bool)
            keep[1:] |= same
            keep[:-1] |= same
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    schema = "gram bigint, node bigint, n int, place int"
    rare = cells.mapInArrow(tidied(common(False)), schema) if len(known) else cells
    rare = rare.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "node").mapInArrow(tidied(runs), schema)
    if len(known):
        # grams that a very large group may share: distinct cells by partial sums, never a whole group in one task
        rare = rare.unionByName(cells.mapInArrow(tidied(common(True)), schema).distinct())
    return stored(rare, "cells")


def _fits(n, m, i, j, per_cent: int):
    """Whether rows of sizes n and m can be similar enough that first meet in a column which i and j columns lead.

    The smaller size must be at least that share of the larger, and what leads the first common column is in one row only, so it counts
    against the number of columns that such rows can differ by. Similar rows pass at their first common column.
    """
    n, m = n.cast("long"), m.cast("long")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * per_cent) & ((i + j) * (100 + per_cent) <= (n + m) * (100 - per_cent))


def _first_pairs(cells: DataFrame, per_cent: int) -> DataFrame:
    """Each row with one of those that it meets in a column: another one for each column, by hash."""
    heads = cells.groupBy("gram").agg(F.min(F.struct("place", F.xxhash64("gram", "node").alias("by"), "node", "n")).alias("head"))
    pairs = cells.join(heads, "gram").where((F.col("node") != F.col("head.node")) & _fits(F.col("n"), F.col("head.n"), F.col("place"), F.col("head.place"), per_cent))
    return pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def _apart(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells, with components, of columns whose rows aren't all linked yet, and how many rows meet there."""
    known = stored(cells.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    mixed = known.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("met")).where("low <> high").select("gram", "met")
    apart = stored(known.join(mixed, "gram"), "apart")
    release(known)
    return apart


def _other_pairs(apart: DataFrame, per_cent: int) -> DataFrame:
    """All pairs that meet in a column of few rows, whose sizes fit, and whose ends aren't linked yet."""
    left = apart.where(F.col("met") <= GROUP)
    right = left.select("gram", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("j"), F.col("component").alias("other"))
    met = left.join(right, "gram").where((F.col("node") < F.col("b")) & (F.col("component") != F.col("other")) & _fits(F.col("n"), F.col("m"), F.col("place"), F.col("j"), per_cent))
    return met.select(F.col("node").alias("a"), "b").distinct()


def _block_links(apart: DataFrame, docs: DataFrame, rows: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Links between rows that meet in a column of many rows: each block of them against each, by a product of their incidence matrices.

    No pair leaves a task but the links that connect what a pair of blocks connects, fewer than it has rows.
    """
    many = apart.where(F.col("met") > GROUP)
    sets = _sets(many.select("node").distinct(), docs, rows, width)
    count = F.ceil(F.col("met") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    spread = many.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), count - 1)))
    spread = spread.select("gram", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "node", "n", "place", "component").join(sets, "node")
    names = ["gram", "x", "y", "own", "node", "n", "place", "component", "grams"]

    def product(t: pa.Table):
        get = lambda c: t.column(c).to_numpy()
        node, n, place, component, own = (get(c) for c in ("node", "n", "place", "component", "own"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        both = n[:, None] + n
        fit = (np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * per_cent) & ((place[:, None] + place) * (100 + per_cent) <= both * (100 - per_cent))
        fit &= component[:, None] != component
        if get("x")[0] != get("y")[0]:
            fit &= own[:, None] != own
        use = np.flatnonzero(fit.any(1))
        if not len(use):
            return
        batch = t.take(pa.array(use)).combine_chunks().to_batches()[0]
        value, of, _ = _cells([(d, o) for _, d, o in blocks(batch, "grams", 1 << 30)], WHOLE)
        _, column, often = np.unique(value, return_inverse=True, return_counts=True)
        keep = often[column] > 1
        _, column = np.unique(column[keep], return_inverse=True)
        of, overlap = of[keep], np.zeros((len(use), len(use)), np.float32)
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            i, j = np.searchsorted(column, (a, a + 2048))
            ones = np.zeros((len(use), 2048), np.float32)
            ones[of[i:j], column[i:j] - a] = 1
            overlap += ones @ ones.T
        near = fit[np.ix_(use, use)] & (100 * overlap >= per_cent * (both[np.ix_(use, use)] - overlap))
        a, b = _forest(near)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[use[a]]), pa.array(node[use[b]])], names=["a", "b"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = np.stack([held.column(c).to_numpy() for c in ("gram", "x", "y")])
            heads = np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1)
            for i, j in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                yield from product(held.slice(i, j - i))
            held = held.slice(int(heads[-1])).combine_chunks()
        if held is not None:
            yield from product(held)

    ordered = spread.select(names).repartition(partitions(apart.sparkSession), "gram", "x", "y").sortWithinPartitions("gram", "x", "y")
    links = stored(ordered.mapInArrow(tidied(run), "a bigint, b bigint").distinct(), "links")
    release(sets)
    return links


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links that connect what the symmetric matrix connects, one for each row reached."""
    seen, a, b = np.zeros(len(near), bool), [], []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            new = np.flatnonzero(near[front].any(0) & ~seen)
            a.append(front[near[np.ix_(front, new)].argmax(0)])
            b.append(new)
            seen[new] = True
            front = new
    return np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)


def _both(pairs: DataFrame, sides: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with x and y: the values of the nodes a and b, and the sizes n and m if there are any."""
    more = ["n"] if "n" in sides.columns else []
    left = sides.select(F.col("node").alias("a"), F.col(value).alias("x"), *more)
    right = sides.select(F.col("node").alias("b"), F.col(value).alias("y"), *[F.col(c).alias("m") for c in more])
    return _salted(_salted(pairs, left, "a", "b", pairs), right, "b", "a", pairs)


def _salted(joined: DataFrame, side: DataFrame, own: str, other: str, pairs: DataFrame) -> DataFrame:
    """joined (rows of pairs, and more) joined with side on `own`; a row of side with very many partners goes to several tasks, each with a part of these."""
    hubs = pairs.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts")).where("parts > 1")
    n = hubs.count()
    if not n:
        return joined.join(side, own)
    hubs = F.broadcast(hubs) if n <= SENT else hubs  # a long and an int
    parts = F.coalesce("parts", F.lit(1))
    dealt = joined.join(hubs, own, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    copies = side.join(hubs, own, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copies, [own, "part"]).drop("part")


def _shared(left, right, m):
    value, pair = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
    order = np.lexsort((value, pair))
    value, pair = value[order], pair[order]
    return np.bincount(pair[1:][(value[1:] == value[:-1]) & (pair[1:] == pair[:-1])], minlength=m)


def _possible(pairs: DataFrame, rows: DataFrame, per_cent: int) -> DataFrame:
    """The pairs that may be similar enough by their least cells: up to the lower of both last ones, each row's cells are all known, and those
    that only one of them has count against the number that two similar rows of these sizes can differ by."""
    sides = rows.select("node", "low", "n").join(_ends(pairs), "node", "left_semi")
    joined = _both(pairs, sides, "low")

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            left, right = (_cells([(d, o) for _, d, o in blocks(batch, c, 1 << 21)], SHORT) for c in ("x", "y"))
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            limit = np.full(k, np.iinfo(np.uint64).max, np.uint64)
            for (value, pair, size), whole in ((left, n), (right, m)):
                last = value[np.cumsum(size) - 1]
                limit = np.where(size < whole, np.minimum(limit, last), limit)
            left, right = ((value[keep], pair[keep]) for value, pair, _ in (left, right) for keep in (value <= limit[pair],))
            shared = _shared(left, right, k)
            apart = np.bincount(left[1], minlength=k) + np.bincount(right[1], minlength=k) - 2 * shared
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(apart * (100 + per_cent) <= (n + m) * (100 - per_cent)))

    return joined.select("a", "b", "x", "y", "n", "m").mapInArrow(tidied(run), "a bigint, b bigint")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _sent(few: DataFrame) -> DataFrame:
    """few, marked to be broadcast if it has at most SENT rows, all of fixed width."""
    def fixed(kind):
        return all(fixed(f.dataType) for f in kind) if isinstance(kind, T.StructType) else kind in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType(), T.BooleanType())

    return few if not fixed(few.schema) or few.count() > SENT else F.broadcast(few)


def _sets(nodes: DataFrame, docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, grams): the whole sets of the nodes, packed, made anew from one text of each, which its key, null or not, and its hash tell."""
    one = stored(rows.select("node", "key", "mark").join(nodes, "node", "left_semi"), "needed")
    names = one.select(F.col("key").alias("its"), F.col("mark").alias("that")).distinct()
    texts = docs.join(_sent(names), (F.col("mark") == F.col("that")) & F.col("key").eqNullSafe(F.col("its")), "left_semi")

    def compute(data, offsets):
        hashes, counts = shingles(data, offsets, width)
        return [_nodes(hashes, counts), _packed(hashes, counts, WHOLE)]

    sets = annotate(texts, compute, "node bigint, grams binary", keep=[])
    sets = sets.groupBy("node").agg(F.first("grams").alias("grams"))  # a row may be repeated
    sets = stored(sets, "sets")
    release(one)
    return sets


def _links(pairs: DataFrame, docs: DataFrame, rows: DataFrame, width: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: overlaps added up over the least columns and then, where the bound allows, over whole rows."""
    met = stored(pairs, "pairs")
    pairs = stored(_possible(met, rows, per_cent), "possible")
    release(met)
    sets = _sets(_ends(pairs), docs, rows, width)
    joined = _both(pairs, sets, "grams").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            left, right = (_cells([(d, o) for _, d, o in blocks(batch, c, 1 << 21)], WHOLE) for c in ("x", "y"))
            overlap = _shared(left, right, m)
            union = left[2] + right[2] - overlap
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(100 * overlap >= per_cent * union))

    links = stored(joined.mapInArrow(tidied(run), "a bigint, b bigint"), "links")
    release(pairs, sets)
    return links


def _cells(parts: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, number of the row of each, size of each row) of packed sets."""
    sizes = np.concatenate([np.diff(o) // width for _, o in parts])
    raw = np.concatenate([d for d, _ in parts]).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view(np.uint64).ravel(), np.repeat(np.arange(len(sizes)), sizes), sizes


def join_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, per_cent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of each row: the size of its n-gram set and the least key that links reach.

    Two rows link when 100 * overlap >= per_cent * union of their sets of `width`-word n-grams (words: [^\\x20\\x09-\\x0D]+, A-Z lowered; a row
    of fewer words is one n-gram). Rows without words and null texts have empty sets and link with nothing, so each is its own component.
    Equal sets are linked. Sets, and n-grams in a pair's overlap, are compared by 64-bit hashes. Repeated rows are copies. Rows without a key
    link like others; a component of such rows alone has a null id. An empty table gives no rows; other columns don't matter.
    """
    rows, of_node = _grouped(docs.select(quoted(key).alias("key"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("mark")), F.min("key"), width, per_cent)
    out = rows.select("key", "n", "node").join(of_node.withColumnRenamed("first", "component_id"), "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def _grouped(docs: DataFrame, least, width: int = 5, per_cent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets' nodes, and (node, first): the least of the aggregate `least` over the rows of each node's component."""
    frequent = _frequent(docs, width)
    rows = stored(_rows(docs, width, per_cent, frequent), "rows")
    unique = _unique(rows)
    cells = _meeting(unique, frequent)
    links = _links(_first_pairs(cells, per_cent), docs, unique, width, per_cent)
    groups = components(links)
    apart = _apart(cells, groups)
    release(cells)
    more = _links(_other_pairs(apart, per_cent), docs, unique, width, per_cent)
    if not apart.where(F.col("met") > GROUP).isEmpty():
        more = more.unionByName(_block_links(apart, docs, unique, width, per_cent))
    groups = components(links.unionByName(more)) if not more.isEmpty() else groups
    release(apart, links, unique)
    own = rows.where("n > 0").groupBy("node").agg(least.alias("least"))
    named = own.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = stored(named.groupBy("component").agg(F.min("least").alias("first")), "first")
    return rows, named.select("node", "component").join(_sent(first), "component").select("node", "first")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: that of the least key, of the least hash of the text where a key repeats; a null key comes last.

    Components are as in join_similar. Each row is judged by its own text, not by its key alone. Of rows that repeat key and text the first in
    JSON stays. Rows without words, null and empty texts among them, are their own components and stay. Texts of any length are compared whole.
    An empty table gives no rows. All columns stay as they are, whatever their names and types.
    """
    names = docs.columns
    docs, (key, text) = plain(docs, key, text)
    hashed = F.xxhash64(text)
    same = F.col(key).eqNullSafe(F.col("_first_key")) & (hashed == F.col("_first_mark"))
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), hashed.alias("mark"))
    rows, of_node = _grouped(slim, F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")), **options)
    judged = rows.where("n > 0").select("key", "mark", "node").join(of_node, "node")
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("mark") == F.col("first.mark"))
    marks = judged.groupBy(F.col("key").alias("_first_key"), F.col("mark").alias("_first_mark")).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = stored(marks.where("not stays or n > 1"), "marks")
    gone, again = (marks.where(c).select("_first_key", "_first_mark") for c in ("not stays", "stays"))
    kept = docs.join(_sent(gone), same, "left_anti")
    if again.isEmpty():
        return kept.toDF(*names)
    again, row = _sent(again), F.struct(*docs.columns)
    one = kept.join(again, same, "left_semi").groupBy(F.col(key).alias("_first_key"), hashed.alias("_first_mark")).agg(F.min_by(row, F.to_json(row)).alias("_one"))
    return kept.join(again, same, "left_anti").unionByName(one.select("_one.*")).toDF(*names)
