"""Removal of byte strings that repeat anywhere in a corpus, by suffix sorting around anchors.

Any string of LENGTH bytes holds a gram of GRAM bytes whose hash is least among those of its grams; equal strings choose the same one. So
only suffixes that begin at such anchors can begin alike, and the strings around an anchor repeat only among anchors of its gram. Anchors
whose whole surroundings (all strings that hold the gram) are alike are done by counting. The rest are sorted within their gram: a suffix
from the anchor on, by deep-shallow sorting: multikey partitioning by eight bytes at a time to a shallow depth, for all grams of a batch
at once, and blind tries for suffixes that are still alike there. Neighbours' common prefixes then give, together with what
precedes the anchors, how far each string repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import annotate, blocks, mix, partitions, quoted, release, rolling, stored, substring_hash, text_bytes, tidied

#: Shortest repeated string that goes, and bytes of a gram.
LENGTH, GRAM = 200, 60
#: Bytes beside a gram that a string of LENGTH bytes may hold.
REACH = LENGTH - GRAM
#: Words of eight bytes that the shallow phase looks at.
SHALLOW = 12
#: Surroundings of one gram are sorted in one task up to so many (340 bytes each); beyond that, strings are counted one by one over all tasks.
LARGE = 20_000
_BLOCK = 1_000_000
_U = np.uint64


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i+width] for each i at which that many are left."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = -(-len(x) // width) * width
    padded = np.concatenate([x, np.full(full - len(x), x[-1], x.dtype)]).reshape(-1, width)
    forward = op.accumulate(padded, axis=1).ravel()
    backward = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, documents, gram hashes, prefix sums of the block) of all anchors, ascending."""
    sums = rolling(data)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), sums
    at = np.arange(n - GRAM + 1)
    gram = substring_hash(sums, at, at + GRAM) | _U(1)  # never 0
    least = _sliding(gram, REACH + 1, np.minimum)  # for each string of LENGTH bytes
    starts = np.arange(len(least))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    least[starts + LENGTH > offsets[1:][doc]] = 0  # it would run into the next document
    edge = np.zeros(REACH, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)  # over the strings that hold the gram
    places = np.flatnonzero(chosen == gram)
    return places, np.searchsorted(offsets, places, "right") - 1, gram[places], sums


def _surroundings(places, doc, offsets, sums) -> np.ndarray:
    """A hash of all strings that hold the gram, and of where it stands among them."""
    a = np.maximum(offsets[:-1][doc], places - REACH)
    b = np.minimum(offsets[1:][doc], places + LENGTH)
    return mix(substring_hash(sums, a, b) + (places - a).astype(np.uint64))


def units(offsets: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A hash of each whole text."""
    return substring_hash(sums, offsets[:-1], offsets[1:]).view(np.int64)


def _anchor_rows(texts: DataFrame, whole: bool) -> DataFrame:
    """(gram, around) of all anchors, and their (unit, place) if whole."""
    def run(batches):
        for batch in batches:
            for _, data, offsets in blocks(batch, "text", _BLOCK):
                places, doc, gram, sums = anchors(data, offsets)
                arrays = [gram.view(np.int64), _surroundings(places, doc, offsets, sums).view(np.int64)]
                if whole:
                    arrays += [units(offsets, sums)[doc], (places - offsets[:-1][doc]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["gram", "around", "unit", "place"][: len(arrays)])

    return texts.select("text").mapInArrow(tidied(run), "gram bigint, around bigint" + ", unit bigint, place int" * whole)


# --- sorting


def _blind_trie(rows: list[bytes]) -> list[list[int]]:
    """Numbers of the strings in order, equal ones together: a trie that keeps only where strings part, and no text."""
    root: list | None = None  # a leaf: [-1, numbers]; a node: [depth, children by byte, or -1 where a string ends]

    def byte(s, d):
        return s[d] if d < len(s) else -1

    for i, s in enumerate(rows):
        if root is None:
            root = [-1, [i]]
            continue
        node = root
        while node[0] >= 0:  # blindly: by the bytes at which others part
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = rows[node[1][0]]
        if s == other:
            node[1].append(i)
            continue
        lo, hi = 0, min(len(s), len(other))
        while lo < hi:  # length of the common prefix
            mid = (lo + hi + 1) // 2
            if s[lo:mid] == other[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        node, above, edge = root, None, None
        while node[0] >= 0 and node[0] < lo:
            above, edge = node, byte(s, node[0])
            node = node[1][edge]
        if node[0] == lo:
            node[1][byte(s, lo)] = [-1, [i]]
        else:
            parted = [lo, {byte(other, lo): node, byte(s, lo): [-1, [i]]}]
            if above is None:
                root = parted
            else:
                above[1][edge] = parted
    out: list[list[int]] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out.append(node[1])
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow(groups: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The order of rows by group (ascending) and text (rows of bytes, zeros after each one's length)."""
    n, width = text.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = text
    words = words.view(">u8")
    order = np.argsort(groups, kind="stable")
    part = np.cumsum(np.concatenate([[0], np.diff(groups[order]) != 0])) if n else order  # parts that hold one kind so far
    for depth in range(min(SHALLOW, words.shape[1])):
        size = np.bincount(part)
        open_ = np.flatnonzero(size[part] > 1)
        if not len(open_):
            return order
        key = words[order[open_], depth].astype(np.uint64)
        by = np.lexsort((key, part[open_]))
        order[open_] = order[open_][by]
        key, was = key[by], part[open_]
        new = np.zeros(n, bool)
        new[1:] = part[1:] != part[:-1]
        new[open_[1:]] |= (key[1:] != key[:-1]) | (was[1:] != was[:-1])
        part = np.cumsum(new)
    ends = np.flatnonzero(np.append(np.diff(part), 1)) + 1
    begin = 0
    skip = SHALLOW * 8
    for end in ends.tolist():
        if end - begin > 1:
            own = order[begin:end]
            tails = [text[i, min(skip, lengths[i]) : lengths[i]].tobytes() if lengths[i] >= skip else b"" for i in own]
            # zeros after the end look like text in words, so what ends early is told apart by its length first
            ranked = [j for same in _blind_trie(tails) for j in sorted(same, key=lambda j: (lengths[own[j]], own[j]))]
            order[begin:end] = own[ranked]
        begin = end
    return order


def common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows."""
    apart = a != b
    first = np.where(apart.any(1), apart.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(la, lb))


def _intervals(shared: list[int]) -> list[tuple[int, int, int]]:
    """(common length, first, last) of the inner nodes of the tree of sorted strings; shared[i]: what i - 1 and i have in common."""
    found, stack = [], []
    n = len(shared)
    for i in range(1, n + 1):
        now = shared[i] if i < n else -1
        start = i - 1
        while stack and stack[-1][0] > now:
            value, start = stack.pop()
            found.append((value, start, i - 1))
        if i < n and (not stack or stack[-1][0] < now):
            stack.append((now, start))
    return found


def extents(groups: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, how many bytes before and after its gram repeat with another anchor of its group, in strings of LENGTH bytes or more; -1 if none.

    left: what precedes the gram, backwards; right: the gram and what follows.
    """
    n = len(groups)
    before, after = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return before, after
    order = deep_shallow(groups, right, n_right)
    a, b = order[:-1], order[1:]
    same = groups[a] == groups[b]
    shared = np.where(same, common(right[a], right[b], n_right[a], n_right[b]) - GRAM, -1)
    heads = np.append(np.flatnonzero(np.append(True, ~same)), n)
    sizes = np.diff(heads)
    # groups of two: a pair each
    twos = heads[:-1][sizes == 2]
    if len(twos):
        i, j = order[twos], order[twos + 1]
        l, r = common(left[i], left[j], n_left[i], n_left[j]), shared[twos]
        ok = l + r >= REACH
        for k in (i[ok], j[ok]):
            before[k], after[k] = l[ok], r[ok]
    for g in np.flatnonzero(sizes > 2).tolist():
        own = order[heads[g] : heads[g + 1]]
        m = len(own)
        rank = np.empty(m, np.int64)
        rank[deep_shallow(np.zeros(m, np.int64), left[own], n_left[own])] = np.arange(m)
        longest = int(n_left[own].max())
        for r, lo, hi in _intervals([-1, *shared[heads[g] : heads[g + 1] - 1].tolist()]):
            if r + longest < REACH:
                continue
            members = own[lo : hi + 1][np.argsort(rank[lo : hi + 1])]
            x, y = members[:-1], members[1:]
            both = common(left[x], left[y], n_left[x], n_left[y])
            best = np.maximum(np.append(both, -1), np.append(-1, both))  # with a neighbour, in order of what precedes
            ok = best + r >= REACH
            k = members[ok]
            before[k], after[k] = np.maximum(before[k], best[ok]), np.maximum(after[k], r)
    return before, after


# --- the corpus


def _pieces(batch_rows, data, offsets, wanted, large: bool):
    """For the wanted (document, place, gram, around, alone): rows of the surroundings, or of hashes of the strings in them."""
    doc, place, gram, around, alone = wanted
    at = offsets[:-1][doc] + place
    if not large:
        room_left = np.minimum(place, REACH)
        room_right = np.minimum(offsets[1:][doc] - at, LENGTH)
        raw = data.tobytes()
        before = [raw[p - k : p][::-1] for p, k in zip(at.tolist(), room_left.tolist(), strict=True)]
        after = [raw[p : p + k] for p, k in zip(at.tolist(), room_right.tolist(), strict=True)]
        return [pa.array(gram), pa.array(around), pa.array(alone), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
    sums = rolling(data)
    step = np.arange(REACH + 1)
    start = at[:, None] - step
    fine = (start >= offsets[:-1][doc][:, None]) & (start + LENGTH <= offsets[1:][doc][:, None])
    row, k = np.nonzero(fine)
    key = mix(substring_hash(sums, start[fine], start[fine] + LENGTH) ^ mix(gram[row].view(np.uint64) + k.astype(np.uint64)))
    return [pa.array(key.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(row)]


def _cut_out(texts: DataFrame, wanted: DataFrame, large: bool) -> DataFrame:
    """Surroundings of the wanted anchors (unit, key, gram, around, place, alone), from one text of each unit."""
    lists = wanted.groupBy("unit", "key").agg(F.collect_list(F.struct("gram", "around", "place", "alone")).alias("wanted"))
    with_unit = annotate(texts, lambda data, offsets: [units(offsets, rolling(data))], "unit bigint", most=_BLOCK)
    joined = with_unit.join(lists, (with_unit["unit"] == lists["unit"]) & with_unit["key"].eqNullSafe(lists["key"])).select(with_unit["unit"], with_unit["text"], "wanted")
    names = ["gram", "around", "alone", "before", "after"] if not large else ["string", "before", "row"]
    schema = "unit bigint, place int, gram bigint, around bigint, alone boolean, before binary, after binary" if not large else "unit bigint, place int, string bigint, before int"

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", _BLOCK):
                part = batch.slice(rows.start, rows.stop - rows.start)
                lists = part.column("wanted")
                inner = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                field = lambda k: inner.field(k).to_numpy(zero_copy_only=False)
                place, unit = field(2).astype(np.int64), part.column("unit").to_numpy()[doc]
                for a in range(0, len(doc), 2000):
                    c = slice(a, a + 2000)
                    made = _pieces(part, data, offsets, (doc[c], place[c], field(0)[c], field(1)[c], field(3)[c]), large)
                    if large:
                        own = made.pop().to_numpy()
                        yield pa.RecordBatch.from_arrays([pa.array(unit[c][own]), pa.array(place[c][own].astype(np.int32)), *made], names=["unit", "place", *names[:2]])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(unit[c]), pa.array(place[c].astype(np.int32)), *made], names=["unit", "place", *names])

    return joined.withColumn("text", text_bytes("text")).mapInArrow(tidied(run), schema)


def _sorted_extents(around: DataFrame) -> DataFrame:
    """(unit, a, b): what repeats around the anchors that stand alone with their surroundings."""
    spark = around.sparkSession

    def matrix(column, width):
        x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(x, pa.ChunkedArray):
            x = pa.concat_arrays(x.chunks)
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
        sizes = np.diff(ends)
        out = np.zeros((len(x), width), np.uint8)
        out[np.arange(width) < sizes[:, None]] = np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(x) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        return out, sizes

    def solve(t: pa.Table):
        gram, like = t.column("gram").to_numpy(), t.column("around").to_numpy()
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (like[1:] != like[:-1])  # a row of a table may stand twice
        t, gram = t.filter(pa.array(fresh)), gram[fresh]
        before, after = extents(gram, *matrix(t.column("before"), REACH), *matrix(t.column("after"), LENGTH))
        ok = (before >= 0) & t.column("alone").to_numpy(zero_copy_only=False)
        place = t.column("place").to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(t.column("unit").to_numpy()[ok]), pa.array(place[ok] - before[ok]), pa.array(place[ok] + GRAM + after[ok])], names=["unit", "a", "b"])

    def run(batches):
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            gram = held.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
            if cut >= 4000:
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from solve(held)

    return around.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "around").mapInArrow(tidied(run), "unit bigint, a bigint, b bigint")


def _counted_extents(strings: DataFrame) -> DataFrame:
    """The same for grams of many different surroundings: (unit, place, string, before) of every string counted over all tasks.

    A string repeats if it has two places, told apart by 64-bit hashes; rows of a table may stand twice, which gives a place twice. Partial
    extremes meet, not all rows of a string.
    """
    at = F.xxhash64("unit", "place")
    again = strings.groupBy("string").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("string")
    found = strings.join(again, "string").groupBy("unit", "place").agg(F.max("before").alias("most"), F.min("before").alias("least"))
    return found.select("unit", (F.col("place") - F.col("most")).cast("long").alias("a"), (F.col("place") - F.col("least") + LENGTH).cast("long").alias("b"))


def repeated(docs: DataFrame, key: str, text: str, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(docs as key and text, (unit, spans) of every text that holds a repeated string)."""
    texts = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    raw = texts.select(text_bytes("text").alias("text"))
    grams = _anchor_rows(raw, False).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    shared = stored(grams.where("n > 1").select("gram", (F.col("low") == F.col("high")).alias("alike")), "grams")
    met = stored(_anchor_rows(raw, True).join(shared, "gram"), "anchors")
    release(shared)
    unlike = met.where("not alike")
    kinds = stored(unlike.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("unit", "place")).alias("one")), "kinds")
    sizes = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    every = met.where("alike").select("unit", "place").unionByName(unlike.join(kinds.where("n > 1").select("gram", "around"), ["gram", "around"]).select("unit", "place"))
    covered = every.distinct().select("unit", (F.col("place") - REACH).cast("long").alias("a"), (F.col("place") + LENGTH).cast("long").alias("b"))
    # one text for each unit that gives surroundings
    ones = kinds.join(sizes, "gram").select("gram", "around", F.col("one.unit").alias("unit"), F.col("one.place").alias("place"), (F.col("n") == 1).alias("alone"), "m")
    first = annotate(texts, lambda data, offsets: [units(offsets, rolling(data))], "unit bigint", keep=["key"], most=_BLOCK).groupBy("unit").agg(F.min("key").alias("key"))
    ones = stored(ones.join(first, "unit"), "ones")
    spans, few, many = covered, ones.where(F.col("m") < large), ones.where(F.col("m") >= large)
    if not few.isEmpty():  # texts are moved only for what there is
        spans = spans.unionByName(_sorted_extents(_cut_out(texts, few, False)))
    if not many.isEmpty():
        spans = spans.unionByName(_counted_extents(_cut_out(texts, many, True)))
    packed = spans.distinct().groupBy("unit").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    packed = stored(packed, "spans")
    release(met, kinds, ones)
    return texts, packed


def _runs(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [a, b) within [0, n)."""
    order = np.argsort(a, kind="stable")
    a, b = np.maximum(a[order], 0), np.minimum(b[order], n)
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return a[heads], reach[np.append(heads[1:] - 1, len(a) - 1)]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", large: int = LARGE) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, kept_sha256) of each row: its text without every byte that a string of LENGTH bytes covers
    which also begins elsewhere in the table, in this text or another.

    Strings are judged on the input; overlaps count. kept holds the remaining bytes. Null texts count as empty; texts shorter than LENGTH
    stay whole. Repeated rows are copies of each other, so of LENGTH bytes or more nothing stays. Null keys are keys like others. An
    empty table gives no rows; other columns don't matter. Strings are compared as bytes where sorted and by 64-bit hashes where counted.
    """
    from pyspark.sql.types import StructType

    texts, spans = repeated(docs, key, text, large)
    with_unit = annotate(texts, lambda data, offsets: [units(offsets, rolling(data))], "unit bigint", most=_BLOCK)
    joined = with_unit.join(spans, "unit", "left").select("key", text_bytes("text").alias("text"), "spans")
    schema = StructType([joined.schema["key"]] + list(StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                part = batch.slice(rows.start, rows.stop - rows.start)
                lists = part.column("spans")
                inner = lists.flatten()
                a, b = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                sizes = np.diff(offsets)
                counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64) if len(lists) else np.zeros(0, np.int64)
                ends = np.cumsum(counts)
                raw = data.tobytes()
                removed, spans, kept = [], [], []
                for i, n in enumerate(sizes.tolist()):
                    at = int(offsets[i])
                    if not counts[i]:
                        removed.append(0)
                        spans.append(0)
                        kept.append(raw[at : at + n])
                        continue
                    s, e = _runs(n, a[ends[i] - counts[i] : ends[i]], b[ends[i] - counts[i] : ends[i]])
                    removed.append(int((e - s).sum()))
                    spans.append(len(s))
                    kept.append(b"".join(raw[at + x : at + y] for x, y in zip([0, *e.tolist()], [*s.tolist(), n], strict=True)))
                digest = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names=schema.names)

    return joined.mapInArrow(tidied(run), schema).withColumnRenamed("key", key)
