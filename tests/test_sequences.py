"""Ordered operators: small cases, edges, and random sequences against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rillframe.operators import combine as B
from rillframe.operators import slicing as S
from rillframe.operators import transforms as T
from rillframe.operators import windows as W
from rillframe.ordered import Ordered
from rillframe.sources import memory as M


def seq(spark, xs, kind="bigint"):
    return M.from_rows(spark, xs, kind)


def values(s, column="value"):
    return [r[column] for r in s.df.orderBy(*s.order).collect()]


def tuples(s, *columns):
    return [tuple(r[c] for c in columns) for r in s.df.orderBy(*s.order).collect()]


def test_running_and_differences(spark):
    s = seq(spark, [1, 2, 3, 4, 5])
    assert values(W.running_sum(s), "running") == [1, 3, 6, 10, 15]
    assert values(W.running_product(s), "running") == [1, 2, 6, 24, 120]
    assert values(W.differences(seq(spark, [1, 3, 6, 10, 15]))) == [2, 3, 4, 5]
    assert values(W.scan(s, F.lit(0).cast("bigint"), lambda a, x: a + x)) == [1, 3, 6, 10, 15]
    assert values(W.running_min(seq(spark, [3, 1, 2])), "running") == [3, 1, 1]
    assert values(W.running_count(s), "running") == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("xs,size,step,partial,expected", [
    ([1, 2, 3, 4, 5], 3, 2, True, [[1, 2, 3], [3, 4, 5], [5]]),
    (list(range(1, 11)), 2, 4, False, [[1, 2], [5, 6], [9, 10]]),
    (list(range(1, 8)), 2, 3, True, [[1, 2], [4, 5], [7]]),
    ([1, 2], 3, 1, True, [[1, 2]]),
    ([1, 2], 3, 1, False, []),
    ([], 3, 1, True, []),
    ([1, 2, 3], 0, 1, False, []),
])
def test_window_with_step(spark, xs, size, step, partial, expected):
    assert values(W.window_with_step(seq(spark, xs), size, step, partial)) == expected


def python_windows(xs, size, step, partial):
    full = [xs[i : i + size] for i in range(0, len(xs), step) if i + size <= len(xs)]
    rest = xs[len(full) * step :]
    return full + ([rest[:size]] if partial and rest else [])


def test_windows_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(Ordered.chunked, "__defaults__", (0, 0, 7))
    rng = random.Random(5)
    for n in (0, 1, 6, 7, 8, 40):
        xs = [rng.randrange(100) for _ in range(n)]
        s = seq(spark, xs)
        size, step = rng.randrange(1, 12), rng.randrange(1, 9)
        assert values(W.window_with_step(s, size, step, True)) == python_windows(xs, size, step, True)
        assert tuples(W.pairwise(s), "first", "second") == list(itertools.pairwise(xs))
        assert tuples(W.triples(s), "first", "second", "third") == list(zip(xs, xs[1:], xs[2:], strict=False))
        assert values(W.running_sum(s), "running") == list(itertools.accumulate(xs))
        assert values(W.running_max(s), "running") == list(itertools.accumulate(xs, max))
        assert values(S.distinct_until_changed(seq(spark, [x % 3 for x in xs]))) == [k for k, _ in itertools.groupby(x % 3 for x in xs)]


def test_nulls_in_windows(spark):
    s = seq(spark, [1, None, None, 2])
    assert values(W.window(s, 2)) == [[1, None], [None, None], [None, 2]]
    assert values(W.chunk(s, 3)) == [[1, None, None], [2]]
    assert values(S.distinct_until_changed(s)) == [1, None, 2]


@pytest.mark.parametrize("n", [-1, 0, 1, 3, 5, 9])
def test_slices(spark, n):
    xs = [5, 4, 3, 2, 1]
    s = seq(spark, xs)
    k = max(n, 0)
    assert values(S.limit(s, n)) == xs[:k]
    assert values(S.skip(s, n)) == xs[k:]
    assert values(S.take_last(s, n)) == (xs[-k:] if k else [])
    assert values(S.drop_last(s, n)) == (xs[:-k] if k else xs)
    assert values(S.step(s, n)) == (xs[::n] if n > 1 else xs)
    assert [r.value for r in S.at(s, n).collect()] == (xs[n : n + 1] if n >= 0 else [])


def test_while(spark):
    s = seq(spark, [1, 2, 5, 1, 7])
    assert values(S.take_while(s, F.col("value") < 5)) == [1, 2]
    assert values(S.drop_while(s, F.col("value") < 5)) == [5, 1, 7]
    assert values(S.take_while(s, F.lit(True))) == [1, 2, 5, 1, 7]
    assert values(S.drop_while(s, F.lit(True))) == []
    assert values(S.take_while(seq(spark, [1, None, 2]), F.col("value") < 5)) == [1]


def test_distinct(spark):
    assert values(S.distinct(seq(spark, [3, 1, 3, 2, 1]))) == [3, 1, 2]
    nan = float("nan")
    assert len(values(S.distinct(seq(spark, [nan, 1.0, nan, 1.0], "double")))) == 3
    assert values(S.distinct_until_changed(seq(spark, [1, 1, 2, 2, 2, 3, 1, 1]))) == [1, 2, 3, 1]
    # against the last kept, not the one before
    assert values(S.distinct_until_changed_by(seq(spark, [1, 2, 3, 4, 5, 9]), lambda a, b: F.abs(a - b) <= 2)) == [1, 4, 9]
    pairs = M.pairs_of(spark, [("a", 1), ("b", 2), ("a", 3), ("c", 1)])
    assert tuples(S.distinct_keys(pairs), "key", "value") == [("a", 1), ("b", 2), ("c", 1)]
    assert tuples(S.distinct_values(pairs), "key", "value") == [("a", 1), ("b", 2), ("a", 3)]


def test_sorts(spark):
    items = M.from_rows(spark, [(1, 1), (2, 2), (1, 3), (2, 4), (1, 5)], "key bigint, pos bigint")
    assert tuples(S.sorted_stable_by(items, "key"), "pos") == [(1,), (3,), (5,), (2,), (4,)]
    nan = float("nan")
    got = values(S.sorted_by(seq(spark, [2.0, nan, 1.0], "double"), "value"))
    assert got[0] != got[0] and got[1:] == [1.0, 2.0]
    assert values(S.reverse(seq(spark, [1, 2, 3]))) == [3, 2, 1]
    assert values(S.sorted_with(seq(spark, [1, 3, 2]), lambda a, b: (b["value"] - a["value"]).cast("int"))) == [3, 2, 1]


def test_top_and_bottom(spark):
    s = seq(spark, [3, 1, 4, 1, 5, 9, 2, 6])
    assert values(S.top_k(s, 3)) == [9, 6, 5]
    assert values(S.bottom_k(s, 3)) == [1, 1, 2]
    assert values(S.top_k(seq(spark, [3, 3, 1, 1, 2, 2]), 4)) == [3, 3, 2, 2]
    assert values(S.top_k(s, 0)) == [] and values(S.bottom_k(s, -1)) == []


def test_single_rows(spark):
    s = seq(spark, [4, 8, 6])
    assert S.first(s).first().value == 4 and S.last(s).first().value == 6
    assert S.find_last(s, F.col("value") > 5).first().value == 6 and S.find_first(s, F.col("value") > 5).first().value == 8
    assert S.single(s).first() is None and S.single(seq(spark, [7])).first().value == 7
    assert S.first(seq(spark, [])).first() is None


def test_zips(spark):
    a, b, c = seq(spark, [1, 2, 3]), seq(spark, [10, 20]), seq(spark, [7, 8, 9, 10])
    assert tuples(B.zip_(a, b), "first", "second") == [(1, 10), (2, 20)]
    assert tuples(B.zip3(a, b, c), "first", "second", "third") == [(1, 10, 7), (2, 20, 8)]
    assert tuples(B.zip_longest(a, b), "first", "second", "has_second") == [(1, 10, True), (2, 20, True), (3, None, False)]
    assert tuples(B.zip_longest_with(a, b, 0, -1), "first", "second") == [(1, 10), (2, 20), (3, -1)]
    assert values(B.interleave(a, c)) == [1, 7, 2, 8, 3, 9, 10]
    assert values(B.concat(a, b, a)) == [1, 2, 3, 10, 20, 1, 2, 3]
    assert values(B.merge_sorted(seq(spark, [1, 3, 5]), seq(spark, [2, 3, 4]), "value")) == [1, 2, 3, 3, 4, 5]
    x, y = B.unzip(B.zip_(a, b))
    assert values(x) == [1, 2] and values(y) == [10, 20]


def test_products(spark):
    a, b = seq(spark, [1, 2]), seq(spark, [3, 4])
    assert tuples(B.cartesian(a, b), "first", "second") == [(1, 3), (1, 4), (2, 3), (2, 4)]
    assert values(B.cross_product(a, b, a)) == [list(p) for p in itertools.product([1, 2], [3, 4], [1, 2])]
    five = seq(spark, [1, 2, 3, 4, 5])
    assert values(B.combinations(five, 3)) == [list(c) for c in itertools.combinations([1, 2, 3, 4, 5], 3)]
    assert values(B.combinations(five, 0)) == [] and values(B.combinations(a, 3)) == []
    assert sorted(values(B.permutations(seq(spark, [1, 2, 3])))) == sorted(list(p) for p in itertools.permutations([1, 2, 3]))
    assert values(B.permutations(seq(spark, [1, 2, 3])))[0] == [1, 2, 3]
    assert values(B.permutations(seq(spark, []))) == []
    assert tuples(W.triples(five), "first", "second", "third") == [(1, 2, 3), (2, 3, 4), (3, 4, 5)]


def test_transforms(spark):
    s = seq(spark, [-2, -1, 0, 1, 2])
    assert values(T.positive(s)) == [1, 2] and values(T.negative(s)) == [-2, -1] and values(T.non_zero(s)) == [-2, -1, 1, 2]
    assert values(T.clamp(seq(spark, [1, 5, 10, 15, 20]), 5, 15)) == [5, 5, 10, 15, 15]
    assert values(T.abs_(s)) == [2, 1, 0, 1, 2] and values(T.scale(s, 3)) == [-6, -3, 0, 3, 6] and values(T.offset(s, 1)) == [-1, 0, 1, 2, 3]
    assert values(T.flatten(seq(spark, [([1],), ([],), ([2, 3],)], "value array<bigint>"))) == [1, 2, 3]
    assert values(T.intersperse(seq(spark, [1, 2, 3]), 0)) == [1, 0, 2, 0, 3]
    assert values(T.intersperse(seq(spark, [1]), 0)) == [1] and values(T.intersperse(seq(spark, []), 0)) == []
    assert tuples(T.zip_with_index(seq(spark, [7, 8])), "index", "value") == [(0, 7), (1, 8)]
    assert values(T.map_rows(s, lambda r: {"value": r["value"] * 10}, "value bigint")) == [-20, -10, 0, 10, 20]
    assert values(T.flat_map_rows(seq(spark, [1, 2]), lambda r: [r["value"]] * r["value"], "bigint")) == [1, 2, 2]
    nan = float("nan")
    assert values(T.positive(seq(spark, [nan, 1.0], "double"))) == [1.0]


def test_sources(spark):
    assert values(M.range_(spark, 3, 6)) == [3, 4, 5] and values(M.range_(spark, 6, 3)) == [] and values(M.range_closed(spark, 3, 5)) == [3, 4, 5]
    assert values(M.repeat(spark, "x", 2)) == ["x", "x"] and values(M.repeat(spark, "x", -1)) == []
    assert values(M.cycle(spark, [1, 2], 5)) == [1, 2, 1, 2, 1] and values(M.cycle(spark, [], 5)) == []
    assert values(M.iterate(spark, F.lit(1).cast("bigint"), lambda x: x * 2, 5)) == [1, 2, 4, 8, 16]
    assert values(M.generate(spark, 3, lambda i: i * i)) == [0, 1, 4]
    state = iter("abc")
    assert values(M.generate_rows(spark, 3, lambda: next(state), "string")) == ["a", "b", "c"]
    assert values(M.interval_between(spark, "2024-01-01 00:00:00", "2024-01-01 00:00:03", "1 second")) == [0, 1, 2]
    assert M.from_map(spark, {"a": 1}).collect()[0] == ("a", 1)
    assert values(M.empty(spark)) == []


def test_index_is_dense_over_partitions(spark):
    rows = spark.range(0, 5000, 1, 16).select((F.col("id") * 7919 % 5000).alias("k"))
    got = Ordered(rows, ["k"]).index().df.orderBy("k").select("k", "__idx").collect()
    assert all(r.k == r["__idx"] for r in got)


def test_distinct_until_changed_by_parts(spark, monkeypatch):
    """Chains that meet soon, late or never, over many parts; groups, nulls and NaN; and one array doesn't take all rows."""
    from rillframe.operators import chain

    rng = random.Random(5)
    n, nan = 400, float("nan")
    cases = {
        "random": [rng.random() * 100 for _ in range(n)], "never": [10.0 * i for i in range(n)], "constant": [7.0] * n, "slow": [i / 1000 for i in range(n)],
        "odd": [rng.choice([None, nan, 1.0, 15.0, 40.0]) for _ in range(n)], "late": [*[10.0 * i for i in range(n // 2)], *[rng.random() * 100 for _ in range(n // 2)]],
    }
    monkeypatch.setattr(chain.kept, "__defaults__", (16, 4))
    monkeypatch.setattr(chain, "BLOCK", 4)
    monkeypatch.setattr(chain, "RUN", 5)

    def brute(rows):
        kept, last = [], {}
        for place, g, x in rows:
            # Spark's comparison: NaN is above all numbers, null is never true
            if g in last and x is not None and last[g] is not None and abs(x - last[g]) <= 20:
                continue
            kept.append(place)
            last[g] = x
        return kept

    for name, xs in cases.items():
        rows = [(i, None if i % 3 == 0 else i % 3, x) for i, x in enumerate(xs)]
        df = spark.createDataFrame(rows, "place int, g int, value double").repartition(5)
        near = lambda a, b: F.abs(a - b) <= 20
        if name in ("random", "odd", "never"):
            got = S.distinct_until_changed_by(Ordered(df, ["place"]), near, ["g"])
            assert got.df.columns == ["place", "g", "value"] and [r.place for r in got.df.orderBy("place").collect()] == brute(rows), name
        got = S.distinct_until_changed_by(Ordered(df, ["place"]), near)
        assert [r.place for r in got.df.orderBy("place").collect()] == brute([(i, 0, x) for i, _, x in rows]), name
    assert S.distinct_until_changed_by(Ordered(df.limit(0), ["place"]), near).df.collect() == []


def test_distinct_until_changed_by_linear(spark):
    """What it costs doesn't grow with the square of the rows kept; one growing array took 113 s for half as many rows."""
    import time

    xs = spark.range(200_000).select("id", (F.pmod(F.hash("id"), F.lit(1000)) / 10).alias("value"))
    values = [r[0] for r in xs.orderBy("id").select("value").collect()]
    kept, last = 0, None
    for x in values:
        if last is None or abs(x - last) > 20:
            kept, last = kept + 1, x
    began = time.time()
    got = S.distinct_until_changed_by(Ordered(xs, ["id"]), lambda a, b: F.abs(a - b) <= 20).df.count()
    assert got == kept and time.time() - began < 60


def test_whole_tables(spark, small):
    """Queries over all rows against brute force."""
    from rillframe.plans import QUERIES

    run = lambda name: [tuple(r) for r in QUERIES[name](spark, small).collect()]
    events = spark.read.parquet(f"{small}/events.parquet").orderBy("event_id").select("event_id", "user_id", "value").collect()
    ids = [r.event_id for r in events]
    folded, reduced = 1, ids[0]
    for x in ids:
        folded = (folded * 31 + x) % 1000003
    for x in ids[1:]:
        reduced = (reduced * 7 + x) % 10007
    assert len(ids) > 500 and run("fold") == [(folded,)] and run("reduce_optional") == [(reduced,)]
    assert sorted(r[0] for r in run("flatten")) == sorted([*ids, *[i + 1 for i in ids]])
    assert sorted((r["index"], r["value"]) for r in QUERIES["zip_with_index"](spark, small).collect()) == list(enumerate(ids))
    kept, last = [], None
    for r in events:
        if last is None or abs(r.value - last) > 20:
            kept.append(r.event_id)
            last = r.value
    assert sorted(r[0] for r in run("distinct_until_changed_by")) == kept
    state, want = {}, []
    for r in events:
        state[r.user_id] = (state.get(r.user_id, 1) * 3 + r.event_id) % 1009
        want.append((r.event_id, r.user_id, state[r.user_id]))
    assert sorted(run("scan")) == want
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    assert run("string_lines") == [(sum(len(x.rstrip("\n").split("\n")) for x in texts if x),)]
