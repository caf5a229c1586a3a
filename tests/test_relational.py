"""Joins, aggregates, groups, collectors, optional values, results and tuples."""

from pyspark.sql import functions as F

from rillframe.functions import collectors as C
from rillframe.functions import optional as P
from rillframe.functions import result as R
from rillframe.functions import tuples as U
from rillframe.operators import aggregates as A
from rillframe.operators import grouping as G
from rillframe.operators import joins as J
from rillframe.sources import collections as L
from rillframe.sources import memory as M


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def kv(spark, pairs, value="bigint"):
    return M.pairs_of(spark, pairs, "string", value)


def test_joins(spark):
    left, right = kv(spark, [("a", 1), ("b", 2), ("c", 3)]), kv(spark, [("a", "x"), ("b", "y"), ("d", "z")], "string")
    assert rows(J.inner_join(left, right), "key", "left", "right") == [("a", 1, "x"), ("b", 2, "y")]
    assert rows(J.left_join(left, right), "key", "left", "right", "has_right") == [("a", 1, "x", True), ("b", 2, "y", True), ("c", 3, None, False)]
    assert rows(J.right_join(left, right), "key", "right", "has_left") == [("a", "x", True), ("b", "y", True), ("d", "z", False)]
    assert len(rows(J.full_join(left, right), "key")) == 4
    assert rows(J.left_join_with(left, right, "?"), "key", "right") == [("a", "x"), ("b", "y"), ("c", "?")]
    assert rows(J.right_join_with(left, right, 0), "key", "left") == [("a", 1), ("b", 2), ("d", 0)]
    assert rows(J.semi_join(left, right).df, "key") == [("a",), ("b",)] and rows(J.anti_join(left, right).df, "key") == [("c",)]
    twice = kv(spark, [("a", 1), ("a", 2)])
    assert len(rows(J.inner_join(twice, kv(spark, [("a", "x"), ("a", "y")], "string")), "key")) == 4
    assert rows(J.co_group(twice, right), "key", "left", "right")[0] == ("a", [1, 2], ["x"])
    assert rows(J.co_group(twice, right), "key", "left", "right")[-1] == ("d", [], ["z"])


def test_null_keys_and_values(spark):
    left, right = kv(spark, [(None, 1), ("a", 2)]), kv(spark, [(None, "x"), ("a", None)], "string")
    assert rows(J.inner_join(left, right), "key") == [("a",)]
    assert len(rows(J.inner_join(left, right, null_safe=True), "key")) == 2
    # a null value isn't a missing one
    assert rows(J.left_join_with(kv(spark, [("a", 2)]), right, "?"), "right") == [(None,)]


def test_aggregates_of_none(spark):
    none = M.empty(spark)
    assert A.scalar(A.sum_(none)) == 0 and A.scalar(A.product(none)) == 1 and A.scalar(A.average(none)) is None and A.scalar(A.min_value(none)) is None
    assert A.min_max(none).first() is None and A.get_statistics(none).first() is None and A.scalar(A.quantile(none, 0.5)) is None
    assert A.scalar(A.any_match(none, F.lit(True))) is False and A.scalar(A.all_match(none, F.lit(False))) is True and A.scalar(A.none_match(none, F.lit(True))) is True
    assert A.is_empty(none) and not A.is_not_empty(none) and A.scalar(A.reduce_optional(none, lambda a, b: a + b)) is None
    assert A.scalar(A.count(none)) == 0


def test_aggregates(spark):
    s = M.from_rows(spark, [1.5, 2.5, 3.0], "double")
    assert A.scalar(A.sum_(s)) == 7.0
    ten = M.range_closed(spark, 1, 10)
    assert A.scalar(A.quantile(ten, 0.75)) == 7 and A.scalar(A.median(M.of(spark, 1, 2, 3, 4))) == 2 and A.scalar(A.percentile(ten, 100)) == 10 and A.scalar(A.quantile(ten, -3)) == 1
    assert A.scalar(A.fold(ten, F.lit(0).cast("bigint"), lambda a, x: a * 2 + x)) == 2036
    assert A.scalar(A.reduce_optional(M.of(spark, 3, 4), lambda a, x: a - x)) == -1
    people = M.from_rows(spark, [("Alice", 30), ("Bob", 25), ("Carol", 30)], "name string, age bigint")
    assert A.min_by(people, "age").first().name == "Bob" and A.max_by(people, "age").first().name == "Alice"
    assert A.scalar(A.contains(ten, 4)) and A.exists(ten, F.col("value") > 9) and not A.exists(ten, F.col("value") > 10)
    assert A.tree_reduce(ten.df, "value", 0, lambda a, b: a + b) == 55
    nan = float("nan")
    assert A.scalar(A.max_value(M.from_rows(spark, [nan, 1.0], "double"))) == 1.0


def test_groups(spark):
    s = kv(spark, [("a", 1), ("b", 2), ("a", 3), ("b", 4), ("a", 5)])
    assert rows(G.reduce_by_key(s, F.sum("value")), "key", "value") == [("a", 9), ("b", 6)]
    assert rows(G.fold_by_key(s, lambda a, x: a * 10 + x), "key", "value") == [("a", 135), ("b", 24)]
    assert rows(G.reduce_by_key_with_init(s, F.lit(7).cast("bigint"), lambda a, x: a * 10 + x), "key", "value") == [("a", 7135), ("b", 724)]
    assert rows(G.group_values(s), "key", "values") == [("a", [1, 3, 5]), ("b", [2, 4])]
    assert rows(G.to_map2(s), "key", "value") == [("a", 5), ("b", 4)]
    assert rows(G.to_map(kv(spark, [("a", 1), ("a", None)]), "key"), "key", "value") == [("a", None)]
    words = M.from_rows(spark, ["a", "b", "b", "c", "c", "c"], "string")
    assert [tuple(r) for r in G.most_common(words, 2).collect()] == [("c", 3), ("b", 2)]
    assert A.scalar(G.joining(M.from_rows(spark, ["", "a"], "string"), ",")) == ",a"
    assert A.scalar(G.joining(M.empty(spark, "string"), ",", "[", "]")) == "[]"
    yes, no = G.partition_by(s, F.col("value") > 2)
    assert yes.df.count() == 3 and no.df.count() == 2


def test_collectors(spark):
    words = M.from_rows(spark, ["a", "bb", "ccc", "dd", "eee"], "string")
    assert rows(C.histogram(words, F.length("value")), "key", "values") == [(1, ["a"]), (2, ["bb", "dd"]), (3, ["ccc", "eee"])]
    s = M.from_rows(spark, ["", "a", ""], "string")
    one = A.collect_to(s, C.joining("value", s.order, ",").alias("j"), C.counting().alias("n"), C.first("value", s.order).alias("f"), C.last("value", s.order).alias("l")).first()
    assert (one.j, one.n, one.f, one.l) == ("a,", 3, "", "")
    n = M.of(spark, 3, 1, 4, 1, 5)
    got = A.collect_to(
        n, C.top_k("value", 2).alias("top"), C.bottom_k("value", 2).alias("low"), C.median("value").alias("med"), C.teeing(C.summing("value"), C.counting(), lambda a, b: a / b).alias("avg"),
        C.filtering(F.col("value") > 3, F.count).alias("big"), C.partitioning_by("value", F.col("value") > 9, n.order).alias("parts"), C.reducing("value", F.lit(0).cast("bigint"), lambda a, x: a + x, n.order).alias("sum"),
        C.max_by("value", "value", n.order).alias("most"), C.min_by("value", "value", n.order).alias("least"), C.flat_mapping(F.array("value", "value"), F.size).alias("twice"),
    ).first()
    assert (got.top, got.low, got.med, got.avg, got.big, got["sum"], got.most, got.least, got.twice) == ([5, 4], [1, 1], 3, 2.8, 2, 14, 5, 1, 10)
    assert got.parts["true"] == [] and got.parts["false"] == [3, 1, 4, 1, 5]
    merged = C.to_map_merging(kv(spark, [("a", 1), ("a", 2), ("b", 3)]), "key", F.sum("value"))
    assert rows(merged, "key", "value") == [("a", 3), ("b", 3)]


def test_results(spark):
    s = M.from_results(spark, [(True, 1, None), (True, 2, None), (False, None, "bad"), (True, 4, None)])
    assert [r.value for r in R.take_until_err(s).collect()] == [1, 2]
    assert R.collect_results(s) == ([1, 2], "bad")
    all_ = R.collect_results_all(s).first()
    assert all_["values"] == [1, 2, 4] and all_.errors == ["bad"]
    assert [r.value for r in R.unwrap_or_default(s, 0).collect()] == [1, 2, 0, 4]
    n = M.of(spark, 1, 2, 3, 4, 5)
    even = R.filter_err(n, lambda x: F.when(x != 3, x % 2 == 0), "three")
    assert [(r.ok, r.value) for r in even.collect()] == [(True, 2), (False, None), (True, 4)]
    parts = R.flat_map_err(n, lambda x: F.when(x != 3, F.array(x, x)), "three")
    assert [r.value for r in parts.collect()] == [1, 1, 2, 2, None, 4, 4, 5, 5]
    tried = R.python_map_err(n, lambda x: 10 // (x - 2), "bigint")
    assert [r.ok for r in tried.collect()] == [True, False, True, True, True]
    r = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("bigint").alias("value"), F.lit("e").alias("err"))
    got = spark.range(1).select(
        R.unwrap_or(r, F.lit(5)).alias("a"), R.or_(r, R.ok(F.lit(6).cast("bigint")))["value"].alias("b"), R.map_(R.ok(F.lit(2)), lambda x: x + 1)["value"].alias("c"), R.map_err(r, F.upper)["err"].alias("d"),
        R.is_ok(R.err(F.lit(None).cast("string"))).alias("e"), R.flat_map_result(R.ok(F.lit(2).cast("bigint")), lambda x: R.err_msg("no"))["err"].alias("f"), R.value(r).alias("g"), R.and_(r, R.ok(F.lit(1).cast("bigint")))["err"].alias("h"),
    ).first()
    assert tuple(got) == (5, 6, 3, "E", True, "no", 0, "e")


def test_optional_and_tuples(spark):
    x, none = F.lit(3), F.lit(None).cast("int")
    p = U.new_triple(F.lit(1), F.lit("b"), F.lit(2.0))
    got = spark.range(1).select(
        P.get_or_else(none, F.lit(9)).alias("a"), P.get_or_zero(none, "int").alias("b"), P.string(x).alias("c"), P.string(none).alias("d"), P.optional_equals(none, none).alias("e"), P.to_slice(none).alias("f"),
        P.is_present(P.optional_zip(x, none)).alias("g"), P.filter_(x, lambda v: v > 5).alias("h"), U.to_pair(p)["second"].alias("i"), U.map_third(p, lambda v: v * 2)["third"].alias("j"), U.swap(U.to_pair(p))["first"].alias("k"),
    ).first()
    assert tuple(got) == (9, 0, "Some(...)", "None", True, [], False, None, "b", 4.0, "b")


def test_collections(spark):
    df = spark.createDataFrame([([3, 1, 2, 1], {"b": 2, "a": 1})], "xs array<int>, m map<string,int>")
    take = lambda s: [r.value for r in s.df.orderBy(*s.order).collect()]
    assert take(L.from_sorted_set(df, "xs")) == [1, 2, 3] and take(L.from_sorted_set_descending(df, "xs")) == [3, 2, 1]
    assert take(L.from_list(df, "xs")) == [3, 1, 2, 1] and take(L.from_stack(df, "xs")) == [1, 2, 1, 3] and take(L.from_priority_queue_sorted(df, "xs")) == [1, 1, 2, 3]
    assert [tuple(r)[:2] for r in L.from_sorted_map(df, "m").sorted().collect()] == [("a", 1), ("b", 2)]
    s = kv(spark, [("b", 2), ("a", 1), ("b", 3)])
    assert [tuple(r) for r in L.to_tree_map(s).sorted().collect()] == [("a", 1), ("b", 3)]
    assert L.map_of_groups(L.to_hash_map(s), sort=True).first()[0] == {"a": 1, "b": 3}
    assert L.to_array_list(s).first()[0] == [2, 1, 3]
