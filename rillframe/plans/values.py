"""Values from Python, optional values, results, tuples, collections, collectors and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillframe.functions import collectors as K
from rillframe.functions import optional as O
from rillframe.functions import result as R
from rillframe.functions import tuples as U
from rillframe.operators import aggregates as A
from rillframe.operators import combine as C
from rillframe.operators import effects as E
from rillframe.operators import grouping as G
from rillframe.operators import parallel as P
from rillframe.operators import transforms as T
from rillframe.ordered import Ordered
from rillframe.plans.registry import Tables, query
from rillframe.session import scratch
from rillframe.sources import collections as L
from rillframe.sources import memory as M
from rillframe.sources import text as X
from rillframe.streaming import windows as W

# --- sources


@query("SELECT * FROM (VALUES ('of', 3::BIGINT), ('of', 1), ('of', 2), ('slice', 9), ('slice', 8), ('closed', 5), ('closed', 6), ('frame', 42)) v(source, value)")
def values_from_python(t: Tables):
    frame = M.from_frame(t.spark.range(42, 43).select(F.col("id").alias("value")), "value")
    named = {"of": M.of(t.spark, 3, 1, 2), "slice": M.from_slice(t.spark, [9, 8], "bigint"), "none": M.empty(t.spark), "closed": M.range_closed(t.spark, 5, 6), "frame": frame}
    parts = [s.df.select(F.lit(name).alias("source"), "value") for name, s in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query("SELECT * FROM (VALUES ('pairs', 'a', 1::BIGINT), ('pairs', 'a', 2), ('from2', 'b', 3), ('map', 'c', 4), ('map', 'd', 5)) v(source, key, value)")
def pairs_from_python(t: Tables):
    parts = {"pairs": M.pairs_of(t.spark, [("a", 1), ("a", 2)]).df, "from2": M.from2(t.spark, [("b", 3)]).df, "map": M.from_map(t.spark, {"c": 4, "d": 5}), "none": M.empty2(t.spark).df}
    rows = [df.select(F.lit(name).alias("source"), "key", "value") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT n_nationkey::BIGINT AS value FROM nation UNION ALL SELECT n_regionkey::BIGINT FROM nation")
def rows_one_by_one(t: Tables):
    """Rows that the driver read one by one, in order, as rows again."""
    s = t.by("nation", "n_nationkey")
    seen = [r["n_nationkey"] for r in M.seq(s)]
    pairs = [r["n_regionkey"] for r in M.seq2(s)]
    if seen != sorted(seen):
        raise ValueError("out of order")
    return M.from_rows(t.spark, [*seen, *pairs], "bigint").df.select("value")


@query("SELECT i AS value, TIMESTAMP '2024-01-01' + (i + 1) * INTERVAL 6 HOUR AS ts FROM range(0, 7) r(i) UNION ALL SELECT 42, TIMESTAMP '2024-02-03 04:05:06'")
def clocks_of_event_time(t: Tables):
    every = M.interval_between(t.spark, "2024-01-01 00:00:00", "2024-01-02 18:00:00", "6 hours")
    once = M.timer(t.spark, 42, "2024-02-03 04:05:06")
    kind = lambda s: s.df.select(F.col("value").cast("bigint").alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return kind(every).unionByName(kind(once))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS line FROM supplier")
def lines_until_long(t: Tables):
    path = scratch(t.spark)
    X.to_file(t.by("supplier", "s_suppkey"), path, F.col("s_suppkey"))
    lines = X.from_lines_err(t.spark, path)
    X.close(lines)
    return X.cached(lines).df.where("ok").select(F.col("value").alias("line"))


@query("SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 7 = 0 THEN 'no label' ELSE p_type END AS label, p_partkey % 7 <> 0 AS ok FROM part")
def csv_header_errors(t: Tables):
    """Records without a label are errors of width; what a record lacks has a default."""
    path, short = scratch(t.spark), F.col("p_partkey") % 7 == 0
    head = t.spark.range(1).select(F.array(F.lit("key"), F.lit("label")).alias("value"), F.lit(-1).cast("bigint").alias("__o"))
    rows = t.part.select(F.when(short, F.array(F.col("p_partkey").cast("string"))).otherwise(F.array(F.col("p_partkey").cast("string"), "p_type")).alias("value"), F.col("p_partkey").alias("__o"))
    X.to_csv_file(Ordered(head.unionByName(rows), ["__o"]), path)
    read = T.zip_with_index(X.from_csv_with_header_err(t.spark, path), "place").df
    whole = T.zip_with_index(t.by("part", "p_partkey"), "place").df.select("place", "p_partkey")
    return read.join(whole, "place").select(F.col("p_partkey").cast("string").alias("key"), X.record_get_or(F.coalesce("record", F.create_map().cast("map<string,string>")), "label", "no label").alias("label"), "ok")


@query("SELECT n_regionkey AS region, n_name || ',' || n_regionkey AS line FROM nation")
def written_by_the_driver(t: Tables):
    """to_csv and to_writer write to any file object."""
    import io

    csv, lines = io.StringIO(), io.StringIO()
    s = t.by("nation", "n_nationkey")
    X.to_csv(s, csv, F.array("n_name", F.col("n_regionkey").cast("string")))
    X.to_writer(s, lines, F.col("n_regionkey"))
    rows = [(int(r), x) for r, x in zip(lines.getvalue().split(), csv.getvalue().splitlines(), strict=True)]
    return t.spark.createDataFrame(rows, "region int, line string")


# --- optional values and results

_THIRD = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END"


@query(f"""
SELECT c_custkey, x IS NULL AS empty, x IS NOT NULL AS present, coalesce(x, 0.0) AS or_zero, coalesce(x, -1.0) AS or_else, x * 2 AS doubled, CASE WHEN x > 0 THEN x END AS positive,
       len(CASE WHEN x IS NULL THEN [] ELSE [x] END)::INTEGER AS size, x IS NOT DISTINCT FROM y AS same, CASE WHEN x IS NULL THEN 'None' ELSE 'Some(...)' END AS text, y IS NOT NULL AND x IS NOT NULL AS both,
       c_acctbal AS got, y, c_acctbal AS kept, x AS pointer, 7::INTEGER AS seven, CAST(NULL AS BIGINT) AS nothing
FROM (SELECT c_custkey, c_acctbal, {_THIRD} AS x, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS y FROM customer)""")
def optional_values(t: Tables):
    x = O.optional_from_condition(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    y = O.optional_from_condition(F.col("c_custkey") % 2 == 0, O.optional_of(F.col("c_acctbal")))
    return t.customer.select(
        "c_custkey", O.is_empty(x).alias("empty"), O.is_present(x).alias("present"), O.get_or_zero(x, "double").alias("or_zero"), O.get_or_else(x, F.lit(-1.0)).alias("or_else"),
        O.optional_map(x, lambda v: v * 2).alias("doubled"), O.filter_(x, lambda v: v > 0).alias("positive"), F.size(O.to_slice(x)).alias("size"), O.optional_equals(x, y).alias("same"),
        O.string(x).alias("text"), O.is_present(O.optional_zip(x, y)).alias("both"), O.get(F.col("c_acctbal")).alias("got"), O.or_else(y, O.none("double")).alias("y"),
        O.some(F.col("c_acctbal")).alias("kept"), O.to_pointer(x).alias("pointer"), O.some(7).alias("seven"), O.none("bigint").alias("nothing"),
    )


@query("SELECT c_custkey AS value FROM customer WHERE c_custkey % 3 <> 0")
def present_values(t: Tables):
    s = Ordered(t.customer.select(O.optional_flat_map(F.col("c_custkey"), lambda v: O.filter_(v, lambda k: k % 3 != 0)).alias("value"), F.col("c_custkey").alias("__o")), ["__o"])
    return O.to_stream(s).df.select("value")


@query("SELECT * FROM (VALUES ('seen', 3::BIGINT), ('other', 1)) v(kind, n)")
def present_on_the_driver(t: Tables):
    seen, other = [], []
    for value in (1, 2, None):
        O.if_present(value, seen.append)
        O.if_present_or_else(value, lambda v: seen.append(v) if v == 2 else None, lambda: other.append(0))
    return t.spark.createDataFrame([("seen", len(seen)), ("other", len(other))], "kind string, n bigint")


@query("""
SELECT s_suppkey, bad, NOT bad AS good, CASE WHEN bad THEN -1 ELSE v END AS or_, CASE WHEN bad THEN 8 ELSE v END AS or_length, coalesce(v, 0) AS value, v AS optional, e AS error,
       v + 1 AS next, upper(e) AS loud, CASE WHEN bad THEN NULL WHEN v % 2 = 0 THEN v // 2 END AS halved, CASE WHEN bad THEN e WHEN v % 2 = 1 THEN 'odd' END AS why,
       CASE WHEN bad THEN NULL ELSE 5 END AS and_, CASE WHEN bad THEN 5 ELSE v END AS or_other, s_suppkey AS sure, 'too high' AS message, v AS got, v * 2 AS mapped
FROM (SELECT s_suppkey, s_suppkey % 4 = 0 AS bad, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS v, CASE WHEN s_suppkey % 4 = 0 THEN 'too high' END AS e FROM supplier)""")
def result_values(t: Tables):
    key = F.col("s_suppkey")
    r = F.when(key % 4 == 0, R.err_msg("too high")).otherwise(R.ok(key))
    half = lambda v: F.when(v % 2 == 0, R.ok(F.floor(v / 2))).otherwise(R.err(F.lit("odd")))
    halved, five = R.flat_map_result(r, half), R.ok(F.lit(5).cast("bigint"))
    sure, message = R.unwrap(R.ok(key)), R.unwrap_err(R.err(F.lit("too high")))
    return t.supplier.select(
        "s_suppkey", R.is_err(r).alias("bad"), R.is_ok(r).alias("good"), R.unwrap_or(r, F.lit(-1).cast("bigint")).alias("or_"), R.unwrap_or_else(r, lambda e: F.length(e).cast("bigint")).alias("or_length"),
        R.value(r).alias("value"), R.to_optional(r).alias("optional"), R.error(r).alias("error"), R.map_(r, lambda v: v + 1)["value"].alias("next"), R.map_err(r, F.upper)["err"].alias("loud"),
        halved["value"].alias("halved"), halved["err"].alias("why"), R.and_(r, five)["value"].alias("and_"), R.or_(r, five)["value"].alias("or_other"), sure.alias("sure"), message.alias("message"),
        R.get(r)[0].alias("got"), R.map_result_to(r, lambda v: v * 2)["value"].alias("mapped"),
    )


@query("SELECT s_suppkey AS value FROM supplier WHERE s_suppkey % 4 <> 0")
def unwrapped_results(t: Tables):
    s = R.map_err_to(Ordered(t.supplier.select(F.col("s_suppkey").alias("value"), F.col("s_suppkey").alias("__o")), ["__o"]), lambda v: F.when(v % 4 != 0, v), "fourth")
    return R.unwrap_results(s.with_df(s.df.where("ok"))).df.select("value")


@query("SELECT s_suppkey AS value, CAST('fourth' AS VARCHAR) AS error FROM supplier WHERE s_suppkey < (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey > 0) AND s_suppkey > 0")
def collected_results(t: Tables):
    s = R.map_err_to(Ordered(t.supplier.where("s_suppkey > 0").select(F.col("s_suppkey").alias("value"), F.col("s_suppkey").alias("__o")), ["__o"]), lambda v: F.when(v % 4 != 0, v), "fourth")
    found, error = R.collect_results(s)
    return t.spark.createDataFrame([(v, error) for v in found], "value bigint, error string")


# --- tuples


@query("""
SELECT n_nationkey, n_regionkey + 1 AS first, upper(n_name) AS second, n_nationkey * 3 AS third, n_name AS swapped, n_regionkey AS paired, n_name AS of_triple, n_regionkey AS fourth, n_nationkey AS of_quad, n_regionkey AS last
FROM nation""")
def tuples(t: Tables):
    pair = U.new_pair(F.col("n_regionkey"), F.col("n_name"))
    triple = U.new_triple(F.col("n_regionkey"), F.col("n_name"), F.col("n_nationkey"))
    quad = U.new_quad(F.col("n_regionkey"), F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey"))
    return t.nation.select(
        "n_nationkey", U.map_first(pair, lambda x: x + 1)["first"].alias("first"), U.map_second(triple, F.upper)["second"].alias("second"), U.map_third(triple, lambda x: x * 3)["third"].alias("third"),
        U.swap(pair)["first"].alias("swapped"), U.to_pair(quad)["first"].alias("paired"), U.to_pair(triple)["second"].alias("of_triple"), quad["fourth"].alias("fourth"), U.to_triple(quad)["third"].alias("of_quad"),
        U.map_second(pair, F.lower)["first"].alias("last"),
    )


# --- collections


def _lists(t: Tables):
    """One row: lists of the nations' regions, which repeat, in order of the nations, and a map of the names."""
    regions = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))), lambda x: x["n_regionkey"])
    return t.nation.agg(regions.alias("xs"), F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))


_RANKED = "(SELECT n_regionkey AS value, {} AS place FROM nation)"
_UNIQUE = "(SELECT value, {} AS place FROM (SELECT DISTINCT n_regionkey AS value FROM nation))"


@query(f"""
SELECT 'set' AS kind, value, CAST(NULL AS BIGINT) AS place FROM {_UNIQUE.format('0')}
UNION ALL SELECT 'descending', value, place FROM {_UNIQUE.format('row_number() OVER (ORDER BY value DESC) - 1')}
UNION ALL SELECT 'queue', value, place FROM {_RANKED.format('row_number() OVER (ORDER BY n_nationkey) - 1')}
UNION ALL SELECT 'list', value, place FROM {_RANKED.format('row_number() OVER (ORDER BY n_nationkey) - 1')}
UNION ALL SELECT 'deque', value, place FROM {_RANKED.format('row_number() OVER (ORDER BY n_nationkey) - 1')}
UNION ALL SELECT 'stack', value, place FROM {_RANKED.format('row_number() OVER (ORDER BY n_nationkey DESC) - 1')}
UNION ALL SELECT 'reversed', value, place FROM {_RANKED.format('row_number() OVER (ORDER BY n_nationkey DESC) - 1')}
UNION ALL SELECT 'heap', value, NULL FROM {_RANKED.format('0')}
UNION ALL SELECT 'ascending', value, place FROM {_RANKED.format('row_number() OVER (ORDER BY n_regionkey) - 1')}""")
def collections_as_rows(t: Tables):
    one = _lists(t)
    made = {
        "set": L.from_set(one, "xs"), "descending": L.from_sorted_set_descending(one, "xs"), "queue": L.from_queue(one, "xs"), "list": L.from_list(one, "xs"), "deque": L.from_deque(one, "xs"),
        "stack": L.from_stack(one, "xs"), "reversed": L.from_deque_reversed(one, "xs"), "heap": L.from_priority_queue(one, "xs"), "ascending": L.from_priority_queue_sorted(one, "xs"),
    }
    place = lambda s: (s.df, F.col("__o")) if isinstance(s, Ordered) else (s, F.lit(None).cast("bigint"))
    out = None
    for name, s in made.items():
        df, at = place(s)
        df = df.select(F.lit(name).alias("kind"), "value", at.alias("place"))
        out = df if out is None else out.unionByName(df)
    return out


@query("""
SELECT 'map' AS kind, n_name AS key, n_nationkey AS value, CAST(NULL AS BIGINT) AS place FROM nation
UNION ALL SELECT 'descending', n_name, n_nationkey, row_number() OVER (ORDER BY n_name DESC) - 1 FROM nation""")
def maps_as_rows(t: Tables):
    one = _lists(t)
    plain = L.from_map_column(one, "m").select(F.lit("map").alias("kind"), "key", "value", F.lit(None).cast("bigint").alias("place"))
    return plain.unionByName(L.from_sorted_map_descending(one, "m").df.select(F.lit("descending").alias("kind"), "key", "value", F.col("__o").alias("place")))


def _pairs(t: Tables) -> Ordered:
    return Ordered(t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), "event_id"), ["event_id"])


_TEXT = "array_to_string({}, ' ')"


@query(f"""
SELECT key, {_TEXT.format('vs')} AS hashed, {_TEXT.format('vs')} AS tree, {_TEXT.format('vs')} AS grouped, {_TEXT.format('vs')} AS histogram, {_TEXT.format('vs')} AS by_collector, vs[-1] AS last, vs[-1] AS last_tree,
       vs[-1] AS last2, vs[-1] AS last_tree2, len(vs) AS n, vs[-1] AS by_map, len(vs) AS frequency, sum_ AS merged
FROM (SELECT event_type AS key, list(user_id ORDER BY event_id) AS vs, CAST(sum(user_id) AS BIGINT) AS sum_ FROM events GROUP BY 1)""")
def groups_in_maps(t: Tables):
    s = _pairs(t)
    keys = s.with_df(s.df.select(F.col("key").alias("value"), "event_id"))
    text = lambda df, name: df.select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias(name))
    named = lambda df, name, value="value", key="key": df.select(F.col(key).alias("key"), F.col(value).alias(name))
    parts = [
        text(L.group_by_to_hash_map(s, "key"), "hashed"), text(L.group_by_to_tree_map(s, "key").df, "tree"), text(L.group_values_to_hash_map(s), "grouped"), text(L.histogram_to_hash_map(s, "key"), "histogram"),
        text(K.grouping_by(s, "key"), "by_collector"), named(L.to_hash_map(s), "last"), named(L.to_tree_map(s).df, "last_tree"), named(L.to_hash_map2(s), "last2"), named(L.to_tree_map2(s).df, "last_tree2"),
        named(L.frequency_to_hash_map(keys), "n", "count", "value"), named(K.to_map(s, "key"), "by_map"), named(K.frequency(keys), "frequency", "count", "value"), named(K.to_map_merging(s, "key", F.sum("value")), "merged"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "key")
    return out


@query(f"""
SELECT event_type AS key, {_TEXT.format('list(user_id ORDER BY event_id)')} AS values, {_TEXT.format('list(user_id ORDER BY event_id)')} AS histogram, arg_max(user_id, event_id) AS last, count(*) AS n FROM events GROUP BY 1""")
def grouped_values(t: Tables):
    s = _pairs(t)
    text = lambda df, name: df.select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias(name))
    counted = G.frequency(s.with_df(s.df.select("key", "event_id")), "key").select(F.col("value").alias("key"), F.col("count").alias("n"))
    return text(G.group_values(s), "values").join(text(K.histogram(s, "key"), "histogram"), "key").join(G.to_map2(s).select("key", F.col("value").alias("last")), "key").join(counted, "key")


@query("SELECT 'hash' AS kind, event_type AS value, CAST(NULL AS BIGINT) AS place FROM events GROUP BY 2 UNION ALL SELECT 'tree', event_type, row_number() OVER (ORDER BY event_type) - 1 FROM (SELECT DISTINCT event_type FROM events)")
def sets_of_values(t: Tables):
    s = t.events_in_order
    plain = L.to_hash_set(s, "event_type").select(F.lit("hash").alias("kind"), F.col("event_type").alias("value"), F.lit(None).cast("bigint").alias("place"))
    tree = T.zip_with_index(L.to_tree_set(s, "event_type"), "place")
    return plain.unionByName(tree.df.select(F.lit("tree").alias("kind"), F.col("event_type").alias("value"), "place"))


@query(f"SELECT {_TEXT.format('list(n_name ORDER BY n_nationkey)')} AS names, {_TEXT.format('list(n_name ORDER BY n_nationkey)')} AS linked FROM nation")
def lists_of_values(t: Tables):
    s = t.by("nation", "n_nationkey")
    text = lambda df, name: df.select(F.array_join("list", " ").alias(name))
    return text(L.to_array_list(s, "n_name"), "names").crossJoin(text(L.to_linked_list(s, "n_name"), "linked"))  # one row each


# --- collectors


@query(f"""
SELECT event_type, {_TEXT.format('list(user_id ORDER BY event_id)')} AS slice, {_TEXT.format('list(user_id ORDER BY event_id)')} AS array_list, {_TEXT.format('list_sort(list(DISTINCT user_id))')} AS users,
       {_TEXT.format('list_sort(list(DISTINCT user_id))')} AS hashed, {_TEXT.format('list_sort(list(DISTINCT user_id))')} AS tree, avg(user_id) AS average, arg_min(user_id, event_id) AS first, arg_max(user_id, event_id) AS last,
       list_reduce(list_prepend(1::BIGINT, list(user_id ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1009) AS reduced, {_TEXT.format('list_reverse_sort(list(user_id))[1:4]')} AS top, {_TEXT.format('list_sort(list(user_id))[1:4]')} AS bottom,
       list_sort(list(user_id))[(count(*) - 1) // 2 + 1] AS median, list_sort(list(user_id))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS high, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total
FROM events GROUP BY 1""")
def collectors(t: Tables):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    at = "event_id"
    return A.collect_to(
        t.events_in_order, joined(K.to_slice("user_id", at)).alias("slice"), joined(L.array_list_collector("user_id", at)).alias("array_list"), joined(F.array_sort(K.to_set("user_id"))).alias("users"),
        joined(F.array_sort(L.hash_set_collector("user_id"))).alias("hashed"), joined(L.tree_set_collector("user_id")).alias("tree"), K.averaging("user_id").alias("average"), K.first("user_id", at).alias("first"),
        K.last("user_id", at).alias("last"), K.reducing("user_id", F.lit(1).cast("bigint"), lambda a, x: (a * 31 + x) % 1009, at).alias("reduced"), joined(K.top_k("user_id", 4)).alias("top"),
        joined(K.bottom_k("user_id", 4)).alias("bottom"), K.median("user_id").alias("median"), K.percentile("user_id", 90).alias("high"), K.counting().alias("n"), K.summing("user_id").alias("total"), by=["event_type"],
    )


# --- rows, pairs and products


@query("SELECT event_type AS key, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total, arg_min(user_id, event_id) AS first FROM events GROUP BY 1")
def keys_and_pairs(t: Tables):
    s = _pairs(t)
    keys = T.keys(s).df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pairs = T.to_pairs(s)
    seen = T.peek2(T.peek(pairs, "rows", F.count(F.lit(1)).alias("n")), "again", F.count(F.lit(1)).alias("n"))
    firsts = seen.df.select(F.col("value.first").alias("key"), F.col("value.second").alias("v"), *pairs.order)
    return keys.join(firsts.groupBy("key").agg(F.sum("v").alias("total"), F.min_by("v", "event_id").alias("first")), "key")


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a, nation b")
def pairs_of_nations(t: Tables):
    """A product, which is what the operator is."""
    return C.cartesian_self(t.by("nation", "n_nationkey"), "n_name").df.select("first", "second")


@query("SELECT c_acctbal AS value, row_number() OVER (ORDER BY c_acctbal, src, key) - 1 AS place FROM (SELECT c_acctbal, 0 AS src, c_custkey AS key FROM customer UNION ALL SELECT s_acctbal, 1, s_suppkey FROM supplier)")
def merged_balances(t: Tables):
    one = lambda df, value, key: Ordered(df.select(F.col(value).alias("value"), F.col(value).alias("__v"), F.col(key).alias("__k")), ["__v", "__k"])
    merged = C.merge_sorted(one(t.customer, "c_acctbal", "c_custkey"), one(t.supplier, "s_acctbal", "s_suppkey"))
    return T.zip_with_index(merged, "place").df.select("value", "place")


@query("SELECT 'first' AS side, n_name AS value FROM nation UNION ALL SELECT 'second', CAST(n_regionkey AS VARCHAR) FROM nation")
def unzipped(t: Tables):
    s = Ordered(t.nation.select(F.col("n_name").alias("first"), F.col("n_regionkey").cast("string").alias("second"), "n_nationkey"), ["n_nationkey"])
    a, b = C.unzip(s)
    return a.df.select(F.lit("first").alias("side"), "value").unionByName(b.df.select(F.lit("second").alias("side"), "value"))


# --- effects, which act on the driver or the executors


@query("""
SELECT * FROM (SELECT 'each' AS kind, CAST(sum(n_nationkey) AS BIGINT) AS n FROM nation UNION ALL SELECT 'each2', CAST(sum(n_nationkey) AS BIGINT) FROM nation UNION ALL SELECT 'indexed', CAST(sum(n_nationkey * n_nationkey) AS BIGINT) FROM nation
 UNION ALL SELECT 'until', count(*) FROM nation WHERE n_nationkey < 7 UNION ALL SELECT 'indexed_until', count(*) FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 'parallel', CAST(sum(n_nationkey) AS BIGINT) FROM nation
 UNION ALL SELECT 'tried', count(*) FROM nation UNION ALL SELECT 'failed', 1 UNION ALL SELECT 'using', count(*) FROM nation UNION ALL SELECT 'within', count(*) FROM nation UNION ALL SELECT 'cancelled', 1
 UNION ALL SELECT 'collected', count(*) FROM nation UNION ALL SELECT 'empty', 1 UNION ALL SELECT 'not_empty', 1 UNION ALL SELECT 'reduced', CAST(sum(n_nationkey) AS BIGINT) FROM nation)""")
def effects(t: Tables):
    import threading

    s, found = t.by("nation", "n_nationkey"), {}
    def add(name, n=1):
        found[name] = found.get(name, 0) + n

    E.for_each(s, lambda r: add("each", r["n_nationkey"]))
    E.for_each2(s, lambda r: add("each2", r["n_nationkey"]))
    E.for_each_indexed(s, lambda i, r: add("indexed", i * r["n_nationkey"]))
    E.for_each_err(s, lambda r: ValueError("enough") if r["n_nationkey"] == 7 else add("until"))
    E.for_each_indexed_err(s, lambda i, r: ValueError("enough") if i == 9 else add("indexed_until"))
    total = t.spark.sparkContext.accumulator(0)
    E.parallel_for_each(s, lambda r: total.add(r["n_nationkey"]))
    add("parallel", total.value)
    ok, rows, _ = E.try_collect(s)
    add("tried", len(rows) if ok else 0)
    add("failed", int(not E.try_collect(s.with_df(s.df.withColumn("n_name", F.raise_error(F.lit("no")))))[0]))
    with E.using(s.df) as kept:
        add("using", kept.count())
    add("within", len(E.collect_within(s, lambda x: A.collect_ctx(x), seconds=600)))
    gone = threading.Event()
    gone.set()
    try:
        E.with_context(s, lambda x: x.collect(), done=gone)
    except E.ContextError as e:
        add("cancelled", int(e.unwrap() is None and "cancelled" in str(e)))
    add("collected", len(A.parallel_collect(s)))
    add("empty", int(A.is_empty(s.with_df(s.df.where("false")))))
    add("not_empty", int(A.is_not_empty(s)))
    add("reduced", A.parallel_reduce(s, F.sum("n_nationkey")).first()[0])
    return t.spark.createDataFrame([(k, int(v)) for k, v in found.items()], "kind string, n bigint")


@query("SELECT n_name, 4 AS concurrency, false AS ordered, 16 AS buffer, 32 AS chunk FROM nation")
def parallel_options(t: Tables):
    """Options change how rows are dealt and no result; those that are no number of at least one are left out."""
    config = P.with_chunk_size(P.with_buffer_size(P.with_ordered(P.with_concurrency(P.default_parallel_config(t.spark), 4), False), 16), 32)
    config = P.with_chunk_size(P.with_buffer_size(P.with_concurrency(config, 0), 0), 0)
    rows = P.prefetch(P.spread(t.by("nation", "n_nationkey"), config), 8)
    options = {"concurrency": config.concurrency, "ordered": config.ordered, "buffer": config.buffer_size, "chunk": config.chunk_size}
    return rows.df.select("n_name", *[F.lit(v).alias(k) for k, v in options.items()])


# --- times


@query("SELECT event_id, value, ts, true AS stamped, true AS now FROM events")
def timestamped(t: Tables):
    """Pace belongs to a stream's trigger: throttled rows are the rows, and a rate of none gives none."""
    rows = W.rate_limit_ctx(W.rate_limit(W.throttle_ctx(W.throttle(t.events, "1 second"), "1 second"), 5, "1 second"), 5)
    rows = rows.unionByName(W.rate_limit(t.events, 0))
    at, now = W.new_timestamped_at(F.col("value"), F.col("ts")), W.new_timestamped(F.col("value"))
    made = W.with_timestamp(rows.select("event_id", at.alias("at"), now.alias("now")), "seen")
    fresh = lambda c: c > F.lit("2020-01-01").cast("timestamp")
    return made.select("event_id", "at.value", F.col("at.ts").alias("ts"), fresh(F.col("seen")).alias("stamped"), fresh(F.col("now.ts")).alias("now"))
