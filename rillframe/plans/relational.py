"""Joins, aggregates and groups over the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillframe.functions import collectors as C
from rillframe.operators import aggregates as A
from rillframe.operators import grouping as G
from rillframe.operators import joins as J
from rillframe.operators import slicing as S
from rillframe.ordered import Ordered
from rillframe.plans.registry import Tables, query


@query("""
SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY total DESC LIMIT 3""")
def segment_revenue(t: Tables):
    """The flagship: filter, join, aggregate by key, top-k."""
    orders = t.orders.where(F.col("o_orderdate") >= F.expr("timestamp_ntz'1995-01-01'")).select("o_custkey", "o_totalprice")
    joined = orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    sums = joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return S.top_k(Ordered(sums, ["segment"]), 3, "total")


def _orders(t: Tables) -> Ordered:
    return Ordered(t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), ["value"])


def _rich(t: Tables) -> Ordered:
    """Customers with a balance over 5000."""
    return Ordered(t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")), ["key"])


_O = "(SELECT o_custkey AS key, o_orderkey AS value FROM orders)"
_R = "(SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_acctbal > 5000)"


@query(f"SELECT l.key, l.value AS \"left\", r.value AS \"right\" FROM {_O} l JOIN {_R} r ON l.key = r.key")
def inner_join(t: Tables):
    return J.inner_join(_orders(t), _rich(t))


@query(f"SELECT l.key, l.value AS \"left\", r.value AS \"right\", r.key IS NOT NULL AS has_right FROM {_O} l LEFT JOIN {_R} r ON l.key = r.key")
def left_join(t: Tables):
    return J.left_join(_orders(t), _rich(t))


@query(f"SELECT r.key, l.value AS \"left\", r.value AS \"right\", l.key IS NOT NULL AS has_left FROM {_R} l RIGHT JOIN {_O} r ON l.key = r.key")
def right_join(t: Tables):
    return J.right_join(_rich(t), _orders(t))


_F = "(SELECT o_custkey AS key, o_orderkey AS value FROM orders WHERE o_totalprice > 200000)"


@query(f"SELECT coalesce(l.key, r.key) AS key, coalesce(l.value, -1) AS \"left\", r.value AS \"right\", l.key IS NOT NULL AS has_left, r.key IS NOT NULL AS has_right FROM {_F} l FULL JOIN {_R} r ON l.key = r.key")
def full_join(t: Tables):
    big = Ordered(t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), ["value"])
    return J.full_join(big, _rich(t)).withColumn("left", F.coalesce("left", F.lit(-1)))


@query(f"SELECT l.key, l.value AS \"left\", CASE WHEN r.key IS NULL THEN 'none' ELSE r.value END AS \"right\" FROM {_O} l LEFT JOIN {_R} r ON l.key = r.key")
def left_join_with(t: Tables):
    return J.left_join_with(_orders(t), _rich(t), "none")


@query(f"SELECT r.key, CASE WHEN l.key IS NULL THEN 'none' ELSE l.value END AS \"left\", r.value AS \"right\" FROM {_R} l RIGHT JOIN {_O} r ON l.key = r.key")
def right_join_with(t: Tables):
    return J.right_join_with(_rich(t), _orders(t), "none")


@query(f"SELECT key, value FROM {_O} l WHERE EXISTS (SELECT 1 FROM {_R} r WHERE r.key = l.key)")
def semi_join(t: Tables):
    return J.semi_join(_orders(t), _rich(t))


@query(f"SELECT key, value FROM {_O} l WHERE NOT EXISTS (SELECT 1 FROM {_R} r WHERE r.key = l.key)")
def anti_join(t: Tables):
    return J.anti_join(_orders(t), _rich(t))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def semi_join_by(t: Tables):
    return J.semi_join_by(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 49"), "o_orderkey", "l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_by(t: Tables):
    return J.anti_join_by(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey")


@query("SELECT s_suppkey AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_by(t: Tables):
    return J.join_by(t.supplier.select("s_suppkey", "s_nationkey"), t.nation, "s_nationkey", "n_nationkey").select(F.col("first.s_suppkey").alias("supplier"), F.col("second.n_name").alias("nation"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_by(t: Tables):
    return J.left_join_by(t.documents.select("doc_id"), t.labels, "doc_id", "doc_id").select("first.doc_id", F.coalesce("second.quality", F.lit(-1)).alias("quality"))


@query("""
SELECT coalesce(l.key, r.key) AS key, coalesce(l.vals, '') AS "left", coalesce(r.vals, '') AS "right"
FROM (SELECT s_nationkey AS key, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS vals FROM supplier GROUP BY 1) l
FULL JOIN (SELECT c_nationkey AS key, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS vals FROM customer WHERE c_acctbal > 9000 GROUP BY 1) r ON l.key = r.key""")
def cogroup(t: Tables):
    left = Ordered(t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("value")), ["value"])
    right = Ordered(t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("value")), ["value"])
    both = J.co_group(left, right)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return both.select("key", text("left"), text("right"))


# aggregates


@query("SELECT l_returnflag AS key, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def reduce_by_key(t: Tables):
    s = Ordered(t.lineitem.select(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("value")), ["value"])
    return G.reduce_by_key(s, F.sum("value").cast("bigint"))


@query("SELECT event_type AS key, CAST(100 + sum(event_id % 7) AS BIGINT) AS value FROM events GROUP BY 1")
def reduce_by_key_with_init(t: Tables):
    s = Ordered(t.events.select(F.col("event_type").alias("key"), (F.col("event_id") % 7).alias("value"), "event_id"), ["event_id"])
    return G.reduce_by_key_with_init(s, F.lit(100).cast("bigint"), lambda a, x: a + x)


@query("SELECT user_id AS key, list_reduce(list(event_id % 10 ORDER BY event_id), lambda a, x: (a * 3 + x) % 1000) AS value FROM events GROUP BY 1")
def fold_by_key(t: Tables):
    """A merge that isn't associative, in order."""
    s = Ordered(t.events.select(F.col("user_id").alias("key"), (F.col("event_id") % 10).alias("value"), "event_id"), ["event_id"])
    return G.fold_by_key(s, lambda a, x: (a * 3 + x) % 1000)


@query("SELECT o_orderpriority AS key, count(*) AS count FROM orders GROUP BY 1")
def count_by(t: Tables):
    return G.count_by(t.by("orders", "o_orderkey"), "o_orderpriority")


@query("SELECT l_linenumber AS value, count(*) AS count FROM lineitem GROUP BY 1")
def frequencies(t: Tables):
    return G.frequencies(t.by("lineitem", "l_orderkey"), "l_linenumber")


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def most_common(t: Tables):
    return G.most_common(t.by("part", "p_partkey"), 5, "p_brand")


@query("SELECT count(*) AS count, CAST(sum(o_custkey) AS BIGINT) AS sum, min(o_custkey) AS min, max(o_custkey) AS max, CAST(sum(o_custkey) AS DOUBLE) / count(*) AS average FROM orders")
def statistics(t: Tables):
    return A.get_statistics(t.by("orders", "o_orderkey"), "o_custkey")


@query("SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem")
def min_max(t: Tables):
    return A.min_max(t.by("lineitem", "l_orderkey"), "l_extendedprice")


@query("SELECT min(l_shipdate) AS min FROM lineitem WHERE false")
def min_of_none(t: Tables):
    return A.min_value(Ordered(t.lineitem.where("false").select(F.col("l_shipdate").alias("value")), ["value"]))


@query("SELECT max(c_acctbal) AS max FROM customer")
def max_value(t: Tables):
    return A.max_value(t.by("customer", "c_custkey"), "c_acctbal")


@query("SELECT round(avg(l_extendedprice * (1 - l_discount)), 4) AS average FROM lineitem")
def average_by(t: Tables):
    out = A.average_by(t.by("lineitem", "l_orderkey"), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return out.select(F.round("average", 4).alias("average"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS sum FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def sum_by(t: Tables):
    some = t.lineitem.where("l_discount between 0.05 and 0.07 and l_quantity < 24")
    return A.sum_by(Ordered(some, ["l_orderkey"]), F.col("l_extendedprice") * F.col("l_discount")).select(F.round("sum", 2).alias("sum"))


@query("SELECT CAST(0 AS BIGINT) AS sum")
def sum_of_none(t: Tables):
    return A.sum_(Ordered(t.events.where("false"), ["event_id"]), "user_id")


@query("SELECT round(product(1 + s_acctbal / 1000000), 8) AS product FROM supplier")
def product(t: Tables):
    return A.product(t.by("supplier", "s_suppkey"), 1 + F.col("s_acctbal") / 1000000).select(F.round("product", 8).alias("product"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1")
def min_by(t: Tables):
    return A.min_by(t.by("supplier", "s_suppkey"), "s_acctbal").select("s_suppkey", "s_name")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def max_by(t: Tables):
    """First on ties."""
    return A.max_by(t.by("part", "p_partkey"), "p_size").select("p_partkey", "p_size")


@query("SELECT user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def to_map_last(t: Tables):
    return G.to_map(t.events_in_order, "user_id")


@query("SELECT user_id AS key, max(event_id) AS event_id FROM events GROUP BY 1")
def associate_by(t: Tables):
    return G.associate_by(t.events_in_order, "user_id").select("key", F.col("value.event_id").alias("event_id"))


def _quantile_sql(q: float) -> str:
    return f"SELECT l[CAST(floor({q} * (len(l) - 1)) AS BIGINT) + 1] AS value FROM (SELECT list_sort(list(l_extendedprice)) AS l FROM lineitem)"


@query(_quantile_sql(0.25))
def quantile_25(t: Tables):
    return A.quantile(t.by("lineitem", "l_orderkey"), 0.25, "l_extendedprice")


@query(_quantile_sql(0.5))
def median(t: Tables):
    return A.median(t.by("lineitem", "l_orderkey"), "l_extendedprice")


@query(_quantile_sql(0.75))
def quantile_75(t: Tables):
    return A.quantile(t.by("lineitem", "l_orderkey"), 0.75, "l_extendedprice")


@query(_quantile_sql(0.0075))
def percentile(t: Tables):
    """p from 0 to 100."""
    return A.percentile(t.by("lineitem", "l_orderkey"), 0.75, "l_extendedprice")


@query("SELECT l_returnflag AS flag, l[CAST(floor(0.9 * (len(l) - 1)) AS BIGINT) + 1] AS q90 FROM (SELECT l_returnflag, list_sort(list(l_quantity)) AS l FROM lineitem GROUP BY 1)")
def quantile_by_group(t: Tables):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(C.quantile("l_quantity", 0.9).alias("q90"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t: Tables):
    return S.top_k(Ordered(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"]), 10, "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom_k(t: Tables):
    return S.bottom_k(Ordered(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"]), 10, "o_totalprice")


@query("""
SELECT c_nationkey, c_custkey, CAST(rank AS INTEGER) AS rank FROM
(SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3""")
def top_k_by_group(t: Tables):
    return S.top_k_by_group(t.by("customer", "c_custkey"), ["c_nationkey"], 3, "c_acctbal").select("c_nationkey", "c_custkey", "rank")


@query("SELECT count(*) AS count FROM lineitem")
def count(t: Tables):
    return A.count(t.by("lineitem", "l_orderkey"))


@query("SELECT (SELECT bool_or(l_quantity >= 50) FROM lineitem) AS any_, (SELECT bool_and(l_quantity > 0) FROM lineitem) AS all_, (SELECT NOT bool_or(l_tax > 1) FROM lineitem) AS none_, true AS none_of_none")
def matches(t: Tables):
    s = t.by("lineitem", "l_orderkey")
    none = s.with_df(s.df.where("false"))
    one = lambda df, name: df.withColumnRenamed("value", name)
    parts = [one(A.any_match(s, F.col("l_quantity") >= 50), "any_"), one(A.all_match(s, F.col("l_quantity") > 0), "all_"), one(A.none_match(s, F.col("l_tax") > 1), "none_"), one(A.none_match(none, F.lit(True)), "none_of_none")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])  # four rows of one


@query("SELECT bool_or(event_type = 'click') AS value FROM events")
def contains(t: Tables):
    return A.contains(t.events_in_order, "click", "event_type")


@query("SELECT list_reduce(list_prepend(1::BIGINT, list(event_id ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) AS value FROM events")
def fold(t: Tables):
    return A.fold(t.events_in_order, F.lit(1).cast("bigint"), lambda a, x: (a * 31 + x) % 1000003, "event_id")


@query("SELECT list_reduce(list(event_id ORDER BY event_id), lambda a, x: (a * 7 + x) % 10007) AS value FROM events")
def reduce_optional(t: Tables):
    return A.reduce_optional(t.events_in_order, lambda a, x: (a * 7 + x) % 10007, "event_id")



# groups and collectors


@query("SELECT c_nationkey AS key, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS values FROM customer GROUP BY 1")
def group_by(t: Tables):
    out = G.group_by(t.by("customer", "c_custkey"), "c_nationkey", "c_custkey")
    return out.select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("values"))


@query("SELECT length(n_name) AS key, string_agg(n_name, ',' ORDER BY n_nationkey) AS values FROM nation GROUP BY 1")
def histogram(t: Tables):
    out = G.histogram(t.by("nation", "n_nationkey"), F.length("n_name").cast("bigint"), "n_name")
    return out.select("key", F.array_join("values", ",").alias("values"))


@query("SELECT string_agg(r_name, '-' ORDER BY r_regionkey) AS value FROM region")
def joining(t: Tables):
    return G.joining(t.by("region", "r_regionkey"), "-", value="r_name")


@query("SELECT '[' || ltrim(string_agg(CASE WHEN n_nationkey < 3 THEN '' ELSE n_name END, '/' ORDER BY n_nationkey), '/') || ']' AS value FROM nation")
def joining_collector(t: Tables):
    """Leading empty strings lose their separators."""
    return A.collect_to(t.by("nation", "n_nationkey"), C.joining(F.when(F.col("n_nationkey") < 3, F.lit("")).otherwise(F.col("n_name")), "n_nationkey", "/", "[", "]").alias("value"))


@query("SELECT o_totalprice > 150000 AS side, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY 1")
def partition_by(t: Tables):
    yes, no = G.partition_by(t.by("orders", "o_orderkey"), F.col("o_totalprice") > 150000)
    one = lambda s, side: s.df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))
    return one(yes, True).unionByName(one(no, False))


@query("SELECT round(sum(l_extendedprice) / count(*), 4) AS ratio FROM lineitem")
def teeing(t: Tables):
    return A.collect_to(t.by("lineitem", "l_orderkey"), F.round(C.teeing(C.summing("l_extendedprice"), C.counting(), lambda a, b: a / b), 4).alias("ratio"))


@query("SELECT l_shipdate_year AS year, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_quantity) AS most FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year FROM lineitem) GROUP BY 1")
def filtering_collector(t: Tables):
    s = Ordered(t.lineitem.withColumn("year", F.year("l_shipdate")), ["l_orderkey"])
    return A.collect_to(s, C.filtering(F.col("l_returnflag") == "R", F.count, "l_orderkey").alias("returned"), F.max("l_quantity").alias("most"), by=["year"])


@query("SELECT round(sum(sqrt(p_retailprice)), 4) AS value FROM part")
def mapping_collector(t: Tables):
    return A.collect_to(t.by("part", "p_partkey"), F.round(C.mapping(F.sqrt, F.sum, "p_retailprice"), 4).alias("value"))


@query("SELECT CAST(count(*) AS INTEGER) AS words FROM (SELECT unnest(string_split(p_type, ' ')) FROM part)")
def flat_mapping_collector(t: Tables):
    return A.collect_to(t.by("part", "p_partkey"), C.flat_mapping(F.split("p_type", " "), F.size).alias("words"))


@query("SELECT count(*) FILTER (n_regionkey = 1) AS yes, count(*) FILTER (n_regionkey <> 1) AS no FROM nation")
def partitioning_by(t: Tables):
    out = A.collect_to(t.by("nation", "n_nationkey"), C.partitioning_by("n_name", F.col("n_regionkey") == 1, "n_nationkey").alias("p"))
    return out.select(F.size("p.true").cast("bigint").alias("yes"), F.size("p.false").cast("bigint").alias("no"))


@query("SELECT p_brand AS key, CAST(sum(p_size) AS BIGINT) AS value FROM part GROUP BY 1")
def to_map_merging(t: Tables):
    return C.to_map_merging(t.by("part", "p_partkey"), "p_brand", F.sum("p_size"))


@query("SELECT c_nationkey AS nation, arg_max(c_custkey, c_acctbal) AS richest, arg_min(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY 1")
def extremes_by_group(t: Tables):
    s = t.by("customer", "c_custkey")
    out = A.collect_to(s, C.max_by("c_custkey", "c_acctbal", "c_custkey").alias("richest"), C.min_by("c_custkey", "c_acctbal", "c_custkey").alias("poorest"), by=["c_nationkey"])
    return out.withColumnRenamed("c_nationkey", "nation")


@query("SELECT DISTINCT o_orderstatus AS value FROM orders")
def to_set(t: Tables):
    from rillframe.sources.collections import to_hash_set

    return to_hash_set(t.by("orders", "o_orderkey"), "o_orderstatus").withColumnRenamed("o_orderstatus", "value")


@query("SELECT c_nationkey AS value FROM customer UNION SELECT s_nationkey FROM supplier")
def union(t: Tables):
    from rillframe.sources import collections as L

    return L.union(t.customer.select(F.col("c_nationkey").alias("value")), t.supplier.select(F.col("s_nationkey").alias("value")))


@query("SELECT c_custkey AS value FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def intersect(t: Tables):
    from rillframe.sources import collections as L

    return L.intersection(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("value")), t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("value")))


@query("SELECT c_custkey AS value FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def difference(t: Tables):
    from rillframe.sources import collections as L

    return L.difference(t.customer.select(F.col("c_custkey").alias("value")), t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("value")))
