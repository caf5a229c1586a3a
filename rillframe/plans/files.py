"""Writers and readers of text, CSV and TSV, one after the other, and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillframe.functions import result as R
from rillframe.operators import slicing as S
from rillframe.operators import transforms as T
from rillframe.ordered import Ordered
from rillframe.plans.registry import Tables, query
from rillframe.session import scratch
from rillframe.sources import collections as L
from rillframe.sources import memory as M
from rillframe.sources import text as X
from rillframe.streaming import windows as E


def _parts(t: Tables) -> Ordered:
    """Records with commas and quotes, a header first."""
    head = t.spark.range(1).select(F.array(F.lit("key"), F.lit("label")).alias("value"), F.lit(-1).cast("bigint").alias("__o"))
    rows = t.part.select(F.array(F.col("p_partkey").cast("string"), F.concat(F.lit('say "'), "p_type", F.lit('", '), "p_brand")).alias("value"), F.col("p_partkey").alias("__o"))
    return Ordered(head.unionByName(rows), ["__o"])


_LABEL = "'say \"' || p_type || '\", ' || p_brand"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS key, {_LABEL} AS label FROM part")
def csv_roundtrip(t: Tables):
    path = scratch(t.spark)
    X.to_csv_file(_parts(t), path)
    records = X.from_csv_with_header(t.spark, path)
    return records.df.select(X.record_get("record", "key").alias("key"), X.record_get("record", "label").alias("label"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier")
def tsv_roundtrip(t: Tables):
    path = scratch(t.spark)
    X.to_csv_file(Ordered(t.supplier.select(F.array(F.col("s_suppkey").cast("string"), "s_name").alias("value"), "s_suppkey"), ["s_suppkey"]), path, separator="\t")
    return X.from_tsv(t.spark, path).df.select(F.col("value")[0].alias("key"), F.col("value")[1].alias("name"))


_TEXT = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || p_brand WHEN 2 THEN '\"' || chr(10) || chr(10) || '\",' || p_type ELSE 'a \"\"' || chr(10) || '\"' END"


def _with_line_ends(t: Tables, separator: str) -> str:
    """A file of records whose fields hold line ends, blank lines, quotes and separators."""
    path, key = scratch(t.spark), F.col("p_partkey")
    text = F.expr(_TEXT.replace("chr(10)", "char(10)"))
    X.to_csv_file(Ordered(t.part.select(F.array(key.cast("string"), text, F.concat(F.lit(separator), "p_brand")).alias("value"), "p_partkey"), ["p_partkey"]), path, separator=separator)
    return path


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS key, {_TEXT} AS text, ',' || p_brand AS brand FROM part")
def csv_line_ends(t: Tables):
    return X.from_csv(t.spark, _with_line_ends(t, ",")).df.select(F.col("value")[0].alias("key"), F.col("value")[1].alias("text"), F.col("value")[2].alias("brand"))


@query(f"SELECT true AS ok, CAST(p_partkey AS VARCHAR) AS key, {_TEXT} AS text, chr(9) || p_brand AS brand FROM part")
def tsv_err_line_ends(t: Tables):
    return X.from_tsv_err(t.spark, _with_line_ends(t, "\t")).df.select("ok", F.col("value")[0].alias("key"), F.col("value")[1].alias("text"), F.col("value")[2].alias("brand"))


@query("SELECT s_suppkey % 10 <> 3 AS ok, count(*) AS n FROM supplier GROUP BY 1")
def csv_errors(t: Tables):
    """Every tenth record has a field too many."""
    path = scratch(t.spark)
    fields = F.when(F.col("s_suppkey") % 10 == 3, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    X.to_csv_file(Ordered(t.supplier.select(fields.alias("value"), "s_suppkey"), ["s_suppkey"]), path)
    return X.from_csv_err(t.spark, path).df.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM supplier WHERE s_suppkey < (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 10 = 3)")
def csv_until_error(t: Tables):
    path = scratch(t.spark)
    fields = F.when(F.col("s_suppkey") % 10 == 3, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    X.to_csv_file(Ordered(t.supplier.select(fields.alias("value"), "s_suppkey"), ["s_suppkey"]), path)
    return X.from_csv(t.spark, path).df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS value, n_nationkey::BIGINT AS place FROM nation")
def lines_roundtrip(t: Tables):
    path = scratch(t.spark)
    X.to_file(t.by("nation", "n_nationkey"), path, F.col("n_name"))
    return T.zip_with_index(X.from_lines(t.spark, path), "place").df.select("value", "place")


@query("SELECT CAST(b AS SMALLINT) AS value, count(*) AS n FROM (SELECT unnest(list_transform(range(1, strlen(n_name) + 1), lambda i: ascii(substr(n_name, i, 1)))) AS b FROM nation) GROUP BY 1")
def bytes_of_text(t: Tables):
    return X.from_bytes(t.nation, "n_name").df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_nationkey AS value FROM customer")
def sorted_set(t: Tables):
    one = t.customer.agg(F.collect_set("c_nationkey").alias("xs"))  # a nation's key at most once
    return L.from_sorted_set(one, "xs").df.select("value")


@query("SELECT n_name AS key, n_regionkey AS value FROM nation")
def sorted_map(t: Tables):
    one = t.nation.agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_regionkey"))).alias("m"))
    return L.from_sorted_map(one, "m").df.select("key", "value")


@query("SELECT event_type AS key, arg_min(user_id, event_id) AS value FROM events GROUP BY 1")
def distinct_keys(t: Tables):
    s = Ordered(t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), "event_id"), ["event_id"])
    return S.distinct_keys(s).df.select("key", "value")


@query("SELECT arg_min(event_type, event_id) AS key, user_id AS value FROM events GROUP BY 2")
def distinct_values(t: Tables):
    s = Ordered(t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), "event_id"), ["event_id"])
    return S.distinct_values(s).df.select("key", "value")


@query("SELECT i * i AS value FROM range(0, 1000) r(i) UNION ALL SELECT 7 FROM range(0, 5)")
def generate_and_repeat(t: Tables):
    return M.generate(t.spark, 1000, lambda i: i * i).df.select("value").unionByName(M.repeat(t.spark, 7, 5).df.select(F.col("value").cast("bigint").alias("value")))


@query("SELECT 'late' AS outcome, 3::BIGINT AS n UNION ALL SELECT 'kept', 2")
def results_of_values(t: Tables):
    s = M.from_results(t.spark, [(True, 1, None), (False, None, "late"), (False, None, "late"), (True, 2, None), (False, None, "late")])
    kept = R.filter_ok(s).df.agg(F.lit("kept").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return kept.unionByName(R.filter_errs(s).df.agg(F.lit("late").alias("outcome"), F.count(F.lit(1)).alias("n")))


@query("SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) WHERE next IS NULL OR next > ts + INTERVAL 1 DAY")
def debounce_by_user(t: Tables):
    return E.debounce(t.events, "1 day", by=["user_id"]).select("event_id")
