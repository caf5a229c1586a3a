"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from rillframe.llm.common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.quality import classify_quality

    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), PIECES)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.secrets import scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.ngram_join import join_similar

    return join_similar(_table(spark, sf_dir, "documents"), width=3, per_cent=90)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.langid import identify_language

    return identify_language(_table(spark, sf_dir, "documents"))


#: A public vocabulary; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.pieces import encode_sampled

    return encode_sampled(_table(spark, sf_dir, "documents"), PIECES, keep=["doc_id"])


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillframe.llm.suffix import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS random
  FROM documents),
sources AS (
  SELECT absent, name, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY absent, encode(name)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY absent, name),
filled AS (
  SELECT *, sum(3 * source_size) OVER o AS limits, sum(weight) OVER o AS weights, 3 * source_size / weight AS full_at
  FROM sources WINDOW o AS (ORDER BY 3 * source_size / weight, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
totals AS (SELECT sum(source_size) AS words, sum(weight) AS weight FROM sources),
steps AS (
  SELECT f.full_at, f.absent, f.name, CAST(t.words - coalesce(f.limits, 0) AS DOUBLE) AS rest, CAST(t.weight - coalesce(f.weights, 0) AS DOUBLE) AS left_weight
  FROM filled f, totals t),
level AS (SELECT rest, left_weight FROM steps WHERE rest / left_weight < full_at ORDER BY full_at, absent, name LIMIT 1),
goals AS (
  SELECT s.absent, s.name, s.source_size, coalesce(least(CAST(3 * s.source_size AS DOUBLE), s.weight * l.rest / l.left_weight), CAST(3 * s.source_size AS DOUBLE)) AS target
  FROM sources s LEFT JOIN level l ON true),
placed AS (
  SELECT z.doc_id, z.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         coalesce(sum(z.size) OVER (PARTITION BY z.absent, z.name ORDER BY z.random, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized z JOIN goals g ON z.absent = g.absent AND z.name = g.name)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
OP7_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM texts),
grams AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT r, r AS other FROM sets UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach ON reach.r = s.r JOIN sets o ON o.r = reach.other GROUP BY s.r
"""
OP10_SQL = r"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT r, h, len(h) // 2 AS n FROM texts),
parts AS (SELECT r, n, c, substr(h, 2 * c + 1, 2 * 1199) AS p FROM (SELECT r, h, n, unnest(range(0, n - 199, 1000)) AS c FROM sized WHERE n >= 200)),
strings AS MATERIALIZED (SELECT r, c + i AS pos, md5(substr(p, 2 * i + 1, 400)) AS s FROM (SELECT r, c, p, unnest(range(0, least(1000, n - 199 - c))) AS i FROM parts)),
again AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
starts AS (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 200 THEN 0 ELSE 1 END AS fresh FROM strings JOIN again USING (s)),
runs AS (SELECT r, min(pos) AS a, max(pos) + 200 AS b FROM (SELECT r, pos, sum(fresh) OVER (PARTITION BY r ORDER BY pos) AS run FROM starts) GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (SELECT g.r, string_agg(substr(h, 2 * g.a + 1, 2 * (coalesce(g.b, len(h) // 2) - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN texts t ON t.r = g.r GROUP BY g.r),
counts AS (SELECT r, sum(b - a) AS gone, count(*) AS n FROM runs GROUP BY r)
SELECT doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN counts c ON c.r = t.r LEFT JOIN kept k ON k.r = t.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_lm": op3_lm,
    "op4_nearest": op4_nearest,
    "op5_secrets": op5_secrets,
    "op6_topk": op6_topk,
    "op7_ngram_join": op7_ngram_join,
    "op8_language": op8_language,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_suffix": op10_suffix,
}
ORACLES = {"op1_mixing": OP1_SQL, "op6_topk": OP6_SQL, "op7_ngram_join": OP7_SQL, "op10_suffix": OP10_SQL}
