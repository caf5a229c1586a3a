"""The pipeline's stages, one after another, and the queries' registration."""

import collections
import re

import corpus_pipeline
import pytest

import __spark_entry__ as entry


def test_registered():
    names = [m[1] for q in entry.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(map(int, names)) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, small), name)
        if name != "pieces":
            assert out.columns == columns
        kept[name] = {r.doc_id: r for r in out.collect()}
        if name == "mixture":
            words = lambda df: collections.Counter(w for r in df.collect() for w in [r.source] * len(re.findall(r"[^\x20\x09-\x0D]+", r.text)))
            before, after = words(docs), words(out)
            assert abs(sum(before.values()) - sum(after.values())) <= len(before) and all(after[s] <= 3 * before[s] for s in before)
        docs = out
    assert set(kept["near_duplicates"]) <= set(kept["quality"]) and set(kept["secrets"]) == set(kept["near_duplicates"])
    assert all(r.lossless for r in kept["pieces"].values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept["quality"] for i in good) >= 0.95 * len(good)


def test_stages_of_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows, empty tables, and columns whose names the operators use themselves."""
    spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        rows, empty = out.collect(), stage(spark, none, str(tmp_path)).collect()
        assert empty == [] and rows
        if name == "pieces":
            assert len(rows) == odd.count() and all(r.lossless for r in rows) and all(r.n_pieces == 0 for r in rows if r.doc_id in (0, 1))
            continue
        assert out.columns == odd.columns
        ids = [r.doc_id for r in rows]
        if name == "near_duplicates":
            assert {0, 1, 2} <= set(ids) and sorted(i for i in ids if i in (3, 4, 5, 6)) == [3, 5] and ids.count(None) == 1
        if name == "secrets":
            assert len(rows) == odd.count() and all(r.text is not None for r in rows)
        if name == "mixture":
            assert not {0, 1, 2} & set(ids)


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "source", "ids", "n_pieces", "lossless"}


@pytest.mark.parametrize("name", ["op1_mixing", "op6_topk", "op7_ngram_join", "op10_suffix"])
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())
