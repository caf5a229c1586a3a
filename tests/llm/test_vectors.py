"""Vector searches against brute force, with odd vectors."""

import numpy as np
import pytest


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, v, 0, f"x{i}") for i, v in zip(ids, vectors, strict=True)], "vec_id bigint, embedding array<float>, label int, row string").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 16))
    x = (centres[rng.integers(0, 8, 700)] + 0.6 * rng.standard_normal((700, 16))).astype(np.float32)
    ids = list(range(700))
    rows = [v.tolist() for v in x]
    rows[3], rows[50], rows[51], rows[100], rows[150], rows[7] = None, [0.0] * 16, rows[52], [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] * 16
    rows[200] = rows[201] = rows[202] = rows[203]
    rows[300] = rows[300][:9]
    return [*ids, 250, 250, None], [*rows, rows[251], rows[252], rows[253]]


def ok(v, nonzero):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and (not nonzero or any(v))


def brute(ids, rows, k, every, score, nonzero):
    good = [(i, np.pad(np.array(v, np.float64), (0, 16 - len(v)))) for i, v in zip(ids, rows, strict=True) if ok(v, nonzero)]
    out = []
    for n, (i, q) in enumerate(good):
        if i is not None and i % every == 0:
            found = sorted(((-score(q, v), j is None, j or 0) for m, (j, v) in enumerate(good) if m != n))[:k]
            out.append((i, [(None if null else j, -s) for s, null, j in found]))
    return out


def lists(got):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in by.items()}


def cosine(a, b):
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def test_nearest_exact(spark, vectors, monkeypatch):
    from rillframe.llm import ann, vectors as V

    monkeypatch.setattr(V, "SHARD", 150)
    monkeypatch.setattr(ann, "LEAF", 8)
    got = lists(ann.nearest(table(spark, *vectors), factor=1.0).collect())
    for i, want in brute(*vectors, 5, 50, cosine, True):
        if i == 250:
            continue  # three rows of one key
        assert [round(s, 9) for _, _, s in got[i]] == [round(s, 9) for _, s in want]
        assert {v for _, v, s in got[i] if s > want[-1][1] + 1e-9} == {j for j, s in want if s > want[-1][1] + 1e-9}
    assert len(got[250]) == 15
    assert ann.nearest(table(spark, [], [])).collect() == []


def test_nearest_recall(spark):
    from rillframe.llm.ann import nearest

    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    got = lists(nearest(table(spark, range(4000), [v.tolist() for v in x])).collect())
    hits = sum(len({v for _, v, _ in got[i]} & {j for j, _ in want}) for i, want in brute64(x))
    assert hits >= 0.9 * 5 * 80


def brute64(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for i in range(0, len(x), 50):
        s = u @ u[i]
        s[i] = -9
        yield i, [(int(j), s[j]) for j in np.argsort(-s)[:5]]


def test_top_products(spark, vectors, monkeypatch):
    from rillframe.llm import topk, vectors as V

    monkeypatch.setattr(V, "SHARD", 150)
    monkeypatch.setattr(topk, "LEAF", 8)
    got = lists(topk.top_products(table(spark, *vectors)).collect())
    for i, want in brute(*vectors, 5, 50, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)), False):
        if i == 250:
            continue
        assert [(v, s) for _, v, s in got[i]] == want
    assert got[50][0][2] == 0 and len(got[250]) == 15
    assert topk.top_products(table(spark, [], [])).collect() == []


def test_top_products_of_large_numbers(spark):
    from rillframe.llm.topk import top_products

    rows = [[3e7, -2e7], [1e9, 5.5], [-1e9, 1e9], [3e30, 1.0], [0.25, 0.5]]
    got = lists(top_products(table(spark, range(5), rows)).collect())
    scaled = [[int(np.floor(256 * float(np.float32(c)))) for c in r] for r in rows]
    want = sorted(((-min(max(sum(a * b for a, b in zip(scaled[0], v, strict=True)), -(2**63)), 2**63 - 1), j) for j, v in enumerate(scaled) if j))
    assert [(v, s) for _, v, s in got[0]] == [(j, -s) for s, j in want]


def test_large_numbers_cost_only_their_rows(spark, monkeypatch):
    """Wide rows among others: the others are still pruned, and all is exact."""
    from rillframe.llm import topk

    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[50], x[7], x[301] = 1e9 * x[50], 1e12, -1e12
    scaled = [[int(np.floor(256 * float(c))) for c in r] for r in x]
    made, real = [], topk._add_wide
    monkeypatch.setattr(topk, "_add_wide", lambda best, block, shard, a, b: made.append((len(a), len(b))) or real(best, block, shard, a, b))
    body = {"x": np.array(scaled, float), "row": np.arange(400), "id": np.arange(400)}
    queries = np.arange(0, 400, 50)
    block = {"x": body["x"][queries], "row": queries, "id": queries, "made": topk.cover_tree(body["x"][queries])}
    best = topk.search_trees(block, body | {"made": topk.cover_tree(body["x"])}, 5)
    assert made == [(1, 3)]
    for n, i in enumerate(queries):
        cut = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        want = sorted((-cut(sum(a * b for a, b in zip(scaled[i], v, strict=True))), j) for j, v in enumerate(scaled) if j != i)[:5]
        assert best.place[n].tolist() == [j for _, j in want]


def test_nearest_among_many_equal(spark):
    """Of more equal vectors than a query asks for, those of the smallest keys."""
    from rillframe.llm.ann import nearest

    rng = np.random.default_rng(4)
    kinds = rng.standard_normal((3, 33)).astype(np.float32)
    x = kinds[rng.integers(0, 3, 900)]
    got = lists(nearest(table(spark, range(900), [v.tolist() for v in x]), factor=1.0).collect())
    for i in range(0, 900, 50):
        same = [j for j in range(900) if j != i and (x[j] == x[i]).all()][:5]
        assert [v for _, v, _ in got[i]] == same


def assert_nothing_joined(df):
    """Blocks times shards as a side of a join looks as small as the blocks and would be broadcast by way of the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_nearest_sends_nothing_by_the_driver(spark, vectors, monkeypatch):
    """Several groups of several shards, and several blocks."""
    from rillframe.llm import ann, vectors as V

    monkeypatch.setattr(V, "SHARD", 12)
    monkeypatch.setattr(V, "BLOCK", 4)
    df = ann.nearest(table(spark, *vectors), factor=1.0)
    assert_nothing_joined(df)
    got = lists(df.collect())
    for i, want in brute(*vectors, 5, 50, cosine, True):
        if i != 250:
            assert [round(s, 9) for _, _, s in got[i]] == [round(s, 9) for _, s in want]
            assert {v for _, v, s in got[i] if s > want[-1][1] + 1e-9} == {j for j, s in want if s > want[-1][1] + 1e-9}
    assert len(got[250]) == 15
    monkeypatch.setattr(V, "HELD", 1)  # a shard for each group
    again = lists(ann.nearest(table(spark, *vectors), factor=1.0).collect())
    assert {i: [(n, s) for n, _, s in x] for i, x in again.items()} == {i: [(n, s) for n, _, s in x] for i, x in got.items()}


def test_top_products_send_nothing_by_the_driver(spark, vectors, monkeypatch):
    """Several groups of several shards, and several blocks."""
    from rillframe.llm import topk, vectors as V

    monkeypatch.setattr(V, "SHARD", 12)
    monkeypatch.setattr(V, "BLOCK", 4)
    df = topk.top_products(table(spark, *vectors))
    assert_nothing_joined(df)
    got = lists(df.collect())
    for i, want in brute(*vectors, 5, 50, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)), False):
        if i != 250:
            assert [(v, s) for _, v, s in got[i]] == want
    assert len(got[250]) == 15


def test_shards_use_the_scores_before():
    """What is below a query's kth score is left out; what ties with it, large and negative too, is found."""
    from rillframe.llm import topk

    x, q = np.repeat([[1e5, 0.0], [1e5, 1.0]], 100, 0), np.array([[-1e5, 0.0]])
    shard = {"x": x, "row": np.arange(200), "id": np.arange(200), "made": topk.cover_tree(x)}
    block = {"x": q, "row": np.array([999]), "id": np.array([999]), "made": topk.cover_tree(q)}
    for least, found in ((-1e10, [0, 1, 2, 3, 4]), (-1e10 + 1, [-1] * 5)):
        assert topk.search_trees(block | {"least": np.array([least])}, shard, 5).place[0].tolist() == found
