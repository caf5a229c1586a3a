"""The registered queries over whole tables, against brute force, exact round trips or held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest

from test_documents import BASE, brute_spans, crc, tokens

from rillframe.llm.queries import PIECES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows(spark, small, name):
    return QUERIES[name](spark, small).collect()


def test_op2(spark, small, docs):
    got = rows(spark, small, "op2_quality")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.85 * len(held)


def test_op2_model_equals_plain_ridge_and_isotonic(spark):
    """Sums over partitions give what one matrix of all rows gives."""
    from rillframe.llm.quality import N_STATS, fit_quality
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, N_STATS)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.standard_normal(300) > 0).astype(float)
    frame = spark.createDataFrame([(v.tolist(), float(t), i % 5) for i, (v, t) in enumerate(zip(x, y, strict=True))], "stats array<float>, label double, fold int").repartition(7)
    model = fit_quality(frame, F.col("fold") == 4, n_features=24)
    own = np.arange(300) % 5 != 4
    a = x[own].astype(float)
    scale = a.std(0)
    z = model.features(x[own])
    assert np.allclose(model.mean, a.mean(0), atol=1e-5) and np.allclose(model.scale, scale, atol=1e-4)
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + 1e-6 * own.sum() * np.eye(z.shape[1]), z.T @ y[own]), rtol=1e-3, atol=1e-4)
    assert (np.diff(model.levels) > 0).all()
    # isotonic: no other non-decreasing sequence of block means is nearer
    bins = np.clip(((model.raw(x[~own]) + 0.5) / 2 * 512).astype(int), 0, 511)
    some = np.unique(bins)
    n, good = np.bincount(bins)[some], np.bincount(bins, y[~own])[some]
    low = [max(good[i : j + 1].sum() / n[i : j + 1].sum() for i in range(k + 1) for j in [min(range(k, len(some)), key=lambda j: good[i : j + 1].sum() / n[i : j + 1].sum())]) for k in range(len(some))]
    assert np.allclose(model.levels, np.clip(np.array(low) * (1 - 1e-4) + 1e-4 * (some + 0.5) / 512, 0, 1), atol=1e-9)


def test_op3(spark, small, docs):
    got = rows(spark, small, "op3_lm")
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.n_tokens == len(tokens(docs[r.doc_id].text)) + 1 and r.held_out == (crc(r.doc_id, 5) == 1) and r.score < 0 for r in got)


def test_op4(spark, small):
    """Recall against brute force on the table, with exact scores."""
    table = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in rows(spark, small, "op4_nearest"):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = all_ = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        order = sorted((k for k in range(len(ids)) if k != q), key=lambda k: (-round(score[k], 12), ids[k]))[:5]
        mine = sorted(found[ids[q]])
        assert [n for n, _, _ in mine] == list(range(1, len(order) + 1)) and all(abs(score[np.flatnonzero(ids == v)[0]] - s) < 1e-9 for _, v, s in mine)
        hit += sum(s >= score[order[-1]] - 1e-9 for _, _, s in mine)
        all_ += len(order)
    assert hit >= 0.95 * all_


def test_op5(spark, small, docs):
    for r in rows(spark, small, "op5_secrets"):
        base = brute_spans(docs[r.doc_id].text or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k, _, _ in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("novel")] == base and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op8(spark, small, docs):
    got = rows(spark, small, "op8_language")
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op8_equals_a_naive_pass():
    """Probabilities of a text from the recurrences, byte by byte."""
    from rillframe.llm.langid import MARGIN, STRETCH, ByteNetwork, stretches

    net = ByteNetwork.fresh(["a", "b", "c"], 5, 3)
    data = np.frombuffer(("héllo wörld, " * 40).encode(), np.uint8)
    offsets = np.array([0, 7, 7, len(data)])
    got = net.pooled(data, *stretches(offsets), 3)
    want, h, p = np.zeros((3, 3)), 5, {k: v.astype(float) for k, v in net.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for t in range(3):
        a, b = offsets[t], offsets[t + 1]
        for s in range(a, b, STRETCH):
            e = min(s + STRETCH, b)
            low, high = max(a, s - MARGIN), min(b, e + MARGIN)
            states = {}
            for side, order in (("f", range(low, high)), ("b", range(high - 1, low - 1, -1))):
                now = np.zeros(h)
                for i in order:
                    now = step(p, side, data[i], now, h, sigmoid)
                    states[side, i] = now
            for i in range(s, e):
                z = p["o"][:, :h] @ states["f", i] + p["o"][:, h:] @ states["b", i] + p["ob"][:, 0]
                want[t] += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(got, want, rtol=1e-3)


def step(p, side, byte, state, h, sigmoid):
    fed = p[f"x{side}"][byte]
    gates = sigmoid(fed[: 2 * h] + p[f"u{side}"] @ state)
    z, r = gates[:h], gates[h:]
    new = np.tanh(fed[2 * h :] + p[f"c{side}"] @ (r * state))
    return z * state + (1 - z) * new


def test_op9(spark, small, docs):
    from rillframe.llm.pieces import decode

    got = decode(QUERIES["op9_sentencepiece"](spark, small), PIECES).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.lossless and r.decoded == (docs[r.doc_id].text or "") for r in got)
