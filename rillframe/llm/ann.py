"""Approximate nearest neighbours by cosine: a vantage-point tree for each shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.vectors import Best, rows_of, search

LEAF = 64
#: The share of the bound that a side's distance must exceed to be left out: 1 is exact, less is faster and finds less.
FACTOR = 0.2


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def build_tree(x: np.ndarray, leaf: int = LEAF, seed: int = 1) -> list:
    """Nodes as (vantage point, radius, inner child, outer child) or (points,), the root last; distances are between unit vectors."""
    u, rng, nodes = unit(x), np.random.default_rng(seed), []

    def build(points):
        if len(points) <= leaf:
            nodes.append((points,))
            return len(nodes) - 1
        v = points[rng.integers(len(points))]
        rest = points[points != v]
        d = np.sqrt(np.maximum(2 - 2 * (u[rest] @ u[v]), 0))
        radius = float(np.median(d))
        inner = d <= radius
        if inner.all():  # many alike: split anywhere, both sides hold the distance
            inner = np.arange(len(rest)) < len(rest) // 2
        a, b = build(rest[inner]), build(rest[~inner])
        nodes.append((int(v), float(d[inner].max()), float(d[~inner].min()), a, b))
        return len(nodes) - 1

    build(np.arange(len(x)))
    return nodes


def search_tree(block: dict, shard: dict, k: int, factor: float) -> Best:
    (nodes, x), q = shard["made"], unit(block["x"])
    if x.shape[1] < q.shape[1]:
        x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
    best = Best(len(q), k)

    def look(of, points):
        score = np.round(q[of] @ x[points].T, 12)  # so that alike vectors tie wherever they stand
        score[block["row"][of][:, None] == shard["row"][points]] = -np.inf
        best.add(of, score, shard["id"][points], points)

    def visit(node, of):
        if not len(of):
            return
        if len(nodes[node]) == 1:
            look(of, nodes[node][0])
            return
        v, inner, outer, a, b = nodes[node]
        look(of, np.array([v]))
        d = np.sqrt(np.maximum(2 - 2 * (q[of] @ x[v]), 0))
        near = d <= (inner + outer) / 2
        visit(a, of[near])
        visit(b, of[~near])
        reach = factor * np.sqrt(np.maximum(2 - 2 * np.maximum(best.worst(of), -1), 0)) + 1e-6  # cosines of alike vectors are 1 but for rounding
        visit(b, of[near & (outer - d <= reach)])
        visit(a, of[~near & (d - inner <= reach)])

    visit(len(nodes) - 1, np.arange(len(q)))
    return best


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision; alike for alike vectors wherever they stand."""
    # scaled by powers of two, so that squares neither overflow nor vanish and no digit changes
    a, b = (x * np.exp2(-np.floor(np.log2(np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)))) for x in (a, b))
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def nearest(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine that each query finds among all other rows, nearest first, ties to smaller keys.

    Queries are the rows whose key is divisible by `every`. Vectors that are null, zero, or hold null or non-finite components take no part.
    A shorter vector counts as padded with zeros. Rows of one key are told apart: each is a candidate for the others. A null key is no query
    and comes last in ties. An empty table gives no rows. factor 1 finds all; less may miss some, scores are exact either way.
    """
    rows = rows_of(df, key, vector, nonzero=True)

    def find(block, shard, k):
        best = search_tree(block, shard, k + 3, factor)
        q, i = best.found()
        c = best.place[q, i]
        score = _exact(block["x"][q], shard["x"][c]) if len(q) else np.zeros(0)
        by = np.lexsort((shard["id"][c], -score, q))
        q, c, score = q[by], c[by], score[by]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], c[first], score[first]

    return search(rows, rows.where(F.col("id") % every == 0), k, lambda x: (build_tree(x), unit(x)), lambda x: None, find, "double")
