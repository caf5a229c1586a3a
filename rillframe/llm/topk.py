"""Exact top-k by integer inner product: cover trees over queries and data, walked together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.vectors import Best, rows_of, search

LEAF = 64
#: A child's ball is smaller than its parent's by this factor.
SHRINK = 1.3


def _wide(x: np.ndarray) -> np.ndarray:
    """The rows with numbers so large that doubles would round a product of two rows."""
    return np.flatnonzero(np.abs(x).max(1, initial=0) * max(x.shape[1], 1) ** 0.5 > 2.0**26)


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> list[tuple]:
    """Nodes (centre, covering radius, children, points): each point of a node is within the radius of the centre; the root is first.

    Wide rows are left out: they are multiplied one by one, as whole numbers.

    A ball is covered by balls of a radius smaller by SHRINK around points of its own. What such balls hold by ones and twos is gathered in
    leaves, whose radius is measured, so a tree in many dimensions doesn't fall apart into single points.
    """
    nodes: list = []

    def add(centre, points):
        d = np.sqrt(((x[points] - x[centre]) ** 2).sum(1)) if len(points) else np.zeros(0)
        radius = float(d.max(initial=0.0))
        me = len(nodes)
        nodes.append(None)
        if len(points) <= leaf or radius == 0:
            nodes[me] = (centre, radius, (), points)
            return me
        children, few, left = [], [], points
        while len(left):
            if len(left) <= leaf:
                few.append(left)
                break
            c = left[0]
            near = np.sqrt(((x[left] - x[c]) ** 2).sum(1)) <= radius / SHRINK
            ball, left = left[near], left[~near]
            if len(ball) < leaf // 4 or len(ball) == len(points):
                few.append(ball)
            else:
                children.append(add(c, ball))
        rest = np.concatenate(few) if few else np.zeros(0, np.int64)
        for a in range(0, len(rest), leaf):
            part = rest[a : a + leaf]
            children.append(add(part[0], part))
        nodes[me] = (centre, radius, tuple(children), points[:0])
        return me

    own = np.setdiff1d(np.arange(len(x)), _wide(x))
    if len(own):
        add(own[0], own)
    return nodes


def search_trees(block: dict, shard: dict, k: int) -> Best:
    """All queries against all points; a pair of nodes is left out if its bound is below each query's kth score, here or in the shards before."""
    q, x = block["x"], shard["x"]
    best = Best(len(q), k, block.get("least"))
    tq, tx = block["made"], shard["made"]
    nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    under: dict[int, np.ndarray] = {}

    def members(node):
        if node not in under:
            _, _, children, points = tq[node]
            under[node] = np.concatenate([points, *[members(c) for c in children]]) if children else points
        return under[node]

    def bound(a, b):
        (ca, ra, _, _), (cb, rb, _, _) = tq[a], tx[b]
        return q[ca] @ x[cb] + ra * nx[cb] + rb * nq[ca] + ra * rb + 1e-12 * (nq[ca] + ra) * (nx[cb] + rb) + 1e-6

    stack = [(0, 0)] if tq and tx else []
    while stack:
        a, b = stack.pop()
        if bound(a, b) < best.worst(members(a)).min():
            continue
        (_, ra, below_a, pa), (_, rb, below_b, pb) = tq[a], tx[b]
        if below_b and (rb >= ra or not below_a):
            stack += sorted(((a, c) for c in below_b), key=lambda p: bound(*p))  # the best is taken first
        elif below_a:
            stack += [(c, b) for c in below_a]
        else:
            score = q[pa] @ x[pb].T
            score[block["row"][pa][:, None] == shard["row"][pb]] = -np.inf
            best.add(pa, score, shard["id"][pb], pb)
    wide_q, wide_x = _wide(q), _wide(x)
    if len(wide_q) or len(wide_x):
        _add_wide(best, block, shard, wide_q, wide_x)
    return best


def _add_wide(best: Best, block: dict, shard: dict, wide_q: np.ndarray, wide_x: np.ndarray) -> None:
    """Products with wide rows, as whole numbers of any size: of wide queries with all points, of the others with wide points."""
    numbers = lambda row: [int(v) for v in row.tolist()]
    k, alone = best.place.shape[1], set(wide_q.tolist())
    points = {}
    for i in range(len(block["x"])) if len(wide_x) else wide_q.tolist():
        pool = np.arange(len(shard["x"])) if i in alone else np.concatenate([best.place[i][best.place[i] >= 0], wide_x])
        own, scores = numbers(block["x"][i]), {}
        for j in pool[shard["row"][pool] != block["row"][i]].tolist():
            if j not in points:
                points[j] = numbers(shard["x"][j])
            scores[j] = min(max(sum(a * b for a, b in zip(own, points[j], strict=True)), -(2**63)), 2**63 - 1)
        order = sorted(scores, key=lambda j: (-scores[j], shard["id"][j]))[:k]
        best.place[i], best.score[i] = -1, -np.inf
        best.place[i, : len(order)], best.score[i, : len(order)] = order, 0


def top_products(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * component) with all other rows, ties to smaller keys.

    Queries are the rows whose key is divisible by `every`. Vectors that are null or hold null or non-finite components take no part; a
    shorter one counts as padded with zeros. Rows of one key are told apart. A null key is no query and comes last in ties. Scores beyond 64
    bits are cut to the nearest 64-bit number. An empty table gives no rows.
    """
    whole = df.withColumn("__scaled", F.transform(F.col("`" + vector.replace("`", "``") + "`"), lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), c.cast("double")).otherwise(_floor(c, scale))))
    rows = rows_of(whole, key, "__scaled", nonzero=False)

    def find(block, shard, k):
        best = search_trees(block, shard, k)
        q, i = best.found()
        c = best.place[q, i]
        a, b = block["x"][q], shard["x"][c]
        exact = np.einsum("ij,ij->i", a, b) if len(q) else np.zeros(0)
        sizes = np.einsum("ij,ij->i", np.abs(a), np.abs(b)) if len(q) else exact
        large = sizes >= 2.0**52
        score = np.where(large, 0, exact).astype(np.int64)
        score[large] = [min(max(sum(int(u) * int(v) for u, v in zip(r, t, strict=True)), -(2**63)), 2**63 - 1) for r, t in zip(a[large], b[large], strict=True)]
        return q, c, score

    return search(rows, rows.where(F.col("id") % every == 0), k, cover_tree, cover_tree, find, "bigint")


def _floor(c, scale: float):
    """floor as a double, which has no limit of 64 bits; from 2**52 on, doubles are whole anyway."""
    y = c.cast("double") * scale
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
