"""Neighbours and ranks on a line, and blocks in files, against brute force."""

import math
import random

import numpy as np
import pytest

from loomfield.functions import blocks as B
from loomfield.operators import ranking as R
from loomfield.operators import vectors as V


def values(kind, rng, n):
    if kind == "cents":
        return [round(rng.uniform(0, 20), 2) for _ in range(n)]
    if kind == "ties":
        return [float(rng.randint(0, 6)) for _ in range(n)]
    if kind == "rounded":  # distances from the large ones are rounded to the same
        return [rng.choice([1e16, 1e16 + 2, 3e16, rng.uniform(0, 3), rng.uniform(-3, 3), 0.0, -0.0]) for _ in range(n)]
    return [rng.choice([None, math.nan, math.inf, -math.inf, float(rng.randint(0, 3))]) for _ in range(n)]


def far(x, y):
    d = abs((math.nan if y is None else y) - (math.nan if x is None else x))
    return (math.isnan(d), 0.0 if math.isnan(d) else d)


@pytest.mark.parametrize("kind", ["cents", "ties", "rounded", "odd"])
def test_a_block_on_a_line(kind):
    rng = random.Random(7)
    for n in (0, 1, 5, 60, 300):
        ys, ids = values(kind, rng, n), rng.sample(range(2 * n + 1), n)
        if n > 5:
            ids[0] = ids[1]  # an id may stand in several rows
        rows = sorted(zip(ys, ids, strict=True), key=lambda r: (r[0] is None or math.isnan(r[0]), 0.0 if r[0] is None or math.isnan(r[0]) else r[0], r[1]))
        y, i = np.array([math.nan if a is None else a for a, _ in rows], float), np.array([b for _, b in rows], np.int64)
        line = B.Line(y, i)
        queries = [(rng.choice(ids), v) if ids else (0, v) for v in values(kind, rng, 25) + ys[:25]]
        qid, x = np.array([q for q, _ in queries]), np.array([math.nan if v is None else v for _, v in queries], float)
        for k in (1, 4, 20):
            found, d, gid = B.best(k, *line.nearest(qid, x, k))
            for at, (q, v) in enumerate(queries):
                want = sorted((far(v, a), b) for a, b in rows if b != q)[:k]
                got = [((math.isnan(e), 0.0 if math.isnan(e) else e), int(b)) for e, b, ok in zip(d[at], gid[at], found[at], strict=True) if ok]
                assert got == want
        asked = [(v, a, b) for _, v in queries for a, b in rows[:40]]
        if asked:
            number = lambda v: math.nan if v is None else v
            xs, ds = np.array([number(v) for v, _, _ in asked]), np.array([abs(number(a) - number(v)) for v, a, _ in asked])
            got = line.nearer(xs, ds, np.array([b for _, _, b in asked]))
            for place, (v, a, b) in zip(got, asked, strict=True):
                assert place == sum((far(v, c), e) < (far(v, a), b) for c, e in rows)


@pytest.mark.parametrize("same_camera", [False, True])
@pytest.mark.parametrize("kind", ["cents", "ties", "odd"])
def test_ranks_and_neighbours_on_a_line(spark, monkeypatch, kind, same_camera):
    for module, name, n in ((R, "LINE_BLOCK", 50), (R, "LINE_PAIRS", 300), (V, "LINE_BLOCK", 50), (V, "LINE_QUERIES", 7)):
        monkeypatch.setattr(module, name, n)
    rng = random.Random(8)
    ys = values(kind, rng, 200)
    rows = [(i, [y], rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", None])) for i, y in enumerate(ys)]
    g = spark.createDataFrame(rows, "id long, v array<double>, label string, cam string")
    got = {(r.qid, r.gid): (r.label, r["rank"], r.hits, r.n_relevant) for r in R.relevant_ranks(g.where("id % 10 = 0"), g, B.line_distance, same_camera).collect()}
    want = {}
    for q in rows[::10]:
        others = [r for r in rows if r[0] != q[0] and not (same_camera and None not in (q[2], q[3]) and r[2:] == q[2:])]
        others.sort(key=lambda r: (far(q[1][0], r[1][0]), r[0]))
        hits = [(rank, r) for rank, r in enumerate(others, 1) if r[2] == q[2] and q[2] is not None]
        want |= {(q[0], r[0]): (q[2], rank, n, len(hits)) for n, (rank, r) in enumerate(hits, 1)}
    assert got == want and len(want) > 300
    near = V.nearest_rows(g.where("id % 10 = 0"), g, B.line_distance, 7)
    got = sorted((r.qid, r["rank"], r.gid) for r in near.collect())
    assert got == [(q[0], rank, r[0]) for q in rows[::10] for rank, r in enumerate(sorted((r for r in rows if r[0] != q[0]), key=lambda r: (far(q[1][0], r[1][0]), r[0]))[:7], 1)]
    assert V.nearest_rows(g, g.limit(0), B.line_distance, 3).count() == 0 == R.relevant_ranks(g.limit(0), g, B.line_distance).count()


@pytest.mark.parametrize("held", [0, 1 << 17])
def test_products_of_pairs_and_nearest_vectors_from_files(spark, monkeypatch, held):
    for name, n in (("HELD", held), ("PAIRS", 50), ("GALLERY_BLOCK", 11), ("QUERY_BLOCK", 9)):
        monkeypatch.setattr(V, name, n)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 63, (400, 2))]
    got = V._dots(spark.createDataFrame([(*p, 1.5) for p in pairs], "qid long, gid long, m double"), B.Blocks(vectors.selectExpr("vec_id id", "embedding v"), "id", 11, ["id"]))
    assert sorted(map(tuple, got.collect())) == sorted((a, b, 1.5, float(x[a] @ x[b])) for a, b in pairs if max(a, b) < 60)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 9)
    for skip in (False, True):
        top = V.knn_topk_join(vectors.where("vec_id % 5 = 0"), vectors, 15, skip_own=skip)
        assert "Exchange hashpartitioning(qid" not in top._jdf.queryExecution().toString()
        want = {(q, r): g for q in range(0, 60, 5) for r, (_, g) in enumerate(sorted((-s, g) for g, s in enumerate(sims[q]) if not (skip and g == q))[:15], 1)}
        assert {(r.qid, r["rank"]): r.gid for r in top.collect()} == want


def test_rerank_shuffles_no_vectors(spark):
    rows = [(i, np.random.default_rng(i).random(3).tolist()) for i in range(40)]
    plan = V.k_reciprocal_rerank(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k1=8, k2=3)._jdf.queryExecution().toString()
    assert "embedding" not in plan and "array<double>" not in plan
