"""Grid joins, ranks by counting and nearest rows against every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import joins as J
from loomfield.operators import ranking as R
from loomfield.operators import vectors as V

BOX = "image_id long, id long, x1 double, y1 double, x2 double, y2 double"


def boxes(rng, n):
    rows = []
    for i in range(n):
        x, y, size = rng.uniform(-50, 50), rng.uniform(-50, 50), 2 ** rng.uniform(-6, 9)
        rows.append((rng.randrange(2), i, x, y, x + size * rng.random(), y + size))
    odd = [(0, n, 0.0, 0.0, math.inf, 1.0), (0, n + 1, math.nan, 0.0, 1.0, 1.0), (0, n + 2, None, 0.0, 1.0, 1.0), (1, n + 3, 5.0, 5.0, 5.0, 5.0), (1, n + 4, 9.0, 9.0, 2.0, 2.0), (1, n + 5, -1e9, -1e9, 1e9, 1e9)]
    return rows + odd


def test_boxes_that_overlap(spark):
    rng = random.Random(1)
    a, b = boxes(rng, 150), boxes(rng, 200)
    frame = lambda rows: spark.createDataFrame(rows, BOX)
    got = [(r.image_id, r.a_id, r.b_id) for r in J.box_overlap_join(frame(a), frame(b)).collect()]
    fine = lambda r: all(v is not None and math.isfinite(v) for v in r[2:])
    want = [(p[0], p[1], q[1]) for p in a for q in b if fine(p) and fine(q) and p[0] == q[0] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]]
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert J.box_overlap_join(frame(a).limit(0), frame(b)).count() == 0 == J.box_overlap_join(frame(a), frame(b).limit(0)).count()


def test_points_in_turned_boxes(spark):
    rng = random.Random(2)
    points = [(rng.randrange(2), rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-2, 2)) for _ in range(400)] + [(0, None, 1.0, 1.0), (0, math.nan, 1.0, 1.0), (0, 0.0, 0.0, 0.0)]
    given = [(rng.randrange(3), i, rng.uniform(-20, 20), rng.uniform(-20, 20), 0.0, 2 ** rng.uniform(-3, 5), 2 ** rng.uniform(-3, 5), 3.0, rng.uniform(-4, 4)) for i in range(60)] + [(0, 60, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 61, None, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0)]
    p = spark.createDataFrame(points, "frame long, x double, y double, z double")
    b = spark.createDataFrame(given, "frame long, box_id long, cx double, cy double, cz double, dx double, dy double, dz double, heading double")

    def inside(q, g):
        if None in q or None in g or math.isnan(q[1]) or q[0] != g[0]:
            return False
        x, y, c, s = q[1] - g[2], q[2] - g[3], math.cos(g[8]), math.sin(g[8])
        return abs(x * c + y * s) <= g[5] / 2 and abs(-x * s + y * c) <= g[6] / 2 and abs(q[3] - g[4]) <= g[7] / 2

    got = {(r.frame, r.box_id): r.n_points for r in J.points_in_boxes(p, b).collect()}
    assert got == {(g[0], g[1]): sum(inside(q, g) for q in points) for g in given}
    assert sum(got.values()) > 100


@pytest.mark.parametrize("same_camera", [False, True])
def test_ranks_of_relevant_rows(spark, monkeypatch, same_camera):
    monkeypatch.setattr(R, "GALLERY_BLOCK", 30)
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "RELEVANT_CHUNK", 9)
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 9)), float(rng.randint(0, 9))], rng.choice(["a", "a", "b", "c", None]), rng.choice(["x", "y", None])) for i in range(200)]
    g = spark.createDataFrame(rows, "id long, v array<double>, label string, cam string")
    apart = lambda x, m: np.abs(m - x).sum(1)
    got = {(r.qid, r.gid): (r.label, r["rank"], r.hits, r.n_relevant) for r in R.relevant_ranks(g.where("id % 10 = 0"), g, apart, same_camera).collect()}
    want = {}
    for q in rows[::10]:
        others = [r for r in rows if r[0] != q[0] and not (same_camera and r[2] == q[2] is not None and r[3] == q[3] is not None)]
        if same_camera and q[2] is None:
            others = [r for r in others if r[0] != q[0]]
        others.sort(key=lambda r: (sum(abs(x - y) for x, y in zip(r[1], q[1])), r[0]))
        hits = [(rank, r) for rank, r in enumerate(others, 1) if r[2] == q[2] and q[2] is not None]
        for n, (rank, r) in enumerate(hits, 1):
            want[q[0], r[0]] = (q[2], rank, n, len(hits))
    assert got == want and len(want) > 500


def test_nearest_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "GALLERY_BLOCK", 40)
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(0, 30))]) for i in range(150)]
    g = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.qid, r["rank"], r.gid) for r in V.nearest_rows(g.where("id % 10 = 0"), g, lambda x, m: np.abs(m[:, 0] - x[0]), 7).collect())
    want = [(q[0], rank, r[0]) for q in rows[::10] for rank, r in enumerate(sorted((r for r in rows if r[0] != q[0]), key=lambda r: (abs(r[1][0] - q[1][0]), r[0]))[:7], 1)]
    assert got == want


def test_distances_over_the_largest_of_a_column(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (1, 0, 4.0), (0, 1, 0.0), (1, 1, 0.0)], "a_id long, b_id long, dist double")
    got = {(r.a_id, r.b_id): r.dist for r in V.column_normalized(d).collect()}
    assert got == pytest.approx({(0, 0): 0.25, (1, 0): 1.0, (0, 1): 0.0, (1, 1): 0.0})


def test_presets_of_models(spark):
    from loomfield.operators import predicates as P

    df = spark.createDataFrame([("H_Optimus_0", [0.707223, 0.578729, 0.703617]), ("other", [0.485, 0.456, 0.406]), (None, [0.485, 0.456, 0.406]), ("c_radio_v2", [0.5, 0.5, 0.5])], "model string, channels array<double>")
    assert all(r.normalised == pytest.approx([0, 0, 0]) for r in P.channel_normalize(df, model=F.col("model")).collect())
    assert P.model_preset("C_RADIO_V4") == "openai_clip" and P.model_preset("new") == "imagenet"
    assert P.channel_normalize(df, model="h_optimus_0").first().normalised == pytest.approx([0, 0, 0])
