"""Queries of vectors, matching and comparison over the driver's tables; where SQL can't say it, the tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.common import read_table
from loomfield.operators import detection as D
from loomfield.operators import ranking as R
from loomfield.operators import vectors as V
from loomfield.plans.aggregates import rounded
from loomfield.plans.joins import boxes
from loomfield.plans.ranking import _mask
from loomfield.plans.registry import Plans

plans = Plans()
QUERIES, SQL, query = plans.QUERIES, plans.SQL, plans.query
c = F.col


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings")


_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS k FROM e)"
_SIMS = f"{_E}, s AS (SELECT q.vec_id AS qid, g.vec_id AS gid, g.label, round(list_inner_product(q.v, g.v) / (q.k * g.k), 9) AS sim FROM n q, n g WHERE q.vec_id % 100 = 0 AND g.vec_id <> q.vec_id)"


def _neighbours(spark, sf, k=20):
    v = _vectors(spark, sf)
    return V.knn_topk_join(v.where("vec_id % 100 = 0"), v, k, skip_own=True)


@query(f"{_SIMS} SELECT qid, gid, sim, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, gid) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def knn_topk_join(spark, sf):
    return _neighbours(spark, sf)


@query(f"{_SIMS}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, gid) <= 20), v AS (SELECT qid, label, sum(exp(sim / 0.07)) AS v FROM t GROUP BY ALL), p AS (SELECT qid, label FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC, label) = 1) SELECT round(avg(CASE WHEN p.label = e.label THEN 100.0 ELSE 0 END), 9) AS acc FROM p JOIN e ON p.qid = e.vec_id")
def knn_accuracy(spark, sf):
    v = _vectors(spark, sf)
    named = _neighbours(spark, sf).join(v.select(c("vec_id").alias("gid"), "label"), "gid")
    pred = R.knn_vote(named.select("qid", "label", "sim")).join(v.select(c("vec_id").alias("qid"), "label"), "qid")
    return rounded(pred.agg(F.avg(F.when(c("pred") == c("label"), 100.0).otherwise(0.0)).alias("acc")))


for _metric, _sql in {"sqeuclid": "greatest(list_inner_product(q.v, q.v) + list_inner_product(g.v, g.v) - 2 * list_inner_product(q.v, g.v), 0)", "angle": "acos(greatest(least(list_inner_product(q.v, g.v) / (q.k * g.k), 1.0), -1.0))", "chord": "sqrt(greatest(2 - 2 * list_inner_product(q.v, g.v) / (q.k * g.k), 0)) / 2"}.items():

    def _dist(spark, sf, metric=_metric):
        v = _vectors(spark, sf)
        return V.distance_matrix(v.where("vec_id % 100 = 0"), v, metric).where("a_id <> b_id").withColumn("dist", F.round("dist", 6))

    query(f"{_E} SELECT q.vec_id AS a_id, g.vec_id AS b_id, round({_sql}, 6) AS dist FROM n q, n g WHERE q.vec_id % 100 = 0 AND g.vec_id <> q.vec_id", name="distance_matrix" if _metric == "sqeuclid" else f"distance_matrix_{_metric}")(_dist)


@query("WITH u AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE label < 5) SELECT a.d - 1 AS i, b.d - 1 AS j, count(*) AS n, round(covar_samp(a.x, b.x), 8) AS cov FROM u a JOIN u b USING (vec_id) GROUP BY ALL")
def feature_mean_cov(spark, sf):
    stats = V.feature_mean_cov(_vectors(spark, sf).withColumn("m", c("label") < 5), "embedding", mask="m")
    d = F.size("mean")
    return stats.select("n", d.alias("d"), F.posexplode("cov").alias("p", "x")).select(F.floor(c("p") / c("d")).cast("long").alias("i"), (c("p") % c("d")).cast("long").alias("j"), "n", F.round("x", 8).alias("cov"))


@query("WITH u AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT d, avg(x) AS m, var_samp(x) AS v FROM u GROUP BY 1), k AS (SELECT 1 / sqrt(avg(v)) AS a FROM s) SELECT vec_id, round(max(a * (x - m)), 5) AS largest, round(sum(a * (x - m) * a * (x - m)), 5) AS energy FROM u JOIN s USING (d), k GROUP BY 1")
def whiten_fit_apply(spark, sf):
    w = V.whiten_fit_apply(_vectors(spark, sf), "embedding", rotate=False)
    return w.select("vec_id", F.round(F.array_max("whitened"), 5).alias("largest"), F.round(F.aggregate("whitened", F.lit(0.0), lambda s, x: s + x * x), 5).alias("energy"))


@query("WITH u AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT d, avg(x) AS m, var_samp(x) AS v FROM u GROUP BY 1), k AS (SELECT 1 / sqrt(avg(v)) AS a FROM s) SELECT vec_id, round(sum(a * (x - m) * a * (x - m)), 5) AS energy FROM u JOIN s USING (d), k GROUP BY 1")
def whiten_rotate(spark, sf):
    w = V.whiten_fit_apply(_vectors(spark, sf), "embedding")  # a rotation keeps lengths
    return w.select("vec_id", F.round(F.aggregate("whitened", F.lit(0.0), lambda s, x: s + x * x), 5).alias("energy"))


_TAN = """WITH u AS (SELECT vec_id, unnest(v) / sqrt(list_inner_product(v, v)) AS x, generate_subscripts(v, 1) AS d FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)), m AS (SELECT d, avg(x) AS m FROM u GROUP BY 1), p AS (SELECT d, m / (SELECT sqrt(sum(m * m)) FROM m) AS p FROM m),
k AS (SELECT vec_id, greatest(least(sum(x * p), 1), -1) AS cos FROM u JOIN p USING (d) GROUP BY 1), s AS (SELECT vec_id, d, x - cos * p AS side, cos FROM u JOIN p USING (d) JOIN k USING (vec_id)), l AS (SELECT vec_id, sqrt(sum(side * side)) AS len FROM s GROUP BY 1), t AS (SELECT vec_id, d, acos(cos) * side / len AS t FROM s JOIN l USING (vec_id)), a AS (SELECT d, avg(t) AS a FROM t GROUP BY 1)
SELECT vec_id, round(sum((t - a) * (t - a)), 5) AS energy FROM t JOIN a USING (d) GROUP BY 1"""


@query(_TAN)
def tangent_map(spark, sf):
    return V.tangent_map(_vectors(spark, sf), "embedding").select("vec_id", F.round(F.aggregate("tangent", F.lit(0.0), lambda s, x: s + x * x), 5).alias("energy"))


@query()
def k_reciprocal_rerank(spark, sf):
    return rounded(V.k_reciprocal_rerank(_vectors(spark, sf)), 6)


def _matching(spark, sf):
    b = boxes(spark, sf)
    return b.where("side = 0").withColumn("care", c("id") % 5 != 0), b.where("side = 1")


@query()
def greedy_match(spark, sf):
    return D.greedy_match(*_matching(spark, sf))


@query()
def soft_nms(spark, sf):
    return rounded(D.soft_nms(boxes(spark, sf).withColumn("score", (c("id") % 997) / 997.0)))


@query()
def coco_ap(spark, sf):
    gt, dt = _matching(spark, sf)
    gt = gt.withColumns({"category_id": (c("image_id") % 3).cast("long"), "iscrowd": (c("id") % 29 == 0).cast("int")}).drop("care")
    return rounded(D.coco_ap(gt, dt.withColumns({"category_id": (c("image_id") % 3).cast("long"), "score": (c("id") % 997) / 997.0})))


@query("""WITH d AS (SELECT l_returnflag AS class, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS id, l_extendedprice AS score, CASE WHEN l_quantity > 20 AND l_discount < 0.06 THEN 1 ELSE 0 END AS tp FROM lineitem), n AS (SELECT class, sum(tp) + 500 AS n_gt FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER w AS rank, sum(tp) OVER w AS cum FROM d WINDOW w AS (PARTITION BY class ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)), e AS (SELECT class, cum, tp, max(cum / rank) OVER (PARTITION BY class ORDER BY score, id DESC ROWS UNBOUNDED PRECEDING) AS env FROM r),
p AS (SELECT class, i, greatest(CAST(ceil(i * n_gt / 40) AS BIGINT), 1) AS cum FROM n, unnest(generate_series(0, 40)) t(i)), h AS (SELECT p.class, i, coalesce(env, 0) AS p FROM p LEFT JOIN (SELECT * FROM e WHERE tp = 1) x ON p.class = x.class AND p.cum = x.cum)
SELECT class, round(sum(p) FILTER (i % 4 = 0) / 11 * 100, 8) AS ap11, round(sum(p) FILTER (i > 0) / 40 * 100, 8) AS ap40 FROM h GROUP BY 1""")
def kitti_ap(spark, sf):
    dets = read_table(spark, sf, "lineitem").select(c("l_returnflag").alias("class"), (c("l_orderkey") * 1000000 + c("l_partkey") * 100 + c("l_linenumber")).alias("id"), c("l_extendedprice").alias("score"), F.when((c("l_quantity") > 20) & (c("l_discount") < 0.06), 1).otherwise(0).alias("tp"))
    return rounded(D.kitti_ap(dets, dets.groupBy("class").agg((F.sum("tp") + 500).alias("n_gt"))), 8)


@query()
def kitti_frames_ap(spark, sf):
    b = boxes(spark, sf).withColumn("class", F.element_at(F.array(*map(F.lit, ("Car", "Pedestrian", "Van", "DontCare", "Cyclist"))), (c("image_id") % 5 + 1).cast("int")))
    gt = b.where("side = 0").withColumns({"occluded": c("id") % 3, "truncated": (c("id") % 7) / 10})
    dt = b.where("side = 1").withColumns({"score": (c("id") % 997) / 997.0, "class": F.when(c("class") == "Van", "Car").otherwise(c("class"))})
    return rounded(D.kitti_frames_ap(gt, dt, ("car", "pedestrian", "cyclist"), min_overlap=0.5, difficulty=2))


@query()
def mask_morphology(spark, sf):
    return D.mask_morphology(_mask(spark, sf), open_k=3, close_k=5)


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice * CASE WHEN o_orderkey % 13 = 0 THEN 1.01 ELSE 1.0000001 END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AS seen, a.o_orderstatus = b.o_orderstatus AS s, abs(a.o_totalprice - b.o_totalprice) <= 1e-5 * greatest(abs(a.o_totalprice), abs(b.o_totalprice)) AS p FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT k AS o_orderkey, 'o_orderstatus' AS "column", seen AND coalesce(s, false) AS ok FROM j UNION ALL SELECT k, 'o_totalprice', seen AND coalesce(p, false) FROM j""")
def parity_compare(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    other = o.where("o_orderkey % 5 <> 0").withColumns({"o_orderstatus": F.when(c("o_orderkey") % 11 == 0, "X").otherwise(c("o_orderstatus")), "o_totalprice": c("o_totalprice") * F.when(c("o_orderkey") % 13 == 0, 1.01).otherwise(1.0000001)})
    return D.parity_compare(o.where("o_orderkey % 7 <> 0"), other, ["o_orderkey"]).drop("detail")
