"""Queries of the aggregations and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.common import read_table
from loomfield.operators import aggregates as A
from loomfield.operators import predicates as P
from loomfield.plans.predicates import QC_SQL, STATUS_SQL, _files, raw_samples
from loomfield.plans.registry import Plans

plans = Plans()
QUERIES, SQL, query = plans.QUERIES, plans.SQL, plans.query
c = F.col


def rounded(df, digits=9):
    """Doubles rounded, since their sums depend on the order of the terms."""
    return df.select(*(F.round(n, digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes))


@query("SELECT md5(text) AS md5, count(*) AS count FROM documents GROUP BY 1")
def hash_counts(spark, sf):
    return A.hash_counts(read_table(spark, sf, "documents"), "text")


@query("""WITH s AS (SELECT user_id AS key, CASE WHEN event_id % 11 = 0 THEN 'H & E' WHEN event_id % 7 = 0 THEN 'h&e' ELSE event_type END AS stain FROM events WHERE event_id % 13 <> 0)
SELECT key, count(*) AS slide_count, count(*) FILTER (regexp_matches(stain, '[hH](&|\\s*&?\\s*[eE])')) AS he_slides, array_to_string(list_sort(list(DISTINCT stain)), ';') AS stains FROM s GROUP BY 1""")
def slide_index(spark, sf):
    stain = F.when(c("event_id") % 11 == 0, "H & E").when(c("event_id") % 7 == 0, "h&e").otherwise(c("event_type"))
    name = F.concat(F.when(c("event_id") % 13 == 0, "notes_").otherwise("case_"), "user_id", F.lit("_slide_"), stain, F.lit("_"), c("event_id") % 9)
    slides = read_table(spark, sf, "events").select(c("user_id").alias("key"), name.alias("name"))
    return A.slide_index(slides).select("key", "slide_count", "he_slides", F.concat_ws(";", "stain_types").alias("stains"))


@query("SELECT l_suppkey AS key, count(*) AS bad_rows FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def bad_counts(spark, sf):
    return A.bad_counts(read_table(spark, sf, "lineitem").where("l_discount > 0.05").select(c("l_suppkey").alias("key")))


def _bad(spark, sf):
    return read_table(spark, sf, "events").where("event_type = 'error' OR value > 40").select(c("event_type").alias("category"), (c("user_id") % 7).cast("string").alias("dataset"), (c("event_id") % 400).alias("filepath"))


@query("""WITH b AS (SELECT event_type AS category, CAST(user_id % 7 AS VARCHAR) AS dataset, event_id % 400 AS filepath FROM events WHERE event_type = 'error' OR value > 40), p AS (SELECT CAST(user_id % 7 AS VARCHAR) AS dataset, count(*) AS checked FROM events GROUP BY 1)
SELECT 'dataset' AS level, b.dataset, NULL AS category, checked, count(*) AS rows, count(DISTINCT filepath) AS files, round(count(*) / checked * 100, 9) AS rate FROM b JOIN p USING (dataset) GROUP BY b.dataset, checked
UNION ALL SELECT 'category', NULL, category, (SELECT CAST(sum(checked) AS BIGINT) FROM p), count(*), count(DISTINCT filepath), round(count(*) / (SELECT sum(checked) FROM p) * 100, 9) FROM b GROUP BY category
UNION ALL SELECT 'total', NULL, NULL, (SELECT CAST(sum(checked) AS BIGINT) FROM p), count(*), count(DISTINCT filepath), round(count(*) / (SELECT sum(checked) FROM p) * 100, 9) FROM b""")
def qc_report(spark, sf):
    progress = read_table(spark, sf, "events").groupBy((c("user_id") % 7).cast("string").alias("dataset")).agg(F.count("*").alias("checked"))
    return rounded(A.qc_report(_bad(spark, sf), progress))


@query("WITH b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.08) SELECT count(o_orderkey) AS present, count(*) - count(o_orderkey) AS missing, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS bytes FROM b LEFT JOIN orders ON k = o_orderkey AND o_orderkey % 3 <> 0")
def removal_report(spark, sf):
    bad = read_table(spark, sf, "lineitem").where("l_discount > 0.08").select(c("l_orderkey").alias("filepath"))
    return A.removal_report(bad, read_table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("path"), c("o_custkey").alias("size")))


@query("SELECT source AS shard, count(*) FILTER (doc_id % 7 <> 0) AS n, count(*) FILTER (doc_id % 7 <> 0) = count(*) FILTER (doc_id % 17 <> 0) AND count(*) FILTER (doc_id % 7 <> 0) = 43 AS complete FROM documents GROUP BY 1")
def shards_complete(spark, sf):
    return A.shards_complete(raw_samples(spark, sf), 43)


@query("WITH s AS (SELECT user_id AS video, event_id % 5 AS class, sum(value) AS s FROM events GROUP BY ALL) SELECT video, arg_max(class, s) AS pred FROM s GROUP BY 1")
def clip_vote(spark, sf):
    return A.clip_vote(read_table(spark, sf, "events").select(c("user_id").alias("video"), (c("event_id") % 5).alias("class"), c("value").alias("p")))


@query(f"WITH e AS (SELECT DISTINCT filepath FROM ({QC_SQL})) SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS dir, count(*) AS n_checked, count(*) - count(filepath) AS n_passed, count(filepath) AS n_bad FROM pages LEFT JOIN e ON url = filepath GROUP BY 1")
def dir_qc_stats(spark, sf):
    files = read_table(spark, sf, "pages").select(c("url").alias("path"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("dir"))
    return A.dir_qc_stats(files, P.qc_checks(_files(spark, sf)))


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS dataset, count(*) AS wsis, CAST(sum(o_custkey) AS BIGINT) AS patches, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY ROLLUP (o_orderpriority)")
def pipeline_summary(spark, sf):
    return A.pipeline_summary(read_table(spark, sf, "orders").select(c("o_orderpriority").alias("dataset"), "o_orderkey", c("o_custkey").alias("patches"), (c("o_orderstatus") != "F").alias("ok")))


_TIERS = "SELECT c_custkey, c_mktsegment AS site, CASE WHEN c_acctbal >= 7000 THEN 'A' WHEN c_acctbal >= 3000 THEN 'B' ELSE 'C' END AS tier, c_acctbal AS total FROM customer"


def _tiers(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", c("c_mktsegment").alias("site"), F.when(c("c_acctbal") >= 7000, "A").when(c("c_acctbal") >= 3000, "B").otherwise("C").alias("tier"), c("c_acctbal").alias("total"))


@query(f"WITH t AS ({_TIERS}) SELECT site, count(*) AS pool, count(*) FILTER (c_custkey % 3 = 0) AS selected, count(*) FILTER (c_custkey % 3 = 0 AND tier = 'A') AS a, count(*) FILTER (c_custkey % 3 = 0 AND tier = 'B') AS b, count(*) FILTER (c_custkey % 3 = 0 AND tier = 'C') AS c FROM t GROUP BY 1")
def site_summary(spark, sf):
    return A.site_summary(_tiers(spark, sf), _tiers(spark, sf).where("c_custkey % 3 = 0"))


@query(f"WITH t AS ({_TIERS}) SELECT min(total) AS min, max(total) AS max, round(avg(total), 6) AS mean, count(*) FILTER (tier = 'A') AS a, count(*) FILTER (tier = 'B') AS b, count(*) FILTER (tier = 'C') AS c FROM t")
def score_stats(spark, sf):
    return rounded(A.score_stats(_tiers(spark, sf)), 6)


@query(f"""WITH s AS ({STATUS_SQL}) SELECT 'shard' AS level, shard AS name, count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status <> 'OK') AS errors FROM s GROUP BY shard
UNION ALL SELECT 'status', status, count(*), count(*) FILTER (status = 'OK'), count(*) FILTER (status <> 'OK') FROM s GROUP BY status UNION ALL SELECT 'total', '', count(*), count(*) FILTER (status = 'OK'), count(*) FILTER (status <> 'OK') FROM s""")
def validate_report(spark, sf):
    samples = raw_samples(spark, sf).withColumn("key", F.struct("key", "shard"))  # a key may stand in several rows
    return A.validate_report(P.validate_samples(samples).select("key.shard", "status"))


_LIGHTS = "SELECT l_orderkey AS directory, l_partkey % 5 AS CompName, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'PASS' ELSE l_returnflag || l_linestatus END AS ConfirmDefect, l_partkey, l_suppkey, l_extendedprice FROM lineitem"


def _lights(spark, sf):
    return read_table(spark, sf, "lineitem").select(c("l_orderkey").alias("directory"), (c("l_partkey") % 5).alias("CompName"), "l_linenumber", F.when(c("l_returnflag") == "N", "PASS").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("ConfirmDefect"), "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""WITH l AS ({_LIGHTS}), m AS (SELECT directory, CompName, array_to_string(list_sort(list(DISTINCT ConfirmDefect) FILTER (ConfirmDefect <> 'PASS')), '_') AS s FROM l GROUP BY ALL)
SELECT directory, CompName, l_partkey, l_suppkey, CASE WHEN coalesce(s, '') = '' THEN 'PASS' ELSE s END AS ConfirmDefect FROM l JOIN m USING (directory, CompName)""")
def status_across_lights(spark, sf):
    return A.status_across_lights(_lights(spark, sf), ("ConfirmDefect",)).select("directory", "CompName", "l_partkey", "l_suppkey", "ConfirmDefect")


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1 HAVING count(*) = 4")
def complete_groups(spark, sf):
    rows = A.complete_groups(read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), ("l_orderkey",))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("SELECT l_orderkey, string_agg(l_linestatus || l_returnflag, ' ' ORDER BY l_partkey * 10000 + l_suppkey, l_linestatus || l_returnflag) AS lights FROM lineitem GROUP BY 1")
def lights_concat(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", (c("l_partkey") * 10000 + c("l_suppkey")).alias("pos"), F.concat("l_linestatus", "l_returnflag").alias("light"))
    return A.lights_concat(rows, ("l_orderkey",), "light", "pos")


@query(f"""WITH l AS ({_LIGHTS}), g AS (SELECT *, CompName % 2 AS TB_Panel, count(*) OVER (PARTITION BY CompName, CompName % 2, directory) AS n FROM l)
SELECT CompName, TB_Panel, directory, l_partkey FROM g WHERE n = 2 AND ConfirmDefect = 'PASS' QUALIFY row_number() OVER (PARTITION BY CompName, TB_Panel ORDER BY directory DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def golden_pick(spark, sf):
    rows = _lights(spark, sf).withColumn("TB_Panel", c("CompName") % 2)
    return A.golden_pick(rows, ("ConfirmDefect",), ("directory", "l_partkey", "l_suppkey"), n=2).select("CompName", "TB_Panel", "directory", "l_partkey")


@query("SELECT CAST(vec_id % 3 AS VARCHAR) AS subset, count(DISTINCT label) AS ids, count(*) AS images, count(DISTINCT vec_id % 6) AS cameras FROM embeddings GROUP BY 1")
def subset_stats(spark, sf):
    return A.subset_stats(read_table(spark, sf, "embeddings").select((c("vec_id") % 3).cast("string").alias("part"), c("label").alias("pid"), (c("vec_id") % 6).alias("camid")), "part")


@query("SELECT min(l_quantity) AS x_min, max(l_quantity) AS x_max, min(l_extendedprice) AS y_min, max(l_extendedprice) AS y_max, min(l_tax + 1) AS z_min, max(l_tax + 1) AS z_max FROM lineitem")
def range_stats(spark, sf):
    return A.range_stats(read_table(spark, sf, "lineitem").select(c("l_quantity").alias("x"), c("l_extendedprice").alias("y"), (c("l_tax") + 1).alias("z")))


_CM = "SELECT l_linenumber - 1 AS gt, (l_linenumber + CASE WHEN l_discount > 0.07 THEN 1 ELSE 0 END) % 6 AS pred FROM lineitem"


def _cm(spark, sf):
    return read_table(spark, sf, "lineitem").select((c("l_linenumber") - 1).alias("gt"), ((c("l_linenumber") + F.when(c("l_discount") > 0.07, 1).otherwise(0)) % 6).alias("pred"))


_CMT = f"SELECT gt, pred, count(*) AS n FROM ({_CM}) WHERE gt >= 0 AND gt < 7 AND gt <> 3 GROUP BY ALL"


@query(_CMT)
def confusion(spark, sf):
    return A.confusion(_cm(spark, sf), 7, ignore=3)


@query(f"""WITH cm AS ({_CMT}), g AS (SELECT gt AS class, sum(n) AS rows, sum(n) FILTER (gt = pred) AS hit FROM cm GROUP BY 1), p AS (SELECT pred AS class, sum(n) AS cols FROM cm GROUP BY 1),
t AS (SELECT class, CAST(coalesce(rows, 0) AS DOUBLE) AS rows, CAST(coalesce(hit, 0) AS DOUBLE) AS hit, CAST(coalesce(cols, 0) AS DOUBLE) AS cols FROM g FULL JOIN p USING (class)),
s AS (SELECT *, hit / (rows + cols - hit + {A.EPS!r}) AS iou, hit / (cols + {A.EPS!r}) AS precision, hit / (rows + {A.EPS!r}) AS recall FROM t), f AS (SELECT *, 2 * precision * recall / (precision + recall + {A.EPS!r}) AS f1 FROM s)
SELECT class, round(iou, 9) AS iou, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round((SELECT sum(hit) / (sum(rows) + {A.EPS!r}) FROM t), 9) AS acc, round(avg(iou) OVER (), 9) AS miou, round(avg(f1) OVER (), 9) AS mf1 FROM f""")
def confusion_scores(spark, sf):
    return rounded(A.confusion_scores(A.confusion(_cm(spark, sf), 7, ignore=3)))


@query(f"""WITH cm AS ({_CMT}), r AS (SELECT *, n / sum(n) OVER (PARTITION BY gt) * 100 AS pct FROM cm)
SELECT gt, pred, round(pct, 9) AS pct, round((SELECT sum(n) FILTER (gt = pred) / sum(n) * 100 FROM r), 9) AS accuracy, round((SELECT sum(pct) FILTER (gt = pred) / 7 FROM r), 9) AS m_accuracy FROM r""")
def confusion_percent(spark, sf):
    return rounded(A.confusion_percent(A.confusion(_cm(spark, sf), 7, ignore=3), 7))


@query(f"""WITH d AS (SELECT CASE WHEN g IN (0, 255) THEN 255 ELSE g - 1 END AS gt, pred FROM (SELECT CASE gt WHEN 6 THEN 2 ELSE gt END AS g, pred FROM ({_CM}))), k AS (SELECT * FROM d WHERE gt <> 255),
s AS (SELECT gt AS class, 1 AS g, 0 AS p, CASE WHEN gt = pred THEN 1 ELSE 0 END AS i FROM k UNION ALL SELECT pred, 0, 1, 0 FROM k)
SELECT class, CAST(sum(i) AS BIGINT) AS intersect, CAST(sum(g) + sum(p) - sum(i) AS BIGINT) AS union, round(sum(i) / (sum(g) + sum(p) - sum(i)), 9) AS iou FROM s GROUP BY class""")
def mapped_iou(spark, sf):
    return rounded(A.mapped_iou(_cm(spark, sf), {6: 2}, reduce_zero=True))


@query("""SELECT round(count(*) FILTER ((l_quantity / 10 > 2) = (l_returnflag = 'R')) / count(*) * 100, 9) AS total_accuracy, round(count(*) FILTER (l_quantity / 10 > 2 AND l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R') * 100, 9) AS defect_accuracy,
round(count(*) FILTER (l_quantity / 10 > 2 AND l_returnflag <> 'R') / count(*) FILTER (l_returnflag <> 'R') * 100, 9) AS false_alarm, round(count(*) FILTER (l_quantity / 10 <= 2 AND l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R') * 100, 9) AS false_negative FROM lineitem""")
def aoi_metrics(spark, sf):
    return rounded(A.aoi_metrics(read_table(spark, sf, "lineitem").select((c("l_quantity") / 10).alias("score"), (c("l_returnflag") == "R").cast("int").alias("label")), "score", "label"))


_DEPTH = "SELECT l_suppkey AS id, l_quantity / 5 - 0.2 AS gt, l_quantity / 5 + l_discount * 20 - 1 + l_tax AS pred FROM lineitem"


def _depth(spark, sf):
    return read_table(spark, sf, "lineitem").select(c("l_suppkey").alias("id"), (c("l_quantity") / 5 - 0.2).alias("gt"), (c("l_quantity") / 5 + c("l_discount") * 20 - 1 + c("l_tax")).alias("pred"))


@query(f"""WITH v AS (SELECT gt, greatest(least(pred, 10.0), 0.001) AS p FROM ({_DEPTH}) WHERE gt > 0.001 AND gt <= 10), r AS (SELECT *, greatest(p / gt, gt / p) AS r FROM v)
SELECT round(count(*) FILTER (r < 1.25) / count(*), 9) AS d1, round(count(*) FILTER (r < 1.5625) / count(*), 9) AS d2, round(count(*) FILTER (r < 1.953125) / count(*), 9) AS d3, round(avg(abs(p - gt) / gt), 9) AS abs_rel FROM r""")
def depth_metrics(spark, sf):
    return rounded(A.depth_metrics(_depth(spark, sf)))


@query(f"WITH d AS ({_DEPTH}), f AS (SELECT id, regr_slope(gt, pred) AS s, regr_intercept(gt, pred) AS t FROM d GROUP BY 1) SELECT id, count(*) AS n, round(sum(greatest(s * pred + t, 1e-8)), 5) AS total FROM d JOIN f USING (id) GROUP BY id")
def depth_align(spark, sf):
    return A.depth_align(_depth(spark, sf)).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("aligned"), 5).alias("total"))


@query(f"""WITH v AS (SELECT id, gt, pred, abs(pred - gt) AS e, ln(greatest(pred, 1e-8)) - ln(gt) AS l FROM ({_DEPTH}) WHERE gt > 0 AND gt < 416), i AS (SELECT id, avg(e) AS epe, avg(CASE WHEN e > 3 AND e / gt > 0.05 THEN 1 ELSE 0 END) AS d1, avg(CASE WHEN e > 1 THEN 1 ELSE 0 END) AS bp1, avg(CASE WHEN e > 2 THEN 1 ELSE 0 END) AS bp2, avg(CASE WHEN e > 3 THEN 1 ELSE 0 END) AS bp3,
sqrt(avg(e * e)) AS rmse, sqrt(avg(l * l)) AS rmse_log, avg(e / gt) AS abs_rel, avg(e * e / gt) AS sq_rel FROM v GROUP BY id)
SELECT round(avg(epe), 6) AS epe, round(avg(d1), 6) AS d1, round(avg(bp1), 6) AS bp1, round(avg(bp2), 6) AS bp2, round(avg(bp3), 6) AS bp3, round(avg(rmse), 6) AS rmse, round(avg(rmse_log), 6) AS rmse_log, round(avg(abs_rel), 6) AS abs_rel, round(avg(sq_rel), 6) AS sq_rel FROM i""")
def stereo_metrics(spark, sf):
    return rounded(A.stereo_metrics(_depth(spark, sf)), 6)


@query("""WITH d AS (SELECT l_quantity AS i, l_quantity + l_suppkey % 13 AS u, l_linenumber % 5 = 0 AS ge, l_partkey % 7 = 0 AS pe FROM lineitem), r AS (SELECT *, CASE WHEN ge THEN CASE WHEN pe THEN 1.0 ELSE 0 END WHEN pe THEN 0 ELSE i / u END AS iou FROM d)
SELECT round(avg(iou), 9) AS giou, round(sum(i) FILTER (NOT ge) / sum(u) FILTER (NOT ge OR NOT pe), 9) AS ciou, round(count(*) FILTER (NOT ge AND NOT pe) / count(*) FILTER (NOT ge), 9) AS t_acc, round(count(*) FILTER (ge AND pe) / count(*) FILTER (ge), 9) AS n_acc,
round(count(*) FILTER (NOT ge AND iou >= 0.7) / count(*) FILTER (NOT ge), 9) AS pr7, round(count(*) FILTER (NOT ge AND iou >= 0.8) / count(*) FILTER (NOT ge), 9) AS pr8, round(count(*) FILTER (NOT ge AND iou >= 0.9) / count(*) FILTER (NOT ge), 9) AS pr9 FROM r""")
def refer_metrics(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(c("l_quantity").alias("inter"), (c("l_quantity") + c("l_suppkey") % 13).alias("union"), (c("l_linenumber") % 5 == 0).alias("gt_empty"), (c("l_partkey") % 7 == 0).alias("pred_empty"))
    return rounded(A.refer_metrics(rows))


@query("SELECT round(avg(CASE WHEN p_partkey % 9 <> 0 THEN 1 ELSE 0 END), 9) AS acc FROM part")
def exact_match_accuracy(spark, sf):
    rows = read_table(spark, sf, "part").select(c("p_name").alias("gt"), F.concat("p_name", F.when(c("p_partkey") % 9 == 0, "x[s]").otherwise("[s]pad")).alias("pred"))
    return rounded(A.exact_match_accuracy(rows))


@query("SELECT p_partkey, p_partkey % 9 <> 0 AS match, round(pow(0.9, length(p_name) + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END), 9) AS confidence FROM part")
def exact_match(spark, sf):
    rows = read_table(spark, sf, "part").select("p_partkey", c("p_name").alias("gt"), F.concat("p_name", F.when(c("p_partkey") % 9 == 0, "x[s]").otherwise("[s]pad")).alias("pred"), F.array_repeat(F.lit(0.9), 60).alias("probs"))
    return rounded(A.exact_match(rows, probs="probs").select("p_partkey", "match", "confidence"))


@query("WITH s AS (SELECT sum(l_quantity) AS m, sum(l_quantity + l_linenumber) AS d, sum(l_quantity + l_suppkey % 5) AS g FROM lineitem) SELECT round(m / d, 9) AS precision, round(m / g, 9) AS recall, round(2 * (m / d) * (m / g) / (m / d + m / g), 9) AS hmean FROM s")
def micro_prf(spark, sf):
    return rounded(A.micro_prf(read_table(spark, sf, "lineitem").select(c("l_quantity").alias("matched"), (c("l_quantity") + c("l_linenumber")).alias("det"), (c("l_quantity") + c("l_suppkey") % 5).alias("gt"))))


_UNIT = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(f"""{_UNIT}, u AS (SELECT vec_id, unnest(v) / sqrt(list_inner_product(v, v)) AS x, generate_subscripts(v, 1) AS d FROM e), m AS (SELECT d, avg(x) AS m FROM u GROUP BY 1), k AS (SELECT sqrt(sum(m * m)) AS norm FROM m),
t AS (SELECT vec_id, acos(greatest(least(sum(x * m / norm), 1.0), -1.0)) AS a FROM u JOIN m USING (d), k GROUP BY 1)
SELECT (SELECT round(max(m / norm), 6) FROM m, k) AS largest, round(avg(a * a), 6) AS variance FROM t""")
def angle_dispersion(spark, sf):
    return A.angle_dispersion(read_table(spark, sf, "embeddings"), "embedding").select(F.round(F.array_max("mean_direction"), 6).alias("largest"), F.round("variance", 6).alias("variance"))


@query(f"""{_UNIT}, p AS (SELECT a.vec_id, unnest(a.v) AS x, unnest(b.v) * 4 AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, x, y, abs(x - y) AS d FROM p)
SELECT vec_id, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 8) AS cosine, round(avg(d * d), 8) AS squared, round(avg(CASE WHEN d < 1 THEN 0.5 * d * d ELSE 2 * sqrt(d + 1e-8) - 1.5 END), 8) AS dampened, round(avg(CASE WHEN d < 2 THEN d * d / 4 ELSE d - 1 END), 8) AS smooth_l1,
round(0.9 * (1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))) + 0.1 * avg(d), 8) AS mixed FROM d GROUP BY vec_id""")
def pair_losses(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("a"))
    pairs = e.join(e.select((c("vec_id") - 1).alias("vec_id"), F.transform("a", lambda x: x * 4).alias("b")), "vec_id")
    return rounded(A.pair_losses(pairs, "a", "b").drop("a", "b"), 8)
