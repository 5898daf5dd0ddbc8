"""Queries of scoring, selection, ranking and sequences over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.blocks import line_distance
from loomfield.functions.common import read_table
from loomfield.operators import ranking as R
from loomfield.operators.vectors import nearest_rows
from loomfield.plans.aggregates import rounded
from loomfield.plans.registry import Plans

plans = Plans()
QUERIES, SQL, query = plans.QUERIES, plans.SQL, plans.query
c = F.col


def _cases(spark, sf):
    i = c("doc_id")
    return read_table(spark, sf, "documents").select(
        i.alias("key"), F.when(i % 5 != 0, c("text")).alias("diagnosis"), c("text").alias("conclusion"), F.when(i % 3 == 0, c("lang")).alias("grossing"), F.when(i % 4 == 0, " ").otherwise(c("source")).alias("micro_protocol"),
        F.when(i % 7 == 0, "C50.1").when(i % 7 == 1, "c43").otherwise("X").alias("icd10"), F.when(i % 6 == 0, "x").alias("diff_diagnostic"), F.when(i % 2 == 0, "y").otherwise("").alias("additional_info"),
        (i % 14).cast("int").alias("slide_count"), (i % 14 * (i % 2)).cast("int").alias("he_slides"), F.when(i % 3 == 1, F.array(F.lit("The"))).otherwise(F.array(F.lit("PAS"))).alias("stain_types"), (i * 7 % 60).cast("int").alias("bad_rows"),
        c("source").alias("dataset"), c("lang").alias("specialization"),
    )


_CASES = """SELECT doc_id AS key, CASE WHEN doc_id % 5 <> 0 THEN text END AS diagnosis, text AS conclusion, CASE WHEN doc_id % 3 = 0 THEN lang END AS grossing, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS micro_protocol,
CASE doc_id % 7 WHEN 0 THEN 'C50.1' WHEN 1 THEN 'c43' ELSE 'X' END AS icd10, CASE WHEN doc_id % 6 = 0 THEN 'x' END AS diff_diagnostic, CASE WHEN doc_id % 2 = 0 THEN 'y' ELSE '' END AS additional_info,
doc_id % 14 AS n, doc_id % 14 * (doc_id % 2) AS he, doc_id % 3 = 1 AS stained, doc_id * 7 % 60 AS b, source AS dataset, lang AS specialization FROM documents"""
_SCORED = f"""SELECT *, CASE WHEN total >= 70 THEN 'A' WHEN total >= 40 THEN 'B' ELSE 'C' END AS tier FROM (SELECT *, meta + slides + bad + richness AS total FROM (SELECT *,
CASE WHEN trim(coalesce(diagnosis, '')) <> '' THEN 6 ELSE 0 END + CASE WHEN trim(coalesce(conclusion, '')) <> '' THEN 6 ELSE 0 END + CASE WHEN trim(coalesce(grossing, '')) <> '' THEN 5 ELSE 0 END + CASE WHEN trim(micro_protocol) <> '' THEN 5 ELSE 0 END + 3 AS meta,
CASE WHEN he > 0 THEN 10 WHEN stained THEN 8 WHEN n > 0 THEN 3 ELSE 0 END + least(n, 10) + CASE WHEN n > 0 THEN 15 ELSE 0 END + CASE WHEN he > 0 THEN 10 ELSE 0 END AS slides,
CASE WHEN n = 0 THEN 0 WHEN b = 0 THEN 25 WHEN b / n < 1 THEN 20 WHEN b / n < 5 THEN 15 WHEN b / n < 10 THEN 10 ELSE 0 END AS bad,
CASE WHEN diff_diagnostic IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN length(coalesce(diagnosis, '')) > 100 THEN 5 ELSE 0 END + CASE WHEN length(conclusion) > 200 THEN 5 ELSE 0 END + CASE WHEN additional_info <> '' THEN 5 ELSE 0 END AS richness FROM ({_CASES})))"""


@query(f"SELECT key, CAST(meta AS INTEGER) AS meta, CAST(slides AS INTEGER) AS slides, CAST(bad AS INTEGER) AS bad, CAST(richness AS INTEGER) AS richness, CAST(total AS INTEGER) AS total, tier FROM ({_SCORED})")
def quality_score(spark, sf):
    return R.quality_score(_cases(spark, sf)).select("key", "meta", "slides", "bad", "richness", "total", "tier")


_WORDS = [("North", ("thnt", "ould")), ("South", ("ción", "ment")), ("East", ("ung",))]


def _sites(spark, sf):
    return R.site_classify(_cases(spark, sf), {"src1": "Coast", "src2": "Coast", "src3": "Hill"}, "src4", {"en": "Isle", "de": "Other"}, _WORDS, {"C50": "Bay", "C43": "Cape"})


@query(f"""WITH k AS (SELECT *, lower(coalesce(diagnosis, '')) || ' ' || lower(coalesce(conclusion, '')) AS t FROM ({_CASES})), s AS (SELECT key,
CASE WHEN dataset IN ('src1', 'src2') THEN 'Coast|case_mapping' WHEN dataset = 'src3' THEN 'Hill|case_mapping' WHEN dataset <> 'src4' THEN 'Other|unknown' WHEN specialization = 'en' THEN 'Isle|specialization' WHEN contains(t, 'thnt') OR contains(t, 'ould') THEN 'North|diagnosis_keyword'
WHEN contains(t, 'ción') OR contains(t, 'ment') THEN 'South|diagnosis_keyword' WHEN contains(t, 'ung') THEN 'East|diagnosis_keyword' WHEN icd10 = 'C50.1' THEN 'Bay|icd10' WHEN icd10 = 'c43' THEN 'Cape|icd10' WHEN specialization = 'de' THEN 'Other|specialization_fallback' ELSE 'Other|unclassified' END AS x FROM k)
SELECT key, string_split(x, '|')[1] AS site, string_split(x, '|')[2] AS method FROM s""")
def site_classify(spark, sf):
    return _sites(spark, sf).select("key", "site", "method")


_DIAG = "CASE WHEN diagnosis IS NULL OR diagnosis = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(lower(diagnosis), '{p}') THEN '{label}'" for p, label in R.DIAGNOSES) + " ELSE 'other' END"
_TERMS = "['Melanoma in situ', 'benign nevus', 'keratoma', 'a mass', 'Carcinoma', 'none', '']"


def _diagnoses(spark, sf):
    terms = F.array(*map(F.lit, ("Melanoma in situ", "benign nevus", "keratoma", "a mass", "Carcinoma", "none", "")))
    return read_table(spark, sf, "documents").select(c("doc_id").alias("key"), terms[(c("doc_id") % 7).cast("int")].alias("diagnosis"), c("lang").alias("site"), (c("n_chars") % 100).cast("int").alias("total"))


@query(f"SELECT key, {_DIAG} AS keyword FROM (SELECT doc_id AS key, {_TERMS}[doc_id % 7 + 1] AS diagnosis FROM documents)")
def diagnosis_keyword(spark, sf):
    return R.diagnosis_keyword(_diagnoses(spark, sf)).select("key", "keyword")


@query(f"""WITH k AS (SELECT *, {_DIAG} AS keyword, CASE WHEN total >= 70 THEN 'A' WHEN total >= 40 THEN 'B' ELSE 'C' END AS tier FROM (SELECT doc_id AS key, {_TERMS}[doc_id % 7 + 1] AS diagnosis, lang AS site, n_chars % 100 AS total FROM documents)),
z AS (SELECT site, count(*) AS n, count(*) FILTER (tier = 'A') AS a FROM k GROUP BY 1), p AS (SELECT k.*, n FROM k JOIN z USING (site) WHERE n <= 40 OR CASE WHEN a >= 40 THEN tier = 'A' WHEN a >= 28 THEN tier IN ('A', 'B') ELSE true END),
g AS (SELECT *, count(*) OVER (PARTITION BY site, keyword) AS gs, row_number() OVER (PARTITION BY site, keyword ORDER BY total DESC, key) AS ig FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN ig = 1 THEN 0 ELSE 1 END, CASE WHEN ig = 1 THEN gs ELSE 0 END, CASE WHEN ig = 1 THEN keyword ELSE '' END, total DESC, key) AS place FROM g),
s AS (SELECT * FROM r WHERE n <= 40 OR place <= 40)
SELECT key, site, tier, CAST(total AS INTEGER) AS total, keyword, CASE WHEN n <= 40 THEN 'all_cases' ELSE 'quality_tier_stratified_' || count(*) OVER (PARTITION BY site) || '_from_' || n END AS method FROM s""")
def tiered_select(spark, sf):
    cases = R.diagnosis_keyword(_diagnoses(spark, sf)).withColumn("tier", F.when(c("total") >= 70, "A").when(c("total") >= 40, "B").otherwise("C"))
    return R.tiered_select(cases, 40)


@query("""WITH r AS (SELECT user_id AS scene, event_id, ts, event_type = 'signup' AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events), k AS (SELECT *, sum(CASE WHEN z AND rn > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scene ORDER BY ts, event_id) AS g FROM r WHERE rn % 2 = 0)
SELECT scene, event_id, CAST(g * 3 + (row_number() OVER (PARTITION BY scene, g ORDER BY ts, event_id) - 1) // CAST(ceil(count(*) OVER (PARTITION BY scene, g) / 3) AS BIGINT) AS BIGINT) AS group_idx FROM k""")
def sequence_groups(spark, sf):
    frames = read_table(spark, sf, "events").select(c("user_id").alias("scene"), "event_id", F.struct("ts", "event_id").alias("ts"), F.when(c("event_type") == "signup", 0).otherwise(1).alias("frame_idx"))
    return R.sequence_groups(frames, splits=3, interval=2).select("scene", "event_id", "group_idx")


@query("""WITH r AS (SELECT user_id AS object, event_id AS frame, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events), s AS (SELECT object, frame, rn, unnest(generate_series(0, rn // 8)) AS seq FROM r)
SELECT object, seq, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM s WHERE rn >= seq * 8 AND rn < seq * 8 + 20 GROUP BY ALL HAVING count(*) >= 5""")
def sliding_sequences(spark, sf):
    return R.sliding_sequences(read_table(spark, sf, "events").select(c("user_id").alias("object"), c("event_id").alias("frame")), 20, 5, 8)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round((v[5] - v[1]) / 2, 9) END AS x, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round((v[7] - v[3]) / 2, 9) END AS z, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS conf FROM e""")
def pose_normalize(spark, sf):
    v = F.col("embedding").cast("array<double>")
    frames = read_table(spark, sf, "embeddings").select("vec_id", F.concat(F.slice(v, 1, 3), F.array(F.lit(1.0)), F.slice(v, 5, 3), F.array(F.when(c("vec_id") % 3 == 0, 0.0).otherwise(1.0))).alias("pose"))
    j = c("joints")[1]
    return rounded(R.pose_normalize(frames, focal=2.0).select("vec_id", j[0].alias("x"), j[2].alias("z"), j[3].alias("conf")))


def _videos(spark, sf):
    return read_table(spark, sf, "events").groupBy(c("user_id").alias("video")).agg(F.count("*").alias("n"))


_VIDEOS = "WITH v AS (SELECT user_id AS video, count(*) AS n FROM events GROUP BY 1)"


@query(f"""{_VIDEOS}, k AS (SELECT video, n, unnest(generate_series(0, greatest(n // 24, 1) - 1)) AS clip FROM v) SELECT video, CAST(clip AS INTEGER) AS clip, array_to_string(list_transform(range(8), lambda i: (clip * 24 + i * 3) % n), ',') AS ids FROM k""")
def clip_index(spark, sf):
    return R.clip_index(_videos(spark, sf), 8, "interval", rate=3).select("video", c("clip").cast("int").alias("clip"), F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""{_VIDEOS}, k AS (SELECT video, n, unnest(generate_series(0, 3)) AS clip FROM v) SELECT video, CAST(clip AS INTEGER) AS clip, array_to_string(list_transform(range(8), lambda i: CAST(floor(n / 8 * i + n / 8 * clip / 4) AS BIGINT) % n), ',') AS ids FROM k""")
def clip_index_segment(spark, sf):
    return R.clip_index(_videos(spark, sf), 8, "segment", segments=4).select("video", c("clip").cast("int").alias("clip"), F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""{_VIDEOS} SELECT video, array_to_string(list_transform(range(8), lambda i: CAST(floor(n / 8 * (i + 0.5)) AS BIGINT)), ',') AS ids FROM v""")
def frame_sample(spark, sf):
    return R.frame_sample(_videos(spark, sf), 8, "middle").select("video", F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""{_VIDEOS} SELECT video, array_to_string(list_transform(range(8), lambda i: least(CAST(floor(n / 8 * (i + ((CAST(('0x' || substr(md5('42:' || video || '/' || i), 1, 13)) AS UBIGINT) + 0.5) / 4503599627370496.0))) AS BIGINT), n - 1)), ',') AS ids FROM v""")
def frame_sample_random(spark, sf):
    return R.frame_sample(_videos(spark, sf), 8, "random").select("video", F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""{_VIDEOS}, u AS (SELECT video, n, i, (CAST(('0x' || substr(md5('42:' || video || '/' || i), 1, 13)) AS UBIGINT) + 0.5) / 4503599627370496.0 AS u FROM v, unnest(generate_series(0, 7)) AS t(i)),
r AS (SELECT video, CAST(CASE WHEN n >= 8 THEN i * (n // 8) + floor(u * (n // 8)) ELSE floor(u * n) END AS BIGINT) AS id FROM u) SELECT video, string_agg(id, ',' ORDER BY id) AS ids FROM r GROUP BY video""")
def frame_sample_random_interval(spark, sf):
    return R.frame_sample(_videos(spark, sf), 8, "random_interval").select("video", F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""{_VIDEOS}, s AS (SELECT video, n, CAST(floor((CAST(('0x' || substr(md5('42:' || video || '/0'), 1, 13)) AS UBIGINT) + 0.5) / 4503599627370496.0 * greatest(n - 16 + 2, 1)) AS BIGINT) AS start FROM v) SELECT video, array_to_string(list_transform(range(8), lambda i: (start + i * 2) % n), ',') AS ids FROM s""")
def frame_sample_random_consecutive(spark, sf):
    return R.frame_sample(_videos(spark, sf), 8, "random_consecutive", rate=2).select("video", F.array_join(c("ids").cast("array<string>"), ",").alias("ids"))


def _orders(spark, sf):
    """Orders as rows to be ranked: value, customer and status; the ids divisible by 100 are the stated query set, against all others."""
    o = read_table(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.array("o_totalprice").alias("v"), c("o_custkey").alias("label"), c("o_orderstatus").alias("cam"))
    return o.where("id % 100 = 0"), o


_DIST = """SELECT q.o_orderkey AS qid, g.o_orderkey AS gid, q.o_custkey AS q_pid, g.o_custkey AS g_pid, q.o_orderstatus AS q_cam, g.o_orderstatus AS g_cam, g.o_orderpriority AS priority, abs(q.o_totalprice - g.o_totalprice) AS dist FROM orders q JOIN orders g ON g.o_orderkey <> q.o_orderkey WHERE q.o_orderkey % 100 = 0"""
_RANKED = f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, gid) AS rank FROM ({_DIST}) WHERE NOT (q_pid = g_pid AND q_cam = g_cam)), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS hits FROM k WHERE q_pid = g_pid), e AS (SELECT qid, min(rank) AS first, avg(hits / rank) AS ap FROM m GROUP BY 1)"


@query(f"{_RANKED} SELECT CAST(r AS INTEGER) AS rank, round(avg(CASE WHEN first <= r THEN 1 ELSE 0 END), 9) AS cmc FROM e, unnest(generate_series(1, 50)) AS t(r) GROUP BY r")
def rank_metrics(spark, sf):
    return rounded(R.rank_metrics(R.relevant_ranks(*_orders(spark, sf), line_distance, skip_same_camera=True))[0])


@query(f"{_RANKED} SELECT round(avg(ap), 9) AS map, count(*) AS queries FROM e")
def rank_metrics_map(spark, sf):
    return rounded(R.rank_metrics(R.relevant_ranks(*_orders(spark, sf), line_distance, skip_same_camera=True))[1])


_RET = f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, gid) AS rank FROM ({_DIST})), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS hits, count(*) OVER (PARTITION BY qid) AS r FROM k WHERE q_pid = g_pid), e AS (SELECT qid, q_pid AS class, max(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END) AS p1, count(*) FILTER (rank <= r) / max(r) AS rp, avg(hits / rank) AS map, 1 / min(rank) AS mrr FROM m GROUP BY ALL)"


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, gid) AS rank FROM (" + _DIST + ")) SELECT qid, gid, q_pid AS label, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS hits, count(*) OVER (PARTITION BY qid) AS n_relevant FROM k WHERE q_pid = g_pid")
def relevant_ranks(spark, sf):
    return R.relevant_ranks(*_orders(spark, sf), line_distance).withColumn("hits", c("hits").cast("long"))


@query(f"{_RET} SELECT round(avg(p1), 9) AS p1, round(avg(rp), 9) AS r_precision, round(avg(map), 9) AS map, round(avg(mrr), 9) AS mrr FROM e")
def retrieval_metrics(spark, sf):
    return rounded(R.retrieval_metrics(R.relevant_ranks(*_orders(spark, sf), line_distance)))


@query(f"{_RET} SELECT class, round(avg(p1), 9) AS p1, round(avg(rp), 9) AS r_precision, round(avg(map), 9) AS map, round(avg(mrr), 9) AS mrr FROM e GROUP BY class")
def retrieval_metrics_per_class(spark, sf):
    return rounded(R.retrieval_metrics(R.relevant_ranks(*_orders(spark, sf), line_distance), per_class=True))


@query("""WITH x AS (SELECT l_returnflag AS l, l_linenumber % 4 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS c, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM x)
SELECT round(sum(n / t * ln(n * t / (a * b))) / ((-sum(n / t * ln(a / t)) - sum(n / t * ln(b / t))) / 2), 9) AS nmi FROM s""")
def cluster_nmi(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_returnflag", (c("l_linenumber") % 4 + F.when(c("l_linestatus") == "O", 1).otherwise(0)).alias("k"))
    return rounded(R.cluster_nmi(rows, "l_returnflag", "k"))


_NEIGH = f"SELECT qid, gid, dist, CAST(substr(priority, 1, 1) AS INTEGER) AS label, exp(-dist / 100000) AS sim FROM ({_DIST}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, gid) <= 20"


def _neigh(spark, sf):
    labels = read_table(spark, sf, "orders").select(c("o_orderkey").alias("gid"), F.substring("o_orderpriority", 1, 1).cast("int").alias("label"))
    return nearest_rows(*_orders(spark, sf), line_distance, 20).join(labels, "gid").select("qid", "gid", "dist", "label", F.exp(-c("dist") / 100000).alias("sim"))


@query(f"WITH v AS (SELECT qid, label, sum(exp(sim / 0.07)) AS v FROM ({_NEIGH}) GROUP BY ALL) SELECT qid, label AS pred FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC, label) = 1")
def knn_vote(spark, sf):
    return R.knn_vote(_neigh(spark, sf))


@query(f"SELECT qid, string_agg(label, ',' ORDER BY dist, gid) AS labels, round(max(dist), 4) AS farthest FROM (SELECT * FROM ({_NEIGH}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, gid) <= 7) GROUP BY 1")
def topk_labels(spark, sf):
    return R.topk_labels(_neigh(spark, sf), 7).select("qid", F.array_join(c("labels").cast("array<string>"), ",").alias("labels"), F.round(F.array_max("distances"), 4).alias("farthest"))


_DETS = "SELECT l_returnflag AS class, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS id, l_extendedprice AS score, CASE WHEN l_quantity > 20 AND l_discount < 0.06 THEN 1 ELSE 0 END AS tp FROM lineitem"


@query(f"""WITH d AS ({_DETS}), n AS (SELECT class, sum(tp) + 500 AS n_gt FROM d GROUP BY 1), r AS (SELECT *, row_number() OVER w AS rank, sum(tp) OVER w AS hits FROM d WINDOW w AS (PARTITION BY class ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(hits / rank) OVER (PARTITION BY class ORDER BY score DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r) SELECT class, round(sum(env / n_gt) FILTER (tp = 1), 9) AS ap FROM e JOIN n USING (class) GROUP BY 1""")
def average_precision(spark, sf):
    dets = read_table(spark, sf, "lineitem").select(c("l_returnflag").alias("class"), (c("l_orderkey") * 1000000 + c("l_partkey") * 100 + c("l_linenumber")).alias("id"), c("l_extendedprice").alias("score"), F.when((c("l_quantity") > 20) & (c("l_discount") < 0.06), 1).otherwise(0).alias("tp"))
    return rounded(R.average_precision(dets, dets.groupBy("class").agg((F.sum("tp") + 500).alias("n_gt"))))


@query("""WITH s AS (SELECT event_id AS id, value AS score, unnest(generate_series(0, 9)) AS t, user_id % 12 AS u FROM events), d AS (SELECT id, score, t, CASE WHEN u >= t THEN 1 ELSE 0 END AS tp FROM s),
r AS (SELECT *, row_number() OVER w AS rank, sum(tp) OVER w AS hits FROM d WINDOW w AS (PARTITION BY t ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, hits / rank AS p, max(hits) OVER () AS n FROM r), q AS (SELECT *, greatest(p, coalesce(lead(p) OVER (PARTITION BY t ORDER BY score DESC, id), 0)) AS e FROM p)
SELECT round(t * 0.05 + 0.5, 9) AS iou, round(sum(tp * e / n), 9) AS ap FROM q GROUP BY t""")
def ap_per_mask(spark, sf):
    stats = read_table(spark, sf, "events").select(c("event_id").alias("id"), c("value").alias("score"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda t: (c("user_id") % 12 >= t).cast("int")).alias("met"))
    return rounded(R.ap_per_mask(stats))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS s, vec_id % 10 AS gt FROM embeddings), r AS (SELECT len(list_filter(s, lambda x: x > s[gt + 1])) AS above FROM e)
SELECT k, round(avg(CASE WHEN above < k THEN 1 ELSE 0 END) * 100, 9) AS acc FROM r, (VALUES (1), (5)) t(k) GROUP BY k""")
def topk_accuracy(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(F.slice(c("embedding").cast("array<double>"), 1, 10).alias("scores"), (c("vec_id") % 10).cast("int").alias("gt"))
    return rounded(R.topk_accuracy(rows))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), t AS (SELECT *, list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) AS total, list_position(s, list_max(s)) AS at FROM e)
SELECT vec_id AS img_name, ['a', 'b', 'c', 'd'][at] AS pred_label, round(1 / total, 9) AS pred_score, ['a', 'b', 'c', 'd'][vec_id % 4 + 1] AS gt_label FROM t""".replace(" AS at FROM", " AS pos FROM").replace("[at]", "[pos]"))
def prediction_table(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(c("vec_id").alias("img_name"), F.slice(c("embedding").cast("array<double>"), 1, 4).alias("logits"), (c("vec_id") % 4).cast("int").alias("gt"))
    return rounded(R.prediction_table(rows, ("a", "b", "c", "d")).drop("scores"))


@query("""WITH h AS (SELECT l_suppkey AS s, CAST(floor(l_quantity * 3 + CASE WHEN l_discount > 0.05 THEN 90 ELSE 0 END) AS INTEGER) AS v, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY s) AS wt, sum(n * v) OVER (PARTITION BY s) AS st FROM h WINDOW u AS (PARTITION BY s ORDER BY v ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN wt > w0 THEN w0 * (wt - w0) * (s0 / w0 - (st - s0) / (wt - w0)) * (s0 / w0 - (st - s0) / (wt - w0)) ELSE 0 END AS x FROM w) SELECT s AS slide_id, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY s ORDER BY x DESC, v) = 1""")
def otsu_threshold(spark, sf):
    luma = F.floor(c("l_quantity") * 3 + F.when(c("l_discount") > 0.05, 90).otherwise(0)).cast("int")
    return R.otsu_threshold(read_table(spark, sf, "lineitem").select(c("l_suppkey").alias("slide_id"), luma.alias("luma")))


def _mask(spark, sf):
    """A 40 x 25 pixel mask for every 1,000 event ids."""
    return read_table(spark, sf, "events").select((c("event_id") / 1000).cast("int").alias("slide_id"), (c("event_id") % 40).cast("int").alias("x"), (c("event_id") % 1000 / 40).cast("int").alias("y"), F.when((c("value") > 12) | (c("event_id") % 40 < 20), 1).otherwise(0).alias("v"))


@query("""WITH m AS (SELECT event_id // 1000 AS s, event_id % 40 AS x, event_id % 1000 // 40 AS y, CASE WHEN value > 12 OR event_id % 40 < 20 THEN 1 ELSE 0 END AS v FROM events), t AS (SELECT s, v, tx, ty FROM m, unnest(generate_series(0, 9)) a(tx), unnest(generate_series(0, 9)) b(ty) WHERE x >= tx * 4 AND x < tx * 4 + 8 AND y >= ty * 4 AND y < ty * 4 + 8 AND tx * 4 + 8 <= 40 AND ty * 4 + 8 <= 25),
g AS (SELECT s, tx, ty, sum(v) / 64 AS r FROM t GROUP BY ALL HAVING sum(v) / 64 >= 0.6)
SELECT CAST(s AS INTEGER) AS slide_id, CAST(row_number() OVER (PARTITION BY s ORDER BY ty, tx) - 1 AS INTEGER) AS patch_idx, CAST(tx * 4 * 128 AS INTEGER) AS x, CAST(ty * 4 * 128 AS INTEGER) AS y, round(r, 4) AS fg_ratio FROM g""")
def tile_grid(spark, sf):
    return R.tile_grid(_mask(spark, sf), patch=1024, scale=128.0, min_fg=0.6, overlap=50).select("slide_id", "patch_idx", "x", "y", "fg_ratio")


@query("SELECT md5(text) AS md5, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, md5(text) LIMIT 10")
def top_hashes(spark, sf):
    counts = read_table(spark, sf, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("count"))
    return R.top_hashes(counts)


@query("SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT s_suppkey + (SELECT max(p_partkey) + 1 FROM part), s_name FROM supplier UNION ALL SELECT c_custkey + (SELECT max(p_partkey) + 1 FROM part) + (SELECT max(s_suppkey) + 1 FROM supplier), c_name FROM customer")
def union_sources(spark, sf):
    parts = [read_table(spark, sf, t).select(c(f"{p}_{k}").cast("long").alias("id"), c(f"{p}_name").alias("name")) for t, p, k in (("part", "p", "partkey"), ("supplier", "s", "suppkey"), ("customer", "c", "custkey"))]
    return R.union_sources(parts, "id")


@query("SELECT l_orderkey AS image_id FROM lineitem WHERE l_linenumber IN (1, 2, 5) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3")
def images_with_all(spark, sf):
    return R.images_with_all(read_table(spark, sf, "lineitem").select(c("l_orderkey").alias("image_id"), c("l_linenumber").alias("category_id")), (1, 2, 5))


@query("""WITH o AS (SELECT user_id AS image_id, list_sort(list(DISTINCT event_type)) AS pos, list_sort(list(event_type)) AS rows FROM events GROUP BY 1), a AS (SELECT DISTINCT event_type AS x FROM events),
n AS (SELECT image_id, x, row_number() OVER (PARTITION BY image_id ORDER BY md5('42:' || image_id || '/' || x), x) AS i FROM o, a WHERE NOT list_contains(pos, x)), l AS (SELECT image_id, list(x ORDER BY i) AS neg FROM n JOIN o USING (image_id) WHERE i <= 4 - len(pos) GROUP BY 1), k AS (SELECT image_id, rows, list_concat(pos, coalesce(neg, [])) AS names FROM o LEFT JOIN l USING (image_id))
SELECT image_id, array_to_string(names, ' . ') || ' .' AS caption, array_to_string(list_transform(rows, lambda r: list_position(names, r) - 1), ',') AS classes FROM k""")
def negative_labels(spark, sf):
    events = read_table(spark, sf, "events")
    anns = events.select(c("user_id").alias("image_id"), c("event_type").alias("label"))
    return R.negative_labels(anns, events.select(c("event_type").alias("label")), 4).select("image_id", "caption", F.array_join(c("classes").cast("array<string>"), ",").alias("classes"))


@query("""WITH r AS (SELECT conv_id AS image, turn, lower(trim(role)) AS p FROM conversations), f AS (SELECT image, p, min(turn) AS t FROM r GROUP BY ALL), n AS (SELECT image, list(p ORDER BY t) AS names FROM f GROUP BY 1)
SELECT image, array_to_string(any_value(names), ' . ') || ' .' AS caption, string_agg(list_position(names, p) - 1, ',' ORDER BY turn) AS classes FROM r JOIN n USING (image) GROUP BY image""")
def phrase_index(spark, sf):
    regions = read_table(spark, sf, "conversations").select(c("conv_id").alias("image"), c("turn").alias("pos"), F.concat(F.lit(" "), "role").alias("phrase"))
    return R.phrase_index(regions).select("image", "caption", F.array_join(c("classes").cast("array<string>"), ",").alias("classes"))
