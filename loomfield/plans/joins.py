"""Queries of the joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.common import read_table
from loomfield.operators import joins as J
from loomfield.plans.registry import Plans

plans = Plans()
QUERIES, SQL, query = plans.QUERIES, plans.SQL, plans.query
_PARTS = "regexp_extract(url, '^(.*)/([^/]*)$', 1) AS dir, regexp_extract(url, '^(.*)/([^/]*)$', 2) AS stem"


def _pages(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.regexp_extract("url", "^(.*)/([^/]*)$", 1).alias("dir"), F.regexp_extract("url", "^(.*)/([^/]*)$", 2).alias("stem"))


@query(f"WITH p AS (SELECT page_id, url, {_PARTS} FROM pages) SELECT a.dir, a.stem, a.url AS image, b.url AS text FROM p a JOIN p b ON a.dir = b.dir AND a.stem = b.stem WHERE a.page_id % 2 = 0 AND b.page_id % 3 = 0")
def pair_image_text(spark, sf):
    p = _pages(spark, sf)
    return J.pair_image_text(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0"))


@query("SELECT url AS path, CASE WHEN page_id % 4 = 3 THEN 'ext' WHEN url IN (SELECT url FROM pages WHERE page_id % 5 = 0) THEN 'bad' ELSE 'kept' END AS reason FROM pages")
def exclude_bad(spark, sf):
    files = read_table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id", F.when(F.col("page_id") % 4 == 3, "PNG").otherwise("JPG").alias("ext"))
    return J.exclude_bad(files, files.where("page_id % 5 = 0").select(F.col("path").alias("filepath")), ("jpg", "jpeg"))


@query("""WITH f AS (SELECT doc_id, source AS dataset, CASE WHEN doc_id % 10 = 0 THEN 'misc' ELSE 'case_' || lpad(CAST(doc_id % 50 AS VARCHAR), 4, '0') END AS parent FROM documents),
s AS (SELECT DISTINCT source AS dataset, doc_id % 50 AS n FROM documents WHERE doc_id % 50 < 12 AND source <> 'src3')
SELECT doc_id, dataset, parent FROM f WHERE dataset NOT IN (SELECT dataset FROM s) OR parent = 'misc' OR EXISTS (SELECT 1 FROM s WHERE s.dataset = f.dataset AND s.n = doc_id % 50)""")
def select_cases_join(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"))
    files = docs.withColumn("parent", F.when(F.col("doc_id") % 10 == 0, "misc").otherwise(F.concat(F.lit("case_"), F.lpad((F.col("doc_id") % 50).cast("string"), 4, "0"))))
    selection = docs.where("doc_id % 50 < 12 AND dataset <> 'src3'").select("dataset", (F.col("doc_id") % 50).cast("string").alias("case_id")).distinct()
    return J.select_cases_join(files, selection).select("doc_id", "dataset", "parent")


@query("""WITH s AS (SELECT o_custkey AS key, count(*) AS slide_count, count(*) FILTER (o_orderstatus = 'F') AS he_slides, list_sort(list(DISTINCT o_orderpriority)) AS stain_types FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1),
b AS (SELECT o_custkey AS key, count(*) AS bad_rows FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1)
SELECT c_custkey AS key, coalesce(slide_count, 0) AS slide_count, coalesce(he_slides, 0) AS he_slides, array_to_string(coalesce(stain_types, []), ';') AS stains, coalesce(bad_rows, 0) AS bad_rows FROM customer LEFT JOIN s ON c_custkey = s.key LEFT JOIN b ON c_custkey = b.key""")
def score_join(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("key", F.col("o_custkey"))
    slides = orders.where("key % 3 <> 0").groupBy("key").agg(F.count("*").alias("slide_count"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("he_slides"), F.array_sort(F.collect_set("o_orderpriority")).alias("stain_types"))
    bad = orders.where("o_orderkey % 10 = 0").groupBy("key").agg(F.count("*").alias("bad_rows"))
    out = J.score_join(read_table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), slides, bad)
    return out.select("key", "slide_count", "he_slides", F.concat_ws(";", "stain_types").alias("stains"), "bad_rows")


def _hashed(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"))


_COUNTS = "WITH c AS (SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1)"
for _mode, _w in {"inv_frequency": "1.0 / coalesce(n, 1)", "inv_frequency_sq": "1.0 / (coalesce(n, 1) * coalesce(n, 1))", "inv_log": "1.0 / ln(coalesce(n, 1) + 1)"}.items():

    def _weighted(spark, sf, mode=_mode):
        docs = _hashed(spark, sf)
        counts = docs.groupBy("md5").agg(F.count("*").alias("count"))
        return J.weight_join(docs, counts, mode).select("doc_id", F.round("weight", 12).alias("weight"))

    query(f"{_COUNTS} SELECT doc_id, round(CAST({_w} AS DOUBLE), 12) AS weight FROM documents LEFT JOIN c ON md5(text) = c.md5", name="weight_join" if _mode == "inv_frequency" else f"weight_join_{_mode}")(_weighted)


@query("SELECT md5(text) AS md5 FROM documents GROUP BY 1 HAVING count(*) > 2")
def overrep_blocklist(spark, sf):
    return J.overrep_blocklist(_hashed(spark, sf).groupBy("md5").agg(F.count("*").alias("count")), 2)


@query("SELECT doc_id, md5(text) AS md5 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 2)")
def block_overrep(spark, sf):
    docs = _hashed(spark, sf)
    return J.block_overrep(docs, docs.groupBy("md5").agg(F.count("*").alias("count")), 2)


@query("""SELECT source AS dataset, count(*) AS shards, count(*) FILTER (doc_id % 31 = 0) AS missing, count(*) FILTER (doc_id % 31 <> 0 AND doc_id % 17 = 0) AS size_mismatch,
count(*) FILTER (doc_id % 31 <> 0 AND doc_id % 13 = 0) AS bad_members, CASE WHEN count(*) FILTER (doc_id % 31 = 0 OR doc_id % 17 = 0 OR doc_id % 13 = 0) = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM documents GROUP BY 1""")
def manifest_verify(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"))
    listing = docs.where("doc_id % 31 <> 0").select("path", F.when(F.col("doc_id") % 17 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("doc_id") % 13 == 0, 0).otherwise(10_000).alias("members"))
    return J.manifest_verify(docs, listing)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_remaining(spark, sf):
    done = read_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.resume_remaining(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


_INSPECT = "SELECT o_orderkey, o_orderstatus AS Project, o_orderpriority AS TB, o_custkey % 40 AS CompName, CASE WHEN o_orderkey % 2 = 0 THEN 'TOP' ELSE 'BOT' END AS TOP_BOT, o_custkey % 3 AS TB_Panel FROM orders"


@query(f"""WITH i AS ({_INSPECT}), g AS (SELECT Project, TB, CompName, TOP_BOT, TB_Panel, max(o_orderkey) AS golden_path FROM i WHERE o_orderkey % 5 = 0 GROUP BY ALL)
SELECT o_orderkey, golden_path FROM i JOIN g USING (Project, TB, CompName, TOP_BOT, TB_Panel)""")
def golden_join(spark, sf):
    c = F.col
    rows = read_table(spark, sf, "orders").select("o_orderkey", c("o_orderstatus").alias("Project"), c("o_orderpriority").alias("TB"), (c("o_custkey") % 40).alias("CompName"), F.when(c("o_orderkey") % 2 == 0, "TOP").otherwise("BOT").alias("TOP_BOT"), (c("o_custkey") % 3).alias("TB_Panel"))
    golden = rows.where("o_orderkey % 5 = 0").groupBy("Project", "TB", "CompName", "TOP_BOT", "TB_Panel").agg(F.max("o_orderkey").alias("directory"))
    return J.golden_join(rows, golden).select("o_orderkey", "golden_path")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'in' ELSE 'out' END AS side FROM documents")
def split_by_list(spark, sf):
    inside, outside = J.split_by_list(read_table(spark, sf, "documents").select("doc_id"), read_table(spark, sf, "labels"), "doc_id")
    return inside.withColumn("side", F.lit("in")).unionByName(outside.withColumn("side", F.lit("out")))


_BOX = "SELECT l_orderkey AS image_id, l_partkey * 1000 + l_suppkey AS id, CAST(l_partkey % 30 AS DOUBLE) AS x1, CAST(l_suppkey % 20 AS DOUBLE) AS y1, l_partkey % 30 + l_quantity AS x2, l_suppkey % 20 + l_quantity AS y2, l_linenumber % 2 AS side, l_quantity AS q FROM lineitem"


def boxes(spark, sf):
    c = F.col
    return read_table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("image_id"), (c("l_partkey") * 1000 + c("l_suppkey")).alias("id"), (c("l_partkey") % 30).cast("double").alias("x1"), (c("l_suppkey") % 20).cast("double").alias("y1"),
        (c("l_partkey") % 30 + c("l_quantity")).alias("x2"), (c("l_suppkey") % 20 + c("l_quantity")).alias("y2"), (c("l_linenumber") % 2).alias("side"),
    )


_I = "((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_A, _B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"
_HULL = "((greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)))"
for _mode, _sql in {"iou": f"{_I} / ({_A} + {_B} - {_I})", "iof": f"{_I} / {_A}", "giou": f"{_I} / ({_A} + {_B} - {_I}) - ({_HULL} - ({_A} + {_B} - {_I})) / {_HULL}"}.items():

    def _overlap(spark, sf, mode=_mode):
        b = boxes(spark, sf)
        return J.box_overlap_join(b.where("side = 0"), b.where("side = 1"), mode).withColumn("overlap", F.round("overlap", 9))

    query(f"WITH x AS ({_BOX}) SELECT a.image_id, a.id AS a_id, b.id AS b_id, round({_sql}, 9) AS overlap FROM x a JOIN x b ON a.image_id = b.image_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 WHERE a.side = 0 AND b.side = 1", name="box_overlap_join" if _mode == "iou" else f"box_overlap_join_{_mode}")(_overlap)


@query("""WITH p AS (SELECT user_id AS frame, value AS x, CAST(event_id % 60 AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS z FROM events), b AS (SELECT c_custkey AS box_id, c_custkey % 150 AS frame, CAST(c_custkey % 40 AS DOUBLE) AS cx, CAST(c_nationkey AS DOUBLE) AS cy, 3.0 AS cz, 30.0 AS dx, 25.0 AS dy, 4.5 AS dz, c_custkey % 6 * 0.5 AS h FROM customer)
SELECT b.frame, box_id, count(*) FILTER (abs((x - cx) * cos(h) + (y - cy) * sin(h)) <= dx / 2 AND abs(-(x - cx) * sin(h) + (y - cy) * cos(h)) <= dy / 2 AND abs(z - cz) <= dz / 2) AS n_points FROM b LEFT JOIN p ON b.frame = p.frame GROUP BY ALL""")
def points_in_boxes(spark, sf):
    c = F.col
    points = read_table(spark, sf, "events").select(c("user_id").alias("frame"), c("value").alias("x"), (c("event_id") % 60).cast("double").alias("y"), (c("event_id") % 7).cast("double").alias("z"))
    b = read_table(spark, sf, "customer").select((c("c_custkey") % 150).alias("frame"), c("c_custkey").alias("box_id"), (c("c_custkey") % 40).cast("double").alias("cx"), c("c_nationkey").cast("double").alias("cy"), F.lit(3.0).alias("cz"), F.lit(30.0).alias("dx"), F.lit(25.0).alias("dy"), F.lit(4.5).alias("dz"), (c("c_custkey") % 6 * 0.5).alias("heading"))
    return J.points_in_boxes(points, b)
