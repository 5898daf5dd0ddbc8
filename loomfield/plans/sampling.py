"""Queries of the sampling and mixing operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.common import global_index, read_table, seed_key
from loomfield.operators import sampling as S
from loomfield.plans.registry import Plans

plans = Plans()
QUERIES, SQL, query = plans.QUERIES, plans.SQL, plans.query
U = "((CAST(('0x' || substr(md5({x}), 1, 13)) AS UBIGINT) + 0.5) / 4503599627370496.0)"


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")


@query("""WITH o AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS idx FROM documents WHERE n_chars > 0)
SELECT idx // 100 AS shard_id, (idx // 100 // 10 + 1) * 10 AS subdir, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM o GROUP BY ALL""")
def flagship_manifest(spark, sf):
    docs = _docs(spark, sf).where("n_chars > 0").withColumn("order_key", seed_key(F.col("doc_id")))
    shards = S.assign_shards(global_index(docs, "order_key", "doc_id"), size=100, per_subdir=10)
    return shards.groupBy("shard_id", "subdir").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


@query("SELECT doc_id, md5('42:' || doc_id) AS order_key FROM documents ORDER BY order_key, doc_id")
def seeded_shuffle(spark, sf):
    return S.seeded_shuffle(_docs(spark, sf).select("doc_id"), "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS idx, lpad(CAST(row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS VARCHAR), 9, '0') AS key FROM documents", name="global_index")
def global_index_query(spark, sf):
    docs = _docs(spark, sf).select("doc_id").withColumn("order_key", seed_key(F.col("doc_id")))
    return global_index(docs, "order_key", "doc_id").select("doc_id", "idx", F.lpad(F.col("idx").cast("string"), 9, "0").alias("key"))


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
SELECT o_orderkey, idx, idx // 1000 AS shard_id, (idx // 1000 // 5 + 1) * 5 AS subdir, lpad(CAST(idx AS VARCHAR), 9, '0') AS key FROM o""")
def assign_shards(spark, sf):
    return S.assign_shards(global_index(read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey"), size=1000, per_subdir=5)


@query("SELECT doc_id, md5('7:' || doc_id) AS order_key FROM documents ORDER BY order_key, doc_id LIMIT 200")
def random_sample_n(spark, sf):
    return S.random_sample_n(_docs(spark, sf).select("doc_id"), "doc_id", 200, seed=7)


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang, CASE WHEN idx < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM o""")
def train_val_split(spark, sf):
    return S.train_val_split(_docs(spark, sf).select("doc_id", "lang"), "doc_id", 0.9)


@query("""WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END AS cls FROM labels),
n AS (SELECT count(*) FILTER (cls = 1) n1, count(*) FILTER (cls = 2) n2, count(*) FILTER (cls = 3) n3 FROM c),
q AS (SELECT least(n1, 150) q1, least(n2, CAST(floor((150 - least(n1, 150)) * 0.8) AS BIGINT)) q2, n3 FROM n),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cls ORDER BY md5('42:' || doc_id), doc_id) AS INTEGER) AS pick FROM c)
SELECT doc_id, cls, pick FROM r, q WHERE pick <= CASE cls WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE least(n3, 150 - q1 - q2) END""")
def stratified_sample(spark, sf):
    cls = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(3)
    return S.stratified_sample(read_table(spark, sf, "labels").select("doc_id", cls.alias("cls")), "doc_id", "cls", 150)


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_suppkey, l_shipdate, md5('42:' || concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS k FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM p WHERE l_returnflag = 'N' ORDER BY k, l_orderkey LIMIT 15000)
SELECT l_returnflag, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM p WHERE l_returnflag <> 'N') GROUP BY 1""")
def cap_majority(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_returnflag", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))
    return S.cap_majority(rows, "k", F.col("l_returnflag") == "N").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT source AS path, CAST(count(*) AS DOUBLE) AS rate FROM documents GROUP BY 1 UNION ALL SELECT source, CAST(0.5 * count(*) AS DOUBLE) FROM documents GROUP BY 1)
SELECT path, round(sum(rate) / (SELECT sum(rate) FROM l), 12) AS rate FROM l GROUP BY path""")
def normalize_rates(spark, sf):
    n = _docs(spark, sf).groupBy(F.col("source").alias("path")).agg(F.count("*").cast("double").alias("rate"))
    return S.normalize_rates(n.union(n.withColumn("rate", F.col("rate") * 0.5))).withColumn("rate", F.round("rate", 12))


@query("""WITH s AS (SELECT DISTINCT source, doc_id // 40 AS shard FROM documents), r(reader, rate) AS (VALUES (0, 3.0), (1, 2.0), (2, 1.0)),
z AS (SELECT source, reader, n, floor(n * rate / 6.0) AS whole, n * rate / 6.0 - floor(n * rate / 6.0) AS part FROM (SELECT source, count(*) AS n FROM s GROUP BY 1), r),
t AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY part DESC, reader) <= n - sum(whole) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS take FROM z),
g AS (SELECT source, reader, sum(take) OVER (PARTITION BY source ORDER BY reader) AS stop, take FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || concat_ws('/', source, shard)), shard) - 1 AS ix FROM s),
d AS (SELECT k.source, k.shard, g.reader FROM k JOIN g ON k.source = g.source AND k.ix >= g.stop - g.take AND k.ix < g.stop)
SELECT source, shard, reader, CAST((row_number() OVER (PARTITION BY source, reader ORDER BY shard) - 1) % 2 AS INTEGER) AS worker FROM d""")
def allocate_shards(spark, sf):
    shards = _docs(spark, sf).select("source", F.floor(F.col("doc_id") / 40).alias("shard")).distinct()
    return S.allocate_shards(shards, spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 1.0)], "reader int, rate double"), workers=2)


@query("""WITH s AS (SELECT DISTINCT source, doc_id // 40 AS shard FROM documents), v AS (SELECT source, doc_id // 40 AS shard, count(*) AS visits FROM documents WHERE lang <> 'en' GROUP BY ALL)
SELECT source, shard, coalesce(visits, 0) AS visits, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(visits, 0), md5('42:3:' || concat_ws('/', source, shard)), shard) AS INTEGER) AS pick FROM s LEFT JOIN v USING (source, shard)""")
def least_visited_shards(spark, sf):
    docs = _docs(spark, sf).withColumn("shard", F.floor(F.col("doc_id") / 40))
    visits = docs.where("lang <> 'en'").groupBy("source", "shard").agg(F.count("*").alias("visits"))
    return S.least_visited_shards(docs.select("source", "shard").distinct(), visits, epoch=3)


@query(f"""SELECT doc_id, round(-ln({U.format(x="'42:' || doc_id")}) / n_chars, 15) AS res_key FROM documents WHERE n_chars > 0 ORDER BY -ln({U.format(x="'42:' || doc_id")}) / n_chars, doc_id LIMIT 300""")
def weighted_reservoir(spark, sf):
    return S.weighted_reservoir(_docs(spark, sf), "doc_id", "n_chars", 300).select("doc_id", F.round("res_key", 15).alias("res_key"))


_SCHEDULE = """WITH r AS (SELECT source, count(*) AS rate FROM documents GROUP BY 1), s AS (SELECT source, rate / sum(rate) OVER () AS share FROM r),
d AS (SELECT source, j AS ordinal, (j + 0.5) / share AS due FROM s, unnest(generate_series(0, CAST(ceil(share * {n}) AS BIGINT))) AS t(j)),
p AS (SELECT row_number() OVER (ORDER BY due, source) - 1 AS pos, source, CAST(ordinal AS INTEGER) AS ordinal FROM d)"""


@query(_SCHEDULE.format(n=5000) + " SELECT * FROM p WHERE pos < 5000")
def mixture_schedule(spark, sf):
    return S.mixture_schedule(_docs(spark, sf).groupBy("source").agg(F.count("*").alias("rate")), 5000)


@query(_SCHEDULE.format(n=500) + f""", q AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY -ln({U.format(x="'42:' || doc_id")}) / n_chars, doc_id) - 1 AS ordinal FROM documents WHERE n_chars > 0)
SELECT pos, source, doc_id FROM p JOIN q USING (source, ordinal) WHERE pos < 500""")
def mix_sources(spark, sf):
    docs = _docs(spark, sf)
    return S.mix_sources(docs, docs.groupBy("source").agg(F.count("*").alias("rate")), 500, "doc_id", "n_chars")


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 0) p, count(*) FILTER (toxic = 1) f FROM labels)
SELECT doc_id, toxic, CASE WHEN toxic = 0 THEN 1.0 ELSE p / f * 0.5 END AS weight FROM labels, c""")
def class_weights(spark, sf):
    return S.class_weights(read_table(spark, sf, "labels").select("doc_id", "toxic"), F.col("toxic") == 0, 0.5)


@query("SELECT doc_id, source, (count(*) OVER () - count(*) OVER (PARTITION BY source)) / count(*) OVER () AS weight FROM documents")
def source_weights(spark, sf):
    return S.source_weights(_docs(spark, sf).select("doc_id", "source"))


@query(f"""WITH e AS (SELECT doc_id, unnest(list_distinct([lang, source])) AS class FROM documents), n AS (SELECT class, count(*) AS n FROM e GROUP BY 1),
d AS (SELECT class, n, CAST(floor(n * (1 / count(*) OVER ()) / (n / sum(n) OVER ())) AS INTEGER) AS m FROM n),
x AS (SELECT class, CAST(j AS INTEGER) AS draw, floor({U.format(x="'42:' || class || '/' || j")} * n) AS ix FROM d, unnest(generate_series(0, m - 1)) AS t(j)),
k AS (SELECT class, doc_id, row_number() OVER (PARTITION BY class ORDER BY md5('42:' || class || '/' || doc_id), doc_id) - 1 AS ix FROM e)
SELECT class, draw, doc_id FROM x JOIN k USING (class, ix)""")
def class_balanced_resample(spark, sf):
    return S.class_balanced_resample(_docs(spark, sf).withColumn("classes", F.array("lang", "source")), "doc_id", "classes")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || event_id), event_id) - 1 AS ix, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT event_id, user_id, n, unnest(CASE WHEN n >= 4 THEN [ix] ELSE list_filter(range(4), lambda s: s % n = ix) END) AS s FROM r),
w AS (SELECT event_id, user_id, s // 4 AS chunk, s % 4 AS within FROM p WHERE n < 4 OR s < n // 4 * 4),
c AS (SELECT user_id, chunk, row_number() OVER (ORDER BY md5('42:' || user_id || '/' || chunk), user_id, chunk) - 1 AS ix FROM (SELECT DISTINCT user_id, chunk FROM w))
SELECT ix // 8 AS batch, ix % 8 * 4 + within AS slot, event_id FROM w JOIN c USING (user_id, chunk)""")
def identity_batches(spark, sf):
    return S.identity_batches(read_table(spark, sf, "events"), "event_id", "user_id", p=8, k=4)


@query("""WITH z AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), a AS (SELECT lang, CAST(j AS INTEGER) AS draw, j // size AS turn, j % size AS ix FROM z, unnest(generate_series(0, 599)) AS t(j)),
k AS (SELECT doc_id, d.lang, turn, row_number() OVER (PARTITION BY d.lang, turn ORDER BY md5('42:' || turn || '/' || doc_id), doc_id) - 1 AS ix FROM documents d JOIN (SELECT DISTINCT lang, turn FROM a) t ON d.lang = t.lang)
SELECT draw // 60 AS call, lang, draw % 60 AS slot, doc_id FROM a JOIN k USING (lang, turn, ix)""")
def group_sample(spark, sf):
    return S.group_sample(_docs(spark, sf), "doc_id", "lang", n=60, calls=10)


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || event_id), event_id) - 1 AS ix, count(*) OVER (PARTITION BY user_id) AS size FROM events)
SELECT user_id, CAST(s AS INTEGER) AS slot, event_id FROM (SELECT user_id, event_id, unnest(list_filter(range(5), lambda s: s % size = ix)) AS s FROM r WHERE ix < 5)""")
def pick_references(spark, sf):
    return S.pick_references(read_table(spark, sf, "events"), "event_id", "user_id", 5)


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents) SELECT doc_id, idx, idx // 64 AS batch_id FROM o WHERE idx // 64 < n // 64""")
def fixed_batches(spark, sf):
    return S.fixed_batches(global_index(_docs(spark, sf).select("doc_id"), "doc_id"), 64)


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS size FROM documents),
p AS (SELECT doc_id, lang, size, unnest(CASE WHEN ix < CAST(ceil(size / 8) AS BIGINT) * 8 - size THEN [ix, ix + size] ELSE [ix] END) AS ix FROM r)
SELECT lang, ix // CAST(ceil(size / 8) AS BIGINT) AS shard, ix % CAST(ceil(size / 8) AS BIGINT) AS slot, doc_id FROM p""")
def even_shards_padded(spark, sf):
    return S.even_shards_padded(_docs(spark, sf), "doc_id", "lang", 8)
