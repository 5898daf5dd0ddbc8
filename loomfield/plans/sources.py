"""Queries of sources, sinks and streams: the driver's tables are written in the format and read back by the source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomfield.functions.common import global_index, read_table, shared_dir
from loomfield.operators import sampling
from loomfield.plans.registry import Plans
from loomfield.sources import files as S
from loomfield.sources import tar
from loomfield.streaming import samples as T

plans = Plans()
QUERIES, SQL, query = plans.QUERIES, plans.SQL, plans.query
c = F.col


def _new(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(count(DISTINCT source) AS BIGINT) AS dirs, 'csv' AS ext FROM documents")
def src_scan_files(spark, sf):
    out = _new(spark, "files")
    read_table(spark, sf, "documents").select("source", "lang").write.partitionBy("source").csv(out)
    return S.src_scan_files(spark, out, ("csv",)).agg(F.countDistinct("dir").alias("dirs"), F.min("ext").alias("ext"))


@query("SELECT dataset, case_id, key FROM (SELECT source AS dataset, lpad(CAST(doc_id % 200 AS VARCHAR), 4, '0') AS case_id, doc_id AS key, row_number() OVER (PARTITION BY source, doc_id % 200 ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def src_case_metadata(spark, sf):
    out = _new(spark, "cases")
    case = F.concat_ws("/", F.lit("src"), "source", F.concat(F.lit("case_"), F.lpad((c("doc_id") % 200).cast("string"), 4, "0")), F.lit("slide"))
    read_table(spark, sf, "documents").select(case.alias("case_mapping"), c("doc_id").alias("key")).repartitionByRange(8, "key").sortWithinPartitions("key").write.json(out)
    return S.src_case_metadata(spark, out, "case_mapping string, key long", multi_line=False).select("dataset", "case_id", "key")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS filepath FROM lineitem WHERE l_discount > 0.08 AND l_returnflag = 'R'")
def src_bad_files(spark, sf):
    out = _new(spark, "bad")
    rows = read_table(spark, sf, "lineitem").where("l_discount > 0.08").select(F.concat(F.lit(" "), "l_orderkey").alias("filepath"), c("l_returnflag").alias("dataset"), F.lit("x").alias("case"), F.lit("e").alias("error_category"), F.lit("d").alias("error_detail"), F.lit(1).alias("file_size"))
    rows.write.csv(out, header=True)
    return S.src_bad_files(spark, out, "R")


@query("SELECT l_returnflag AS dataset, CAST(l_suppkey AS VARCHAR) AS slide_dir, n AS checked, b AS bad FROM (SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem) JOIN (SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS b FROM lineitem GROUP BY 1) USING (l_returnflag)")
def src_qc_progress(spark, sf):
    out = _new(spark, "progress")
    read_table(spark, sf, "lineitem").groupBy(c("l_returnflag").alias("dataset")).agg(F.collect_set(c("l_suppkey").cast("string")).alias("completed_dirs"), F.count("*").alias("total_files_checked"), F.count(F.when(c("l_discount") > 0.05, 1)).alias("total_bad_files")).write.json(out)
    return S.src_qc_progress(spark, out)


@query("SELECT l_returnflag AS cls, count(*) AS n, round(sum(l_quantity), 3) AS x1, round(sum(l_tax), 3) AS ry FROM lineitem GROUP BY 1")
def src_kitti_labels(spark, sf):
    out = _new(spark, "labels")
    line = F.concat_ws(" ", "l_returnflag", F.lit("0.0 0 0.0"), "l_quantity", F.lit("1 2 3 4 5 6 7 8 9"), "l_tax")
    read_table(spark, sf, "lineitem").select(line.alias("value")).write.text(out)
    return S.src_kitti_labels(spark, out).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 3).alias("x1"), F.round(F.sum("ry"), 3).alias("ry"))


@query("SELECT s_suppkey AS image_id, n_name AS name, s_acctbal AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def src_coco_tables(spark, sf):
    out = _new(spark, "coco")
    images = read_table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.collect_list(F.struct(c("s_suppkey").alias("id"), c("s_name").alias("file_name"), F.lit(1).alias("height"), F.lit(2).alias("width"))).alias("images"),
        F.collect_list(F.struct(c("s_suppkey").alias("id"), c("s_suppkey").alias("image_id"), c("s_nationkey").alias("category_id"), F.array(F.lit(1.0)).alias("bbox"), c("s_acctbal").alias("area"), F.lit(0).alias("iscrowd"))).alias("annotations"),
    )
    names = read_table(spark, sf, "nation").select(c("n_nationkey").alias("s_nationkey"), F.array(F.struct(c("n_nationkey").alias("id"), c("n_name").alias("name"))).alias("categories"))
    images.join(names, "s_nationkey").drop("s_nationkey").repartition(64).write.option("maxRecordsPerFile", 1).json(out)
    _, anns, cats = S.src_coco_tables(spark, out)
    return anns.join(cats.withColumnRenamed("id", "category_id"), "category_id").select("image_id", "name", "area")


@query("SELECT 'root/' || conv_id AS file_name, count(*) AS n, any_value(names) AS names FROM conversations JOIN (SELECT conv_id, string_agg(upper(role), ',' ORDER BY turn) AS names FROM conversations GROUP BY 1) USING (conv_id) GROUP BY conv_id")
def src_grounding_jsonl(spark, sf):
    out = _new(spark, "grounding")
    conv = read_table(spark, sf, "conversations")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: F.struct(F.array(t["turn"].cast("double")).alias("bbox"), t["role"].alias("label")))
    conv.groupBy("conv_id").agg(F.struct(listed.alias("instances")).alias("detection")).select(c("conv_id").cast("string").alias("file_name"), "detection").write.json(out)
    names = conv.select(c("role").alias("label"), F.upper("role").alias("name")).distinct()
    return S.src_grounding_jsonl(spark, out, "root", names).select("file_name", F.size("names").cast("long").alias("n"), F.array_join("names", ",").alias("names"))


@query("SELECT 'a/' || source || '/' || doc_id AS path, source AS class_name, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS class_id FROM documents")
def src_class_folders(spark, sf):
    return S.src_class_folders(read_table(spark, sf, "documents").select(F.concat_ws("/", F.lit("a"), "source", "doc_id").alias("path")))


@query("SELECT p_partkey || '.jpg' AS path, p_name AS label FROM part WHERE p_size > 10")
def src_gt_pairs(spark, sf):
    out = _new(spark, "pairs")
    part = read_table(spark, sf, "part").select(F.concat("p_partkey", F.lit(".jpg")).alias("path"), c("p_name").alias("label"), "p_size")
    part.select("path", "label").write.csv(out, sep="\t")
    return S.src_gt_pairs(spark, out, part.select("path", F.when(c("p_size") > 10, c("p_size")).otherwise(0).alias("size")))


@query("SELECT CAST(dense_rank() OVER (ORDER BY label - 1) - 1 AS INTEGER) AS pid, vec_id % 6 AS camid, vec_id FROM embeddings WHERE label <> 0")
def src_reid_records(spark, sf):
    files = read_table(spark, sf, "embeddings").select(F.concat(F.lit("d/"), c("label") - 1, F.lit("_c"), c("vec_id") % 6 + 1, F.lit("s1_"), "vec_id", F.lit(".jpg")).alias("path"))
    return S.src_reid_records(files, relabel=True).select("pid", c("camid").cast("long").alias("camid"), F.regexp_extract("path", "_(\\d+)\\.jpg$", 1).cast("long").alias("vec_id"))


@query("SELECT o_orderkey, 'p' || o_custkey AS project, 'b' || o_orderkey AS board, 'TOP' AS tb FROM orders WHERE o_orderkey % 2 = 0")
def src_inspection_files(spark, sf):
    sep = F.when(c("o_orderkey") % 3 == 0, "~").otherwise("_")
    name = F.concat(F.lit("x/p"), "o_custkey", sep, F.lit("b"), "o_orderkey", sep, F.when(c("o_orderkey") % 2 == 0, "top").otherwise("bot"), F.lit(".csv"))
    return S.src_inspection_files(read_table(spark, sf, "orders").select(name.alias("path")), "TOP").select(F.substring("board", 2, 20).cast("long").alias("o_orderkey"), "project", "board", "tb")


@query("SELECT source AS path, CAST(CASE WHEN count(*) % 2 = 0 THEN count(*) / 10 ELSE 1 END AS DOUBLE) AS rate FROM documents GROUP BY 1")
def src_source_listing(spark, sf):
    n = read_table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    item = F.when(c("n") % 2 == 0, F.concat_ws(":", "source", c("n") / 10)).otherwise(c("source"))
    return S.src_source_listing(n.agg(F.array_join(F.collect_list(item), ", ").alias("listing")))


def _shards(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", c("n_chars").alias("size"))
    return sampling.assign_shards(global_index(docs, "doc_id"), size=200, per_subdir=2)


_SHARDS = "WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)"


@query(f"{_SHARDS} SELECT doc_id, idx, CAST(idx // 200 AS BIGINT) AS shard_id, CAST((idx // 200 // 2 + 1) * 2 AS BIGINT) AS subdir FROM o")
def sink_shards(spark, sf):
    out = _new(spark, "shards")
    shards = _shards(spark, sf)
    S.sink_shards(shards, out)
    S.sink_shards(shards.where("shard_id = 1"), out)  # writing one again leaves the others
    return spark.read.parquet(out).select("doc_id", "idx", c("shard_id").cast("long"), c("subdir").cast("long"))


_TAR = f"""{_SHARDS}, s AS (SELECT (idx // 200 // 2 + 1) * 2 || '/shard_' || lpad(CAST(idx // 200 AS VARCHAR), 6, '0') || '.tar' AS shard, lpad(CAST(idx AS VARCHAR), 9, '0') AS key, text, lang FROM o JOIN documents USING (doc_id))"""


def _tar(spark, sf):
    """The documents as tar shards of 200 samples, each a text and its language; the folder and the samples."""
    docs = _shards(spark, sf).join(read_table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    bytes_of = lambda name: F.coalesce(c(name).cast("binary"), F.lit(b""))
    out = _new(spark, "tar")
    samples = docs.select("subdir", "shard_id", "idx", "key", F.create_map(F.lit("txt"), bytes_of("text"), F.lit("lang"), bytes_of("lang")).alias("members"))
    tar.sink_tar_shards(samples, out)
    return out, samples


def _shard_name():
    return F.regexp_extract("shard", "([0-9]+/shard_[0-9]+\\.tar)$", 1).alias("shard")


@query(f"{_TAR} SELECT shard, key, strlen(coalesce(text, '')) AS n_bytes, md5(coalesce(text, '')) AS digest, coalesce(lang, '') AS lang FROM s")
def src_read_tar_samples(spark, sf):
    out, _ = _tar(spark, sf)
    text = c("members")["txt"]
    return tar.src_tar_samples(spark, out, range_bytes=100_000).select(_shard_name(), "key", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("digest"), c("members")["lang"].cast("string").alias("lang"))


@query(f"{_TAR} SELECT shard, key, 'txt' AS ext, strlen(coalesce(text, '')) AS size FROM s UNION ALL SELECT shard, key, 'lang', strlen(coalesce(lang, '')) FROM s")
def sink_tar_shards(spark, sf):
    out, samples = _tar(spark, sf)
    if tar.sink_tar_shards(samples, out):  # complete shards are left alone
        raise ValueError("a complete shard was written again")
    return tar.src_tar_members(spark, out).select(_shard_name(), "key", "ext", "size")


@query(f"{_SHARDS} SELECT CAST((idx // 200 // 2 + 1) * 2 AS BIGINT) AS subdir, CAST(idx // 200 AS BIGINT) AS shard_id, CAST(sum(n_chars) AS BIGINT) AS size, count(*) AS n, (idx // 200 // 2 + 1) * 2 || '/shard_' || lpad(CAST(idx // 200 AS VARCHAR), 6, '0') || '.tar' AS path FROM o GROUP BY ALL")
def sink_manifest(spark, sf):
    return S.sink_manifest(_shards(spark, sf))


@query("SELECT c_mktsegment AS site, count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1")
def sink_selection_report(spark, sf):
    chosen = read_table(spark, sf, "customer").where("c_custkey % 5 = 0").select(c("c_mktsegment").alias("site"), c("c_custkey").alias("key"), F.array("c_name").alias("names"))
    _, nested = S.sink_selection_report(chosen, ("names",))
    return nested.select("site", F.size("cases").cast("long").alias("n"), c("cases")[0]["key"].alias("first"))


@query("WITH o AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS i FROM part) SELECT 'image-' || lpad(CAST(i AS VARCHAR), 9, '0') AS name, CAST(p_partkey AS VARCHAR) AS value FROM o UNION ALL SELECT 'label-' || lpad(CAST(i AS VARCHAR), 9, '0'), p_name FROM o UNION ALL SELECT 'num-samples', CAST(count(*) AS VARCHAR) FROM o")
def sink_numbered_pairs(spark, sf):
    return S.sink_numbered_pairs(read_table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "p_partkey")


def _run(spark, stream):
    """The last result of a stream of running values over all that is there; each result is a table in the shared folder."""
    last = {}

    def keep(batch, batch_id):
        last["path"] = _new(spark, "result")
        batch.write.parquet(last["path"])

    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", _new(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last["path"]) if last else spark.createDataFrame([], stream.schema)


def _stream_of(spark, df):
    """A stream of a table, written in the partitions it has."""
    out = _new(spark, "stream-in")
    df.write.parquet(out)
    return spark.readStream.schema(df.schema).parquet(out)


@query("WITH n AS (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id, k AS image_key, round(1 / n, 9) AS weight FROM documents JOIN n ON md5(text) = k WHERE n <= 2")
def stream_ingest_samples(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    path, out = _new(spark, "ingest"), _new(spark, "ingested")
    docs.write.parquet(path)
    counts = docs.groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("count"))
    stream = T.stream_ingest_samples(spark, path, "doc_id long, text string", counts, max_count=2)
    T.stream_to_table(stream.drop("text"), out, _new(spark, "checkpoint"))
    return spark.read.parquet(out).select("doc_id", "image_key", F.round("weight", 9).alias("weight"))


@query("SELECT source AS dataset, count(*) AS seen, count(*) FILTER (n_chars <= 500) AS filtered, round(count(*) FILTER (n_chars <= 500) / count(*) * 100, 9) AS pct FROM documents GROUP BY 1")
def stream_filter_counters(spark, sf):
    stream = _stream_of(spark, read_table(spark, sf, "documents").select(c("source").alias("dataset"), "n_chars"))
    return _run(spark, T.stream_filter_counters(stream, c("n_chars") > 500)).withColumn("pct", F.round("pct", 9))


@query("WITH u AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT a.d - 1 AS i, b.d - 1 AS j, count(*) AS n, round(avg(a.x), 8) AS mean, round(covar_samp(a.x, b.x), 8) AS cov FROM u a JOIN u b USING (vec_id) GROUP BY ALL")
def stream_feature_stats(spark, sf):
    path, checkpoint, kept = _new(spark, "stats-in"), _new(spark, "stats"), _new(spark, "stats-state")
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    for part in (0, 1):  # the second run goes on with the state of the first
        vectors.where(c("vec_id") % 2 == part).select("embedding").write.mode("append").parquet(path)
        stream = spark.readStream.schema("embedding array<float>").parquet(path)
        stream.writeStream.foreachBatch(T.FeatureStats("embedding", kept)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    d = F.size("mean")
    cells = T.FeatureStats("embedding", kept).state(spark).select("n", "mean", d.alias("d"), F.posexplode("cov").alias("p", "x"))
    i = F.floor(c("p") / c("d")).cast("int")
    return cells.select(i.cast("long").alias("i"), (c("p") % c("d")).cast("long").alias("j"), "n", F.round(F.get("mean", i), 8).alias("mean"), F.round("x", 8).alias("cov"))


@query("SELECT count(*) AS n, count(*) FILTER ((l_quantity / 10 > 2) = (l_returnflag = 'R')) AS right, count(*) FILTER (l_returnflag = 'R') AS fails, count(*) FILTER (l_quantity / 10 > 2 AND l_returnflag = 'R') AS caught, count(*) FILTER (l_quantity / 10 > 2 AND l_returnflag <> 'R') AS false_alarms FROM lineitem".replace("AS right", 'AS "right"'))
def stream_metric_state(spark, sf):
    rows = read_table(spark, sf, "lineitem").select((c("l_quantity") / 10).alias("score"), (c("l_returnflag") == "R").cast("int").alias("label"))
    return _run(spark, T.stream_metric_state(_stream_of(spark, rows)))


@query("SELECT event_id, user_id FROM events")
def stream_resume(spark, sf):
    path, out, checkpoint = _new(spark, "resume"), _new(spark, "resumed"), _new(spark, "checkpoint")
    events = read_table(spark, sf, "events").select("event_id", "user_id")
    for part in (0, 1):  # the second run handles only what the first hasn't seen
        events.where(c("event_id") % 2 == part).write.mode("append").parquet(path)
        T.stream_to_table(spark.readStream.schema(events.schema).parquet(path), out, checkpoint)
    return spark.read.parquet(out)


@query("WITH r AS (SELECT user_id AS object, event_id AS frame, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events), s AS (SELECT object, frame, rn, unnest(generate_series(0, rn // 8)) AS seq FROM r) SELECT object, seq, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM s WHERE rn >= seq * 8 AND rn < seq * 8 + 20 GROUP BY ALL HAVING count(*) >= 5")
def stream_sequence_split(spark, sf):
    path = _new(spark, "frames")
    frames = read_table(spark, sf, "events").select(c("user_id").alias("object"), c("event_id").alias("frame"), F.lit(False).alias("ended"))
    cut = frames.agg(F.expr("percentile_approx(frame, 0.5)")).first()[0]
    ends = frames.select("object", F.lit(None).cast("long").alias("frame"), F.lit(True).alias("ended")).distinct()
    out, checkpoint = _new(spark, "sequences"), _new(spark, "checkpoint")
    # three runs of one stream: each goes on with the state of the one before, and the last one ends all objects
    for part in (frames.where(c("frame") <= cut), frames.where(c("frame") > cut), ends):
        part.write.mode("append").parquet(path)
        T.stream_to_table(T.stream_sequence_split(spark.readStream.schema(frames.schema).parquet(path), 20, 5, 8, ended="ended"), out, checkpoint)
    return spark.read.parquet(out)
