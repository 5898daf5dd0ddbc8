"""Sources and sinks: file listings, archives, metadata, labels, shards and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions.common import global_index
from loomfield.sources.records import RANGE_BYTES, json_ranges, json_records
from loomfield.sources.tar import src_tar_samples

_PATH = "^(.*)/([^/]*?)(?:\\.([^./]*))?$"


def src_scan_files(spark: SparkSession, root: str, exts: tuple[str, ...] = ()) -> DataFrame:
    """path, dir, stem, ext, size of all files below root with one of the extensions; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    parts = files.select("path", F.regexp_extract("path", _PATH, 1).alias("dir"), F.regexp_extract("path", _PATH, 2).alias("stem"), F.lower(F.regexp_extract("path", _PATH, 3)).alias("ext"), "size")
    return parts.where(F.col("ext").isin(*exts)) if exts else parts


def src_read_tar_samples(spark: SparkSession, root: str) -> DataFrame:
    """shard, key, members (map of extension to bytes): one row for each key of each tar; a broken tar gives what could be read of it."""
    return src_tar_samples(spark, root)


def src_case_metadata(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """The cases with dataset and case_id of case_mapping (source/dataset/case_NNNN[/slide]); the first record of each counts."""
    raw = spark.read.schema(schema).json(path, multiLine=multi_line).withColumns({"pos": F.monotonically_increasing_id(), "file": F.col("_metadata.file_path")})
    parts = F.split("case_mapping", "/")
    keyed = raw.withColumns({"dataset": F.get(parts, F.lit(1)), "case_id": F.regexp_extract(F.get(parts, F.lit(2)), "^case_(.*)$", 1)})
    first = F.row_number().over(Window.partitionBy("dataset", "case_id").orderBy("file", "pos"))
    return keyed.withColumn("r", first).where("r = 1").drop("r", "pos", "file")


def src_bad_files(spark: SparkSession, glob: str, dataset: str | None = None) -> DataFrame:
    """Distinct filepath of all logs, blank ones dropped."""
    rows = spark.read.csv(glob, header=True, schema="filepath string, dataset string, case string, error_category string, error_detail string, file_size long")
    rows = rows.where(F.col("dataset") == dataset) if dataset else rows
    return rows.select(F.trim("filepath").alias("filepath")).where("filepath <> ''").distinct()


def src_qc_progress(spark: SparkSession, glob: str) -> DataFrame:
    """dataset, slide_dir, checked, bad: a row for each completed folder."""
    rows = spark.read.schema("dataset string, completed_dirs array<string>, total_files_checked long, total_bad_files long").json(glob)
    return rows.select("dataset", F.explode("completed_dirs").alias("slide_dir"), F.col("total_files_checked").alias("checked"), F.col("total_bad_files").alias("bad"))


#: The 15 fields of a label line.
KITTI = ("cls string", "truncated double", "occluded int", "alpha double", "x1 double", "y1 double", "x2 double", "y2 double", "h double", "w double", "l double", "tx double", "ty double", "tz double", "ry double")


def src_kitti_labels(spark: SparkSession, glob: str) -> DataFrame:
    """frame_id (the file's stem) and 15 typed columns of label lines; what can't be read as a number is null."""
    lines = spark.read.text(glob).withColumn("frame_id", F.regexp_extract(F.input_file_name(), "([^/]*?)(?:\\.[^./]*)?$", 1)).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), "\\s+")
    return lines.select("frame_id", *(F.get(parts, F.lit(i)).try_cast(f.split()[1]).alias(f.split()[0]) for i, f in enumerate(KITTI)))


def src_coco_tables(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of detection sets' JSON, uncompressed: files are cut by byte ranges, so that a set of one huge file is many tasks' work."""
    ranges = json_ranges(spark, path, range_bytes)
    schemas = {
        "images": "id long, file_name string, height int, width int",
        "annotations": "id long, image_id long, category_id int, bbox array<double>, area double, iscrowd int",
        "categories": "id int, name string",
    }
    return tuple(json_records(ranges, name, schema) for name, schema in schemas.items())


def src_grounding_jsonl(spark: SparkSession, path: str, root: str, label_map: DataFrame | None = None) -> DataFrame:
    """file_name (below root), detection, grounding; with a label map (label, name) the instances' names as names."""
    box = "bbox:array<double>"
    raw = spark.read.schema(f"file_name string, detection struct<instances:array<struct<{box},label:string>>>, grounding struct<caption:string,regions:array<struct<{box},phrase:string>>>").json(path)
    out = raw.withColumn("file_name", F.concat_ws("/", F.lit(root), "file_name"))
    if label_map is None:
        return out
    named = label_map.agg(F.map_from_entries(F.collect_list(F.struct("label", "name"))).alias("m"))  # a label map is bounded
    return out.crossJoin(F.broadcast(named)).withColumn("names", F.transform("detection.instances", lambda i: F.col("m")[i["label"]])).drop("m")


def src_class_folders(files: DataFrame, classes: tuple[str, ...] | None = None) -> DataFrame:
    """path, class_name, class_id: the parent folder, numbered in the order of classes or of sorted names; others are -1."""
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("class_name"))
    if classes:
        ids = F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, i)))
        return named.withColumn("class_id", F.coalesce(ids[F.col("class_name")], F.lit(-1)))
    names = named.agg(F.array_sort(F.collect_set("class_name")).alias("names")).select(F.posexplode("names").alias("class_id", "class_name"))
    return named.join(names, "class_name", "left").select("path", "class_name", F.coalesce("class_id", F.lit(-1)).alias("class_id"))


def src_gt_pairs(spark: SparkSession, tsv: str, files: DataFrame) -> DataFrame:
    """path, label of the listed pairs whose file (path, size) exists and isn't empty."""
    pairs = spark.read.csv(tsv, sep="\t", schema="path string, label string", quote="")
    return pairs.join(files.where("size > 0").select("path"), "path", "left_semi")


def src_reid_records(files: DataFrame, relabel: bool = False) -> DataFrame:
    """path, pid, camid (from 0) of file names like 0002_c1s1_x.jpg; pid -1 goes; relabelled, pids are numbered from 0."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", F.regexp_extract(name, "^(-?\\d+)_c(\\d+)", 1).try_cast("int").alias("pid"), (F.regexp_extract(name, "^(-?\\d+)_c(\\d+)", 2).try_cast("int") - 1).alias("camid")).where("pid <> -1")
    if not relabel:
        return rows
    ids = global_index(rows.select("pid").distinct(), "pid", name="new").withColumn("new", F.col("new").cast("int"))
    return rows.join(ids, "pid").select("path", F.col("new").alias("pid"), "camid")


def src_inspection_files(files: DataFrame, top_bot: str = "all") -> DataFrame:
    """file, project, board, tb of names like project_board_TOP.csv, or project~board~TOP.csv; only TOP or BOT, unless all."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    parts = F.when(name.contains("~"), F.split(name, "~")).otherwise(F.split(name, "_"))
    rows = files.select(F.col("path").alias("file"), F.get(parts, F.lit(0)).alias("project"), F.get(parts, F.lit(1)).alias("board"), F.upper(F.get(parts, F.lit(2))).alias("tb"))
    return rows if top_bot == "all" else rows.where(F.col("tb") == top_bot.upper())


def src_source_listing(listing: DataFrame, col: str = "listing") -> DataFrame:
    """path, rate of texts like "a:0.5,b" (rate 1 if none is given)."""
    each = listing.select(F.explode(F.split(col, ",")).alias("item")).select(F.trim("item").alias("item")).where("item <> ''")
    rate = F.regexp_extract("item", "^(.*):([0-9.eE+-]+)$", 2).try_cast("double")
    return each.select(F.when(rate.isNotNull(), F.regexp_extract("item", "^(.*):([0-9.eE+-]+)$", 1)).otherwise(F.col("item")).alias("path"), F.coalesce(rate, F.lit(1.0)).alias("rate"))


def sink_shards(df: DataFrame, out: str) -> None:
    """Write rows (subdir, shard_id, idx, ...) sorted by idx, one folder for each shard; writing again replaces only the shards that df holds."""
    ready = df.repartition("subdir", "shard_id").sortWithinPartitions("shard_id", "idx")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subdir", "shard_id").parquet(out)


def sink_manifest(df: DataFrame, size: str = "size") -> DataFrame:
    """subdir, shard_id, path, size, n."""
    sums = df.groupBy("subdir", "shard_id").agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    return sums.withColumn("path", F.concat(F.col("subdir").cast("string"), F.lit("/shard_"), F.lpad(F.col("shard_id").cast("string"), 6, "0"), F.lit(".tar")))


def sink_selection_report(selected: DataFrame, lists: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """A flat table, arrays joined by ;, and one row for each site with its cases."""
    flat = selected.withColumns({c: F.concat_ws(";", c) for c in lists})
    # a selection is bounded by its target for each site
    nested = selected.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("key", *(c for c in selected.columns if c not in ("site", "key"))))).alias("cases"))
    return flat, nested


def sink_numbered_pairs(df: DataFrame, image: str, label: str, *order: str) -> DataFrame:
    """name, value: image-%09d and label-%09d from 1 on in order, and num-samples."""
    rows = global_index(df, *order)
    named = rows.select(F.inline(F.array(*(F.struct(F.format_string(f"{n}-%09d", F.col("idx") + 1).alias("name"), F.col(c).cast("string").alias("value")) for n, c in (("image", image), ("label", label))))))
    return named.unionByName(rows.agg(F.lit("num-samples").alias("name"), F.count("*").cast("string").alias("value")))
