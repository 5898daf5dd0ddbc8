"""Projections, filters and predicates over samples, files, labels, boxes and pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_IMAGENET, _CLIP, _HALF = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)), ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))
#: Channel means and deviations of public normalisation presets (fixed values).
PRESETS: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = {
    "pathology_h_optimus": ((0.707223, 0.578729, 0.703617), (0.211883, 0.230117, 0.177517)),
    "pathology_gigapath": _IMAGENET,
    "pathology_uni2h": _IMAGENET,
    "imagenet": _IMAGENET,
    "openai_clip": _CLIP,
    "c_radio_v2": _HALF,
    "siglip2": _CLIP,
    "dinov3": _CLIP,
}
#: The preset of each model (fixed values); any other takes imagenet.
MODEL_PRESETS = {
    "h_optimus_0": "pathology_h_optimus",
    "prov_gigapath": "pathology_gigapath",
    "uni2_h": "pathology_uni2h",
    "c_radio_v2": "c_radio_v2",
    "c_radio_v3": "openai_clip",
    "c_radio_v4": "openai_clip",
    "siglip2": "siglip2",
    "dinov3": "dinov3",
}
#: Limits of the file checks (fixed values): least bytes, expected side, deviation of a blank image, brightest and darkest mean.
MIN_BYTES, SIDE, BLANK_STD, BRIGHT, DARK = 1024, 1024, 2.0, 250, 5


def sample_key(df: DataFrame, json: str = "json", content: str = "content") -> DataFrame:
    """df with image_key: the first of the JSON's sha256, md5, uid, else the SHA-256 of the content."""
    return df.withColumn("image_key", F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in ("sha256", "md5", "uid")), F.sha2(F.col(content), 256)))


def caption_fill(df: DataFrame, txt: str = "txt", json: str = "json", drop_empty: bool = False) -> DataFrame:
    """df with txt filled from the JSON's caption; with drop_empty from its text or caption, and without empty ones."""
    if not drop_empty:
        return df.withColumn(txt, F.coalesce(F.col(txt), F.get_json_object(json, "$.caption")))
    filled = F.coalesce(F.col(txt), F.get_json_object(json, "$.text"), F.get_json_object(json, "$.caption"))
    return df.withColumn(txt, filled).where(F.length(txt) > 0)


def caption_preview(df: DataFrame, text: str = "txt", n: int = 100) -> DataFrame:
    return df.withColumn("caption", F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(F.col(text)))


def member_filter(df: DataFrame, formats: tuple[str, ...], members: str = "members") -> DataFrame:
    """Rows with a member of one of the formats; a dotted name counts and is renamed by its last part."""
    last = lambda k: F.element_at(F.split(k, "\\."), -1)
    kept = df.where(F.exists(F.map_keys(members), lambda k: last(k).isin(*formats)))
    renamed = F.transform(F.map_entries(members), lambda e: F.struct(F.when(last(e["key"]).isin(*formats), last(e["key"])).otherwise(e["key"]), e["value"]))
    return kept.withColumn(members, F.map_from_entries(renamed))


def drop_members(df: DataFrame, names: tuple[str, ...] = ("pkl",), members: str = "members") -> DataFrame:
    return df.withColumn(members, F.map_filter(members, lambda k, _: ~k.isin(*names)))


def tag_source(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn("dataset", F.lit(path))


def extract_field(df: DataFrame, src: str, dest: str) -> DataFrame:
    """df with a nested field such as a.b.0 (numbers index arrays) as column dest."""
    head, *path = src.split(".")
    return df.withColumn(dest, reduce(lambda c, p: c[int(p)] if p.isdigit() else c[p], path, F.col(head)))


def raw_json_key(df: DataFrame, col: str, keys: tuple[str, ...], out: str = "key") -> DataFrame:
    """df with the value of the first key that the raw JSON text holds as a string or number, else null."""
    found = [F.nullif(F.regexp_extract(col, f'"{k}": ?"?([^",}}]*)', 1), F.lit("")) for k in keys]
    return df.withColumn(out, F.coalesce(*found))


def uniform_filter(pixels: DataFrame, threshold: float = 1.0) -> DataFrame:
    """id, spread of the samples whose channels (id, ch, v) spread more than threshold."""
    ranges = pixels.groupBy("id", "ch").agg((F.max("v") - F.min("v")).alias("r"))
    return ranges.groupBy("id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("spread")).where(F.col("spread") > threshold)


def qc_checks(files: DataFrame, pixel_checks: bool = True) -> DataFrame:
    """filepath, error_category, error_detail, file_size: 0 to n rows for each file (path, ext, size, format, width, height, mode, mean, std)."""
    c = F.col
    err = lambda cond, category, detail: F.when(cond, F.struct(F.lit(category).alias("error_category"), detail.alias("error_detail")))
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    jpeg = F.lower("ext").isin("jpg", "jpeg")
    whole = c("size") >= MIN_BYTES
    checks = [
        err(~jpeg, "non_jpeg_file", text("expected JPEG, got .", F.lower("ext"))),
        err(c("size") == 0, "empty_file", F.lit("0 bytes")),
        err((c("size") > 0) & ~whole, "suspiciously_small", text(c("size"), f" bytes (min {MIN_BYTES})")),
        err(whole & (c("format") != F.when(jpeg, "JPEG").otherwise("PNG")), "format_mismatch", text("got ", c("format"))),
        err(whole & ((c("width") != SIDE) | (c("height") != SIDE)), "dimension_error", text(c("width"), "x", c("height"))),
        err(whole & (c("mode") != "RGB"), "mode_error", text("got ", c("mode"))),
    ]
    if pixel_checks:
        checks += [
            err(whole & (c("std") < BLANK_STD), "blank_uniform", text("std ", F.round("std", 2))),
            err(whole & (c("mean") > BRIGHT), "extreme_brightness", text("mean ", F.round("mean", 2))),
            err(whole & ~(c("mean") > BRIGHT) & (c("mean") < DARK), "extreme_darkness", text("mean ", F.round("mean", 2))),
        ]
    return files.select(F.col("path").alias("filepath"), F.col("size").alias("file_size"), F.explode(F.array_compact(F.array(*checks))).alias("e")).select("filepath", "e.*", "file_size")


def header_magic(df: DataFrame, content: str = "content") -> DataFrame:
    """df with is_jpeg: at least four bytes, the first two FF D8."""
    return df.withColumn("is_jpeg", (F.octet_length(content) >= 4) & (F.hex(F.substring(content, 1, 2)) == "FFD8"))


def category_table(class_map: DataFrame) -> DataFrame:
    """id, name of the distinct target classes, from 1, names descending (a map is bounded by its classes)."""
    names = class_map.agg(F.sort_array(F.collect_set("target"), asc=False).alias("names"))
    return names.select(F.posexplode("names").alias("pos", "name")).select((F.col("pos") + 1).alias("id"), "name")


def kitti_to_coco(labels: DataFrame, class_map: DataFrame) -> DataFrame:
    """label_id, frame_id, category_id, x, y, w, h, area, iscrowd of the labels (label_id, frame_id, cls, x1, y1, x2, y2) of mapped classes with a proper box."""
    target = class_map.select(F.lower("cls").alias("key"), "target").join(category_table(class_map), F.col("target") == F.col("name")).select("key", F.col("id").alias("category_id"))
    boxes = labels.where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))).join(target, F.lower("cls") == F.col("key"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.select("label_id", "frame_id", "category_id", F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))


def clip_boxes(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Boxes (x, y, w, h) as corners within their image; empty ones go."""
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.col(most).cast("double"))
    out = boxes.withColumns({"x1": inside(F.col("x"), width), "y1": inside(F.col("y"), height), "x2": inside(F.col("x") + F.col("w"), width), "y2": inside(F.col("y") + F.col("h"), height)})
    return out.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def coco_filter(anns: DataFrame, images: DataFrame | None = None, cat_ids: tuple[int, ...] = (), area: tuple[float, float] | None = None, iscrowd: int | None = None) -> DataFrame:
    """Annotations by image ids, category ids, open area range and crowd flag."""
    out = anns.join(images.select("image_id").distinct(), "image_id", "left_semi") if images is not None else anns
    out = out.where(F.col("category_id").isin(*cat_ids)) if cat_ids else out
    out = out.where((F.col("area") > area[0]) & (F.col("area") < area[1])) if area else out
    return out.where(F.col("iscrowd") == iscrowd) if iscrowd is not None else out


def category_lookup(cats: DataFrame, names: tuple[str, ...] = (), supers: tuple[str, ...] = (), ids: tuple[int, ...] = ()) -> DataFrame:
    """Ids of categories (id, name, supercategory) by any of the three."""
    for col, wanted in (("name", names), ("supercategory", supers), ("id", ids)):
        cats = cats.where(F.col(col).isin(*wanted)) if wanted else cats
    return cats.select("id")


def drop_classes(labels: DataFrame, classes: tuple[str, ...], cls: str = "cls") -> DataFrame:
    return labels.where(~F.col(cls).isin(*classes))


def label_text_filter(df: DataFrame, max_len: int, charset: str, text: str = "label") -> DataFrame:
    """Rows whose label isn't too long and, in lower case, has characters of the set (a regular expression's class) only."""
    return df.where((F.length(text) <= max_len) & ~F.lower(text).rlike(f"[^{charset}]"))


def db_filters(objs: DataFrame, removed: tuple[int, ...], min_points: DataFrame) -> DataFrame:
    """Objects (cls, difficulty, n_points) not of a removed difficulty and with their class's least points (cls, least), if it has any."""
    kept = objs.where(~F.col("difficulty").isin(*removed)).join(min_points, "cls", "left")
    return kept.where(F.col("n_points") >= F.coalesce("least", F.lit(0))).drop("least")


def path_pattern_pairs(files: DataFrame, left: str, right: str, depth: str, suffix: str, depth_suffix: str) -> DataFrame:
    """left_path, right_path, depth_path of the files whose path holds the pattern left and ends in suffix."""
    found = files.where(F.col("path").contains(left) & F.col("path").endswith(suffix))
    swap = lambda to: F.replace(F.col("path"), F.lit(left), F.lit(to))
    stem = F.expr(f"substring(path, 1, length(path) - {len(suffix)})")
    return found.select(F.col("path").alias("left_path"), swap(right).alias("right_path"), F.concat(F.replace(stem, F.lit(left), F.lit(depth)), F.lit(depth_suffix)).alias("depth_path"))


def model_preset(model: str) -> str:
    """The preset of a model, whatever its case."""
    return MODEL_PRESETS.get(model.lower(), "imagenet")


def channel_normalize(df: DataFrame, values: str = "channels", preset: str = "imagenet", model: str | Column | None = None) -> DataFrame:
    """df with normalised: (x - mean) / deviation of each channel, by a preset, a model's preset, or those of a column of model names; an unknown preset is an error, a null model takes the default."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; there are {sorted(PRESETS)}")
    pairs = lambda name: F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(*PRESETS[name], strict=True)))
    chosen = pairs(model_preset(model) if isinstance(model, str) else preset)
    if isinstance(model, Column):
        chosen = pairs("imagenet")
        for name in sorted(set(MODEL_PRESETS.values())):
            chosen = F.when(F.lower(model).isin([m for m, p in MODEL_PRESETS.items() if p == name]), pairs(name)).otherwise(chosen)
    return df.withColumn("normalised", F.zip_with(values, chosen, lambda x, p: (x - p["m"]) / p["s"]))


def validate_samples(samples: DataFrame, sha256_check: bool = False) -> DataFrame:
    """key, status: the first check that a sample (key, jpg, json) fails, else OK."""
    parsed = F.try_parse_json(F.col("json"))
    sha = F.get_json_object("json", "$.sha256")
    missing = F.nullif(F.concat_ws("+", F.when(F.col("jpg").isNull(), "MISSING_JPG"), F.when(F.col("json").isNull(), "MISSING_JSON")), F.lit(""))
    steps = [
        missing,
        F.when(F.octet_length("jpg") == 0, "JPEG_EMPTY"),
        F.when((F.octet_length("jpg") < 4) | (F.hex(F.substring("jpg", 1, 2)) != "FFD8"), "BAD_JPEG_HEADER"),
        F.when(F.length(F.trim("json")) == 0, "JSON_EMPTY"),
        F.when(parsed.isNull(), "JSON_PARSE_ERROR"),
    ]
    if sha256_check:
        steps += [F.when(F.coalesce(sha, F.lit("")) == "", "JSON_MISSING_SHA256"), F.when(sha != F.sha2("jpg", 256), "SHA256_MISMATCH")]
    return samples.select("key", F.coalesce(*steps, F.lit("OK")).alias("status"))


def size_filter(anns: DataFrame, images: DataFrame, lo: float, hi: float) -> DataFrame:
    """Annotations with kept: the box lies in its image, lo < area < hi and both sides exceed 2."""
    c = F.col
    joined = anns.join(images, "image_id")
    good = (c("x") >= 0) & (c("y") >= 0) & (c("x") + c("w") <= c("width")) & (c("y") + c("h") <= c("height")) & (c("w") * c("h") > lo) & (c("w") * c("h") < hi) & (c("w") > 2) & (c("h") > 2)
    return joined.withColumn("kept", good)


#: Least box height, most occlusion and most truncation of the difficulties easy, moderate and hard (fixed values).
DIFFICULTY = ((40, 0, 0.15), (25, 1, 0.3), (25, 2, 0.5))


def difficulty_mask(anns: DataFrame, cls: str, difficulty: int) -> DataFrame:
    """anns with flag: 0 valid ground truth, 1 ignored, -1 another class; DontCare boxes have their own flag 2."""
    height, occlusion, truncation = DIFFICULTY[difficulty]
    hard = (F.col("height") <= height) | (F.col("occlusion") > occlusion) | (F.col("truncation") > truncation)
    same = F.lower("cls") == cls.lower()
    return anns.withColumn("flag", F.when(F.lower("cls") == "dontcare", 2).when(same & ~hard, 0).when(same, 1).otherwise(-1))


def segment_remap(pixels: DataFrame, segments: DataFrame, categories: DataFrame, unlabelled: int = 255) -> DataFrame:
    """pixels (image_id, segment_id, ...) with class_id: the place of the segment's category in category order."""
    ids = categories.agg(F.sort_array(F.collect_set("category_id")).alias("ids")).select(F.posexplode("ids").alias("class_id", "category_id"))
    named = segments.join(ids, "category_id").select("image_id", "segment_id", "class_id")
    return pixels.join(named, ["image_id", "segment_id"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(unlabelled)))


def shard_range_filter(shards: DataFrame, lo: int, hi: int, path: str = "path") -> DataFrame:
    return shards.where(F.regexp_extract(path, "(\\d+)\\.tar$", 1).try_cast("int").between(lo, hi))
