"""Joins of samples with captions, quality logs, selections, counts and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.grid import Grid


def pair_image_text(images: DataFrame, texts: DataFrame) -> DataFrame:
    """dir, stem, image, text of the pairs that share directory and stem."""
    return images.select("dir", "stem", F.col("path").alias("image")).join(texts.select("dir", "stem", F.col("path").alias("text")), ["dir", "stem"])


def exclude_bad(files: DataFrame, bad: DataFrame, exts: tuple[str, ...]) -> DataFrame:
    """path, reason of every file: kept, bad (in the bad list) or ext (another extension)."""
    marked = files.join(bad.select(F.col("filepath").alias("path")).distinct().withColumn("is_bad", F.lit(True)), "path", "left")
    return marked.select("path", F.when(~F.lower("ext").isin(*exts), "ext").when(F.col("is_bad"), "bad").otherwise("kept").alias("reason"))


def select_cases_join(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Files (dataset, parent, path) of selected cases (dataset, case_id), by the raw id or its number.

    A parent that isn't case_* passes, and so does a dataset without a selection.
    """
    case = F.regexp_extract("parent", "^case_(.*)$", 1)
    keyed = files.withColumn("case_id", case)
    number = lambda c: F.coalesce(F.col(c).try_cast("int").cast("string"), F.col(c))
    wanted = selection.select("dataset", number("case_id").alias("want")).distinct()
    chosen = selection.select("dataset").distinct().withColumn("has", F.lit(True))
    passing = keyed.join(chosen, "dataset", "left").where(F.col("has").isNull() | ~F.col("parent").startswith("case_")).drop("has")
    picked = keyed.where(F.col("parent").startswith("case_")).join(wanted, (keyed["dataset"] == wanted["dataset"]) & (number("case_id") == wanted["want"]), "left_semi")
    return passing.unionByName(picked).drop("case_id")


def score_join(cases: DataFrame, slides: DataFrame, bad: DataFrame) -> DataFrame:
    """cases with slide_count, he_slides, stain_types and bad_rows by key; nothing found means 0 and empty."""
    joined = cases.join(slides, "key", "left").join(bad, "key", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("slide_count", "he_slides", "bad_rows")}
    return joined.withColumns(zero | {"stain_types": F.coalesce("stain_types", F.array().cast("array<string>"))})


#: Weights by mode, from a count.
WEIGHTS = {"inv_frequency": lambda c: 1 / c, "inv_frequency_sq": lambda c: 1 / (c * c), "inv_log": lambda c: 1 / F.log(c + 1), "uniform": lambda c: F.lit(1.0)}


def _on_key(samples: DataFrame, key: str | Column, own: str) -> DataFrame:
    """samples with the key as column own; a Column says how a sample's key comes from its other columns."""
    return samples.withColumn(own, F.col(key) if isinstance(key, str) else key)


def weight_join(samples: DataFrame, counts: DataFrame, mode: str = "inv_frequency", key: str | Column = "md5", counts_key: str | None = None) -> DataFrame:
    """samples with weight by their content's count (an unknown or null key counts 1); an unknown mode is an error.

    key is a column of samples or an expression over its columns, such as a hash of a field of its metadata; counts has it
    as counts_key (key's own name, or md5 for an expression), with count.
    """
    if mode not in WEIGHTS:
        raise ValueError(f"unknown mode {mode!r}; there are {sorted(WEIGHTS)}")
    c = F.coalesce(F.col("count"), F.lit(1)).cast("double")
    own = "__key"
    counts = counts.select(F.col(counts_key or (key if isinstance(key, str) else "md5")).alias(own), "count")
    return _on_key(samples, key, own).join(counts, own, "left").withColumn("weight", WEIGHTS[mode](c)).drop("count", own)


def overrep_blocklist(counts: DataFrame, max_count: int = 100, key: str = "md5") -> DataFrame:
    return counts.where(F.col("count") > max_count).select(key)


def block_overrep(samples: DataFrame, counts: DataFrame, max_count: int = 100, key: str | Column = "md5", counts_key: str | None = None) -> DataFrame:
    """samples without those whose content occurs more than max_count times; key and counts_key are as in weight_join."""
    own = "__key"
    listed = counts_key or (key if isinstance(key, str) else "md5")
    blocked = overrep_blocklist(counts, max_count, listed).select(F.col(listed).alias(own))
    return _on_key(samples, key, own).join(blocked, own, "left_anti").drop(own)


def manifest_verify(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """dataset, shards, missing, size_mismatch, bad_members, status of a manifest (dataset, path, size) against a listing (path, size, members or null)."""
    found = listing.select("path", F.col("size").alias("found"), "members")
    joined = manifest.join(found, "path", "left")
    count = lambda cond: F.count(F.when(cond, 1))
    out = joined.groupBy("dataset").agg(
        F.count("*").alias("shards"), count(F.col("found").isNull()).alias("missing"), count(F.col("found") != F.col("size")).alias("size_mismatch"), count(~F.col("members").between(1, 10_000)).alias("bad_members")
    )
    return out.withColumn("status", F.when(F.col("missing") + F.col("size_mismatch") + F.col("bad_members") == 0, "OK").otherwise("FAIL"))


def resume_remaining(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return units.join(done.select(key).distinct(), key, "left_anti")


def golden_join(compare: DataFrame, golden: DataFrame) -> DataFrame:
    """Compare rows with the golden row of the same project, TB, component, side and panel; rows without one go."""
    keys = ["Project", "TB", "CompName", "TOP_BOT", "TB_Panel"]
    return compare.join(golden.select(*keys, F.col("directory").alias("golden_path")), keys, "left").where("golden_path IS NOT NULL")


def split_by_list(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is in the list, and the others."""
    listed = ids.select(key).distinct()
    return df.join(listed, key, "left_semi"), df.join(listed, key, "left_anti")


def box_overlap_join(a: DataFrame, b: DataFrame, mode: str = "iou") -> DataFrame:
    """image_id, a_id, b_id, overlap of the boxes (image_id, id, x1, y1, x2, y2) of an image that overlap: iou, iof (over a's area) or giou.

    Boxes meet in the cells of a grid that they touch, and a pair only in the cell of its intersection's first corner, so
    an image of many boxes is many tasks' work. Boxes with a null or non-finite corner overlap with none.
    """
    if mode not in ("iou", "iof", "giou"):
        raise ValueError(f"unknown mode {mode!r}")
    corners = ("id", "x1", "y1", "x2", "y2")
    c = F.col
    p, q = (df.select("image_id", *(c(k).alias(f"{s}_{k}") for k in corners)) for df, s in ((a, "a"), (b, "b")))
    bounds = lambda s: [(F.least(f"{s}_{d}1", f"{s}_{d}2"), F.greatest(f"{s}_{d}1", f"{s}_{d}2")) for d in "xy"]
    grid = Grid(((p, bounds("a")), (q, bounds("b"))))
    p, q = grid.placed(p, bounds("a"), 0, "a_level"), grid.placed(q, bounds("b"), 1, "b_level")
    meet = (c("a_x1") < c("b_x2")) & (c("b_x1") < c("a_x2")) & (c("a_y1") < c("b_y2")) & (c("b_y1") < c("a_y2"))
    corner = (grid.cell(F.greatest("a_x1", "b_x1")) == c("gx")) & (grid.cell(F.greatest("a_y1", "b_y1")) == c("gy"))
    pairs = p.join(q, ["image_id", "level", "gx", "gy"]).where(meet & corner & (c("level") == F.greatest("a_level", "b_level")))
    inter = (F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * (F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    area = lambda s: (c(f"{s}_x2") - c(f"{s}_x1")) * (c(f"{s}_y2") - c(f"{s}_y1"))
    union = area("a") + area("b") - inter
    hull = (F.greatest("a_x2", "b_x2") - F.least("a_x1", "b_x1")) * (F.greatest("a_y2", "b_y2") - F.least("a_y1", "b_y1"))
    overlap: Column = {"iou": inter / union, "iof": inter / area("a"), "giou": inter / union - (hull - union) / hull}[mode]
    return pairs.select("image_id", "a_id", "b_id", overlap.alias("overlap"))


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """frame, box_id, n_points: points (frame, x, y, z) inside the boxes (frame, box_id, cx, cy, cz, dx, dy, dz, heading) of their frame.

    A point lies in one cell of a grid (for each size of boxes), and a box goes to the cells that its outline on the ground
    touches, so a frame of many points is many tasks' work. A box with a null or non-finite outline holds no points.
    """
    c = F.col
    reach = lambda u, v: (F.abs(u) * F.abs(c("dx")) + F.abs(v) * F.abs(c("dy"))) / 2 * (1 + 1e-9) + 1e-9
    rx, ry = reach(F.cos("heading"), F.sin("heading")), reach(F.sin("heading"), F.cos("heading"))
    outline = [(c("cx") - rx, c("cx") + rx), (c("cy") - ry, c("cy") + ry)]
    grid = Grid(((boxes, outline),))
    placed = grid.placed(boxes, outline, None, "own")
    where = [(c("x"), c("x")), (c("y"), c("y"))]
    located = grid.at_levels(points.where(grid.finite(where)), grid.levels[0]).select("frame", "level", grid.cell(c("x")).alias("gx"), grid.cell(c("y")).alias("gy"), "x", "y", "z")
    joined = placed.join(located, ["frame", "level", "gx", "gy"])
    x, y = c("x") - c("cx"), c("y") - c("cy")
    u, v = x * F.cos("heading") + y * F.sin("heading"), -x * F.sin("heading") + y * F.cos("heading")
    inside = (F.abs(u) <= c("dx") / 2) & (F.abs(v) <= c("dy") / 2) & (F.abs(c("z") - c("cz")) <= c("dz") / 2)
    counts = joined.where(inside).groupBy("frame", "box_id").agg(F.count("*").alias("n"))
    listed = boxes.select("frame", "box_id").distinct()
    return listed.join(counts, ["frame", "box_id"], "left").select("frame", "box_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_points"))
