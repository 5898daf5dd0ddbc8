"""Counts, reports and evaluation metrics; all of them merge partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to every denominator of the scores of a confusion matrix (fixed value: the spacing of float32 at 1).
EPS = 1.1920928955078125e-07


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def hash_counts(samples: DataFrame, content: str = "content") -> DataFrame:
    """md5, count of each content."""
    return samples.groupBy(F.md5(F.col(content)).alias("md5")).agg(F.count("*").alias("count"))


def slide_index(slides: DataFrame) -> DataFrame:
    """key, slide_count, he_slides, stain_types of slide folders (key, name) called case_<number>_slide_<stain>; others don't count. A stain goes without a trailing number; H&E is written with or without & and spaces."""
    stain = F.regexp_replace(F.regexp_extract("name", "^case_\\d+_slide_(.*)$", 1), "_\\d+$", "")
    return slides.where(F.col("name").rlike("^case_\\d+_slide_.")).withColumn("stain", stain).groupBy("key").agg(
        F.count("*").alias("slide_count"), _count(F.col("stain").rlike("[hH](&|\\s*&?\\s*[eE])")).alias("he_slides"), F.array_sort(F.collect_set(F.nullif("stain", F.lit("")))).alias("stain_types")
    )


def bad_counts(bad: DataFrame) -> DataFrame:
    """key, bad_rows: error rows of each case; a file with two errors counts twice."""
    return bad.groupBy("key").agg(F.count("*").alias("bad_rows"))


def qc_report(bad: DataFrame, progress: DataFrame) -> DataFrame:
    """level, dataset, category, checked, rows, files, rate (%): by dataset, by category, in total; the rate of nothing checked is null."""
    sums = bad.groupingSets([[F.col("dataset")], [F.col("category")], []], "dataset", "category").agg(F.count("*").alias("rows"), F.countDistinct("filepath").alias("files"), F.grouping_id().alias("g"))
    checked = progress.groupingSets([[F.col("dataset")], []], "dataset").agg(F.sum("checked").alias("checked"), F.grouping_id().alias("all"))
    level = F.when(F.col("g") == 1, "dataset").when(F.col("g") == 2, "category").otherwise("total")
    # categories and the total are measured against the one row of all datasets
    sums = sums.withColumn("level", level).withColumn("whole", (F.col("level") != "dataset").cast("int"))
    checked = checked.select(F.col("dataset").alias("of"), F.col("all").cast("int").alias("all"), "checked")
    joined = sums.join(checked, (F.col("whole") == F.col("all")) & F.when(F.col("whole") == 0, F.col("dataset")).eqNullSafe(F.col("of")), "left")
    return joined.select("level", "dataset", "category", "checked", "rows", "files", (F.try_divide("rows", "checked") * 100).alias("rate"))


def removal_report(bad: DataFrame, files: DataFrame) -> DataFrame:
    """present, missing, bytes of the distinct bad files in a listing (path, size); nothing is removed."""
    joined = bad.select(F.col("filepath").alias("path")).distinct().join(files, "path", "left")
    return joined.agg(_count(F.col("size").isNotNull()).alias("present"), _count(F.col("size").isNull()).alias("missing"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def shards_complete(samples: DataFrame, expected: int) -> DataFrame:
    """shard, n, complete: as many images as metadata as expected."""
    n = samples.groupBy("shard").agg(F.count("jpg").alias("n"), F.count("json").alias("m"))
    return n.select("shard", "n", ((F.col("n") == F.col("m")) & (F.col("n") == expected)).alias("complete"))


def clip_vote(probs: DataFrame, digits: int = 9) -> DataFrame:
    """video, pred: the class (lowest on ties) of the largest sum of probabilities over clips (video, class, p); sums are rounded, so that equal ones tie in whatever order they are added."""
    sums = probs.groupBy("video", "class").agg(F.round(F.sum("p"), digits).alias("s"))
    return sums.groupBy("video").agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("pred"))


def dir_qc_stats(files: DataFrame, errors: DataFrame) -> DataFrame:
    """dir, n_checked, n_passed, n_bad."""
    bad = errors.select(F.col("filepath").alias("path")).distinct().withColumn("bad", F.lit(1))
    out = files.join(bad, "path", "left").groupBy("dir").agg(F.count("*").alias("n_checked"), F.count("bad").alias("n_bad"))
    return out.select("dir", "n_checked", (F.col("n_checked") - F.col("n_bad")).alias("n_passed"), "n_bad")


def pipeline_summary(results: DataFrame) -> DataFrame:
    """dataset, wsis, patches, failed for each dataset and in TOTAL (dataset, slide, patches, ok)."""
    out = results.rollup("dataset").agg(F.count("*").alias("wsis"), F.sum("patches").alias("patches"), _count(~F.col("ok")).alias("failed"), F.grouping("dataset").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("dataset")).alias("dataset"), "wsis", "patches", "failed")


def site_summary(cases: DataFrame, selected: DataFrame) -> DataFrame:
    """site, pool, selected, a, b, c: sizes and tiers of what is selected."""
    pool = cases.groupBy("site").agg(F.count("*").alias("pool"))
    tiers = selected.groupBy("site").pivot("tier", ["A", "B", "C"]).count()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pool.join(tiers, "site", "left").select("site", "pool", (zero("A") + zero("B") + zero("C")).alias("selected"), *(zero(t).alias(t.lower()) for t in "ABC"))


def score_stats(scored: DataFrame, score: str = "total") -> DataFrame:
    return scored.agg(F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), *(_count(F.col("tier") == t).alias(t.lower()) for t in "ABC"))


def validate_report(statuses: DataFrame) -> DataFrame:
    """level, name, total, ok, errors: by shard, by status and in total (shard, status)."""
    ok = F.col("status") == "OK"
    marked = statuses.select(F.col("shard"), F.col("status"), ok.cast("int").alias("good"))
    out = marked.groupingSets([[F.col("shard")], [F.col("status")], []], "shard", "status").agg(F.count("*").alias("total"), F.sum("good").alias("ok"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "shard").when(F.col("g") == 2, "status").otherwise("total")
    name = F.when(F.col("g") == 1, F.col("shard")).when(F.col("g") == 2, F.col("status")).otherwise("")
    return out.select(level.alias("level"), name.alias("name"), "total", F.coalesce("ok", F.lit(0)).alias("ok"), (F.col("total") - F.coalesce("ok", F.lit(0))).alias("errors"))


def status_across_lights(df: DataFrame, cols: tuple[str, ...], keys: tuple[str, ...] = ("CompName", "directory")) -> DataFrame:
    """df with each column replaced for its group: PASS if all are, else the distinct others, sorted, joined by _."""
    w = Window.partitionBy(*keys)
    merged = lambda c: F.concat_ws("_", F.array_sort(F.collect_set(F.when(F.col(c) != "PASS", F.col(c))).over(w)))
    return df.withColumns({c: F.when(merged(c) == "", "PASS").otherwise(merged(c)) for c in cols})


def complete_groups(df: DataFrame, keys: tuple[str, ...], n: int = 4, fill: str | None = None) -> DataFrame:
    """Rows of groups of exactly n; a null in column fill becomes PASS."""
    kept = df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") == n).drop("__n")
    return kept.withColumn(fill, F.coalesce(fill, F.lit("PASS"))) if fill else kept


def lights_concat(df: DataFrame, keys: tuple[str, ...], light: str, pos: str) -> DataFrame:
    """One row for each group, its lights joined by spaces in order of pos."""
    listed = F.array_sort(F.collect_list(F.struct(pos, light)))
    return df.groupBy(*keys).agg(F.concat_ws(" ", F.transform(listed, lambda s: s[light])).alias("lights"))


def golden_pick(df: DataFrame, status: tuple[str, ...], pos: tuple[str, ...], keys: tuple[str, ...] = ("CompName", "TB_Panel"), groups: tuple[str, ...] = ("CompName", "TB_Panel", "directory"), n: int = 4) -> DataFrame:
    """The last row, by pos, with PASS in every status column of each key, among complete groups."""
    good = complete_groups(df, groups, n)
    for s in status:
        good = good.where(F.col(s) == "PASS")
    return good.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(p) for p in pos)))).where("__r = 1").drop("__r")


def subset_stats(df: DataFrame, subset: str, approximate: bool = False) -> DataFrame:
    """subset, ids, images, cameras; approximate counts with sketches at scale."""
    n = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(F.col(subset).alias("subset")).agg(n("pid").alias("ids"), F.count("*").alias("images"), n("camid").alias("cameras"))


def range_stats(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def confusion(df: DataFrame, n: int, gt: str = "gt", pred: str = "pred", ignore: int | None = None) -> DataFrame:
    """gt, pred, n: pairs with gt from 0 to n - 1 and not the ignored one."""
    kept = df.where((F.col(gt) >= 0) & (F.col(gt) < n))
    kept = kept.where(F.col(gt) != ignore) if ignore is not None else kept
    return kept.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_scores(cm: DataFrame) -> DataFrame:
    """class, iou, precision, recall, f1, acc, miou, mf1 of a confusion table; classes without rows or columns count as null in the means."""
    gt = cm.groupBy(F.col("gt").alias("class")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n"))).alias("hit"))
    pred = cm.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("cols"))
    t = gt.join(pred, "class", "full").select("class", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("rows", "hit", "cols")))
    t = t.withColumns({"iou": F.col("hit") / (F.col("rows") + F.col("cols") - F.col("hit") + EPS), "precision": F.col("hit") / (F.col("cols") + EPS), "recall": F.col("hit") / (F.col("rows") + EPS)})
    t = t.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))
    means = t.agg((F.sum("hit") / (F.sum("rows") + EPS)).alias("acc"), F.avg("iou").alias("miou"), F.avg("f1").alias("mf1"))
    return t.crossJoin(F.broadcast(means)).select("class", "iou", "precision", "recall", "f1", "acc", "miou", "mf1")  # means is one row


def confusion_percent(cm: DataFrame, n: int) -> DataFrame:
    """gt, pred, pct, accuracy, m_accuracy: percent of the row; trace over total; mean class accuracy over n classes."""
    rows = cm.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy("gt")) * 100)
    diag = F.col("gt") == F.col("pred")
    one = rows.agg((F.sum(F.when(diag, F.col("n"))) / F.sum("n") * 100).alias("accuracy"), (F.sum(F.when(diag, F.col("pct"))) / n).alias("m_accuracy"))
    return rows.crossJoin(F.broadcast(one)).select("gt", "pred", "pct", "accuracy", "m_accuracy")  # one row


def mapped_iou(df: DataFrame, label_map: dict[int, int], reduce_zero: bool = False, ignore: int = 255) -> DataFrame:
    """class, intersect, union, iou after a remap of labels; with reduce_zero label 0 is ignored and the others move down."""
    gt = F.col("gt")
    if label_map:
        pairs = F.create_map(*(F.lit(x) for kv in label_map.items() for x in kv))
        gt = F.coalesce(pairs[gt], gt)
    if reduce_zero:
        gt = F.when((gt == 0) | (gt == ignore), ignore).otherwise(gt - 1)
    kept = df.select(gt.alias("gt"), "pred").where(F.col("gt") != ignore)
    cm = kept.groupBy("gt", "pred").agg(F.count("*").alias("n"))
    sides = cm.select(F.col("gt").alias("class"), F.col("n").alias("g"), F.lit(0).alias("p"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("i")).union(cm.select("pred", F.lit(0), "n", F.lit(0)))
    out = sides.groupBy("class").agg(F.sum("i").alias("intersect"), (F.sum("g") + F.sum("p") - F.sum("i")).alias("union"))
    return out.withColumn("iou", F.col("intersect") / F.col("union"))


def aoi_metrics(df: DataFrame, score: str, label: str, margin: float = 2.0) -> DataFrame:
    """total_accuracy, defect_accuracy, false_alarm, false_negative in %: a score above the margin means FAIL; label 1 is a defect."""
    fail, bad = F.col(score) > margin, F.col(label) == 1
    n, n_bad, n_good = F.count("*"), _count(bad), _count(~bad)
    rate = lambda x, of: F.when(of > 0, x / of * 100).otherwise(0.0)
    return df.agg(rate(_count(fail == bad), n).alias("total_accuracy"), rate(_count(fail & bad), n_bad).alias("defect_accuracy"), rate(_count(fail & ~bad), n_good).alias("false_alarm"), rate(_count(~fail & bad), n_bad).alias("false_negative"))


def depth_metrics(df: DataFrame, lo: float = 1e-3, hi: float = 10.0) -> DataFrame:
    """d1, d2, d3, abs_rel over the pixels whose gt lies in (lo, hi]; predictions are clipped to it."""
    valid = df.where((F.col("gt") > lo) & (F.col("gt") <= hi))
    pred = F.greatest(F.least("pred", F.lit(hi)), F.lit(lo))
    ratio = F.greatest(pred / F.col("gt"), F.col("gt") / pred)
    return valid.agg(*(F.avg((ratio < 1.25**i).cast("double")).alias(f"d{i}") for i in (1, 2, 3)), F.avg(F.abs(pred - F.col("gt")) / F.col("gt")).alias("abs_rel"))


def depth_align(df: DataFrame) -> DataFrame:
    """df (id, gt, pred) with aligned: per image the least-squares scale and shift of pred to gt, at least 1e-8."""
    fit = df.groupBy("id").agg(F.regr_slope("gt", "pred").alias("scale"), F.regr_intercept("gt", "pred").alias("shift"))
    return df.join(fit, "id").withColumn("aligned", F.greatest(F.col("scale") * F.col("pred") + F.col("shift"), F.lit(1e-8))).drop("scale", "shift")


def stereo_metrics(df: DataFrame, max_disp: float = 416) -> DataFrame:
    """Means over images (id) of epe, d1, bp1, bp2, bp3, rmse, rmse_log, abs_rel, sq_rel over pixels with 0 < gt < max_disp."""
    gt, e = F.col("gt"), F.abs(F.col("pred") - F.col("gt"))
    valid = df.where((gt > 0) & (gt < max_disp))
    share = lambda cond: F.avg(cond.cast("double"))
    logs = F.log(F.greatest("pred", F.lit(1e-8))) - F.log(gt)
    each = valid.groupBy("id").agg(
        F.avg(e).alias("epe"), share((e > 3) & (e / gt > 0.05)).alias("d1"), *(share(e > i).alias(f"bp{i}") for i in (1, 2, 3)), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(logs * logs)).alias("rmse_log"), F.avg(e / gt).alias("abs_rel"), F.avg(e * e / gt).alias("sq_rel")
    )
    return each.agg(*(F.avg(c).alias(c) for c in each.columns if c != "id"))


def refer_metrics(df: DataFrame) -> DataFrame:
    """giou, ciou, t_acc, n_acc, pr7, pr8, pr9 of rows (inter, union, gt_empty, pred_empty).

    A no-target row counts IoU 1 if nothing is predicted, else 0; a target row with nothing predicted counts 0.
    """
    iou = F.when(F.col("gt_empty"), F.col("pred_empty").cast("double")).otherwise(F.when(F.col("pred_empty"), 0.0).otherwise(F.col("inter") / F.col("union")))
    target = ~F.col("gt_empty")
    share = lambda cond, of: _count(cond & of) / _count(of)
    return df.agg(
        F.avg(iou).alias("giou"), (F.sum(F.when(target, F.col("inter")).otherwise(0)) / F.sum(F.when(target | ~F.col("pred_empty"), F.col("union")).otherwise(0))).alias("ciou"),
        share(~F.col("pred_empty"), target).alias("t_acc"), share(F.col("pred_empty"), ~target).alias("n_acc"), *(share(iou >= t / 10, target).alias(f"pr{t}") for t in (7, 8, 9)),
    )


def exact_match(df: DataFrame, gt: str = "gt", pred: str = "pred", end: str = "[s]", probs: str | None = None) -> DataFrame:
    """df with match and, from an array of probabilities, confidence: the product over the text's characters, 0 for none."""
    text = F.substring_index(F.col(pred), end, 1)
    out = df.withColumn("match", text == F.col(gt))
    if probs:
        out = out.withColumn("confidence", F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(F.slice(probs, F.lit(1), F.length(text)), F.lit(1.0), lambda a, p: a * p)))
    return out


def exact_match_accuracy(df: DataFrame, **named) -> DataFrame:
    return exact_match(df, **named).agg(F.avg(F.col("match").cast("double")).alias("acc"))


def micro_prf(df: DataFrame) -> DataFrame:
    """precision, recall, hmean of summed matched, gt and det."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.sum("matched"), F.sum("det")), ratio(F.sum("matched"), F.sum("gt"))
    return df.agg(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("hmean"))


def angle_dispersion(df: DataFrame, vec: str) -> DataFrame:
    """mean_direction, variance: the unit mean of the vectors' directions and the mean squared angle to it."""
    v = F.col(vec).cast("array<double>")
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    unit = df.select(F.transform(v, lambda x: x / norm(v)).alias("u"))
    sums = unit.select(F.posexplode("u").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    mean = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    mean = mean.select(F.transform("mean", lambda x: x / norm(F.col("mean"))).alias("mean_direction"))
    dot = F.aggregate(F.zip_with("u", "mean_direction", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))
    return unit.crossJoin(F.broadcast(mean)).groupBy("mean_direction").agg(F.avg(angle * angle).alias("variance"))  # mean is one row


def pair_losses(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with cosine, squared, dampened, smooth_l1 and mixed losses of each pair of vectors."""
    x, y = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    mean = lambda f: total(F.zip_with(x, y, f)) / F.size(x)
    norm = lambda v: F.sqrt(total(F.transform(v, lambda z: z * z)))
    cosine = 1 - total(F.zip_with(x, y, lambda p, q: p * q)) / (norm(x) * norm(y))
    dampened = lambda p, q: F.when(F.abs(p - q) < 1, 0.5 * (p - q) * (p - q)).otherwise(2 * F.sqrt(F.abs(p - q) + 1e-8) - 1.5)
    smooth = lambda p, q: F.when(F.abs(p - q) < 2, (p - q) * (p - q) / 4).otherwise(F.abs(p - q) - 1)
    out = df.withColumns({"cosine": cosine, "squared": mean(lambda p, q: (p - q) * (p - q)), "dampened": mean(dampened), "smooth_l1": mean(smooth)})
    return out.withColumn("mixed", 0.9 * F.col("cosine") + 0.1 * mean(lambda p, q: F.abs(p - q)))
