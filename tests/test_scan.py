"""Running values within keys, whatever the partitions, and the detection operators that use them against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfield.functions.scan import Scan, numbered
from loomfield.operators import detection as D
from loomfield.operators import ranking as R
from loomfield.operators import sampling as S

BOX = "x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_values_over_many_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "a", "a", "b", str(i)]), i, rng.randint(0, 9)) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = Scan(spark.createDataFrame(rows, "k string, i long, v long").repartition(7), ["k"], [F.desc("i")])
        run = scan.running(scan.rows, {"n": "1L", "s": "v"})
        got = {r.i: (r.k, r.n, r.s, r.m) for r in scan.from_end(run, {"m": "s % 11"}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k in {r[0] for r in rows}:
        own, s, kept = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]), 0, []
        for n, (_, i, v) in enumerate(own, 1):
            s += v
            kept.append((i, n, s))
        most = -1
        for i, n, s in reversed(kept):
            most = max(most, s % 11)
            want[i] = (k, n, s, most)
    assert got == want
    assert numbered(spark.createDataFrame([], "k string, i long"), ["k"], ["i"]).count() == 0


def windows(df):
    """Partition columns of all windows in a plan."""
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [{re.sub(r"#\d+L?", "", x).strip() for x in m.group(1).split(",")} for m in re.finditer(r"Window \[.*\], \[([^\]]*)\], \[", plan)]


def test_no_window_over_a_key_of_few_values(spark):
    rows = spark.range(300).selectExpr("id", "id % 3 AS class", "id % 2 AS tp", "rand(1) AS score", "array('x', 'y') AS classes", "1.0D AS w", "cast(id % 3 AS string) AS source")
    n_gt = rows.groupBy("class").agg(F.count("*").alias("n_gt"))
    rates = rows.groupBy("source").agg(F.count("*").alias("rate"))
    frames = [
        S.stratified_sample(rows, "id", "class", 50), S.class_balanced_resample(rows, "id", "classes"), S.group_sample(rows, "id", "class", 5, 3), S.even_shards_padded(rows, "id", "class", 4), S.mix_sources(rows, rates, 50, "id", "w"),
        R.average_precision(rows, n_gt), R.ap_per_mask(rows.selectExpr("id", "score", "array(1, 0) AS met")), D.kitti_ap(rows, n_gt),
    ]
    assert all("__part" in w for f in frames for w in windows(f)) and any(windows(f) for f in frames)
    assert [f.count() for f in frames[:5]] == [50, 600, 45, 300, 50]


def loop_ap(gt, dt, threshold, area, most, crowd):
    """Average precision and recall of one class, one detection after another."""
    lo, hi = area
    hits, n = [], 0
    for image in {r[0] for r in gt} | {r[0] for r in dt}:
        g = sorted((r for r in gt if r[0] == image), key=lambda r: r[1])
        d = sorted((r for r in dt if r[0] == image), key=lambda r: (-r[6], r[1]))[:most]
        size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        skip = [r[1] in crowd or not lo <= size(r) <= hi for r in g]
        n += skip.count(False)
        used = set()
        for r in d:
            best = None
            for ignored in (False, True):
                for j, t in enumerate(g):
                    w, h = min(r[4], t[4]) - max(r[2], t[2]), min(r[5], t[5]) - max(r[3], t[3])
                    inter = max(w, 0) * max(h, 0)
                    union = size(r) if t[1] in crowd else size(r) + size(t) - inter
                    value = inter / union if union > 0 else 0
                    if skip[j] == ignored and (j not in used or t[1] in crowd) and value >= threshold and (best is None or value >= best[0]):
                        best = (value, j)
                if best:
                    break
            if best:
                used.add(best[1])
            if not (skip[best[1]] if best else not lo <= size(r) <= hi):
                hits.append((-r[6], r[1], best is not None))
    if not n:
        return None
    hits.sort()
    tp, curve = 0, []
    for i, (_, _, hit) in enumerate(hits, 1):
        tp += hit
        curve.append((tp / n, tp / i))
    return sum(max((p for r, p in curve if r >= x / 100 - 1e-12), default=0) for x in range(101)) / 101, tp / n


def random_boxes(rng, n, images, size=120):
    rows = []
    for i in range(n):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((rng.randrange(images), i, float(x), float(y), float(x + rng.randint(1, size)), float(y + rng.randint(1, size))))
    return rows


def test_coco_ap_matches_a_loop(spark):
    rng = random.Random(5)
    gt, dt = random_boxes(rng, 60, 6), [(*r, rng.randint(0, 20) / 20) for r in random_boxes(rng, 150, 6)]
    crowd = {r[1] for r in gt if r[1] % 9 == 0}
    truth = spark.createDataFrame([(r[0], 1, *r[1:], int(r[1] in crowd)) for r in gt], f"image_id long, category_id long, id long, {BOX}, iscrowd int")
    found = spark.createDataFrame([(r[0], 1, *r[1:]) for r in dt], f"image_id long, category_id long, id long, {BOX}, score double")
    got = {(r.area, r.max_dets, r.iou): (r.ap, r.ar) for r in D.coco_ap(truth, found, (0.3, 0.5, 0.75), (3, 100)).collect()}
    want = {(a, m, t): loop_ap(gt, dt, t, (lo, hi), m, crowd) for a, lo, hi in D.AREAS for m in (3, 100) for t in (0.3, 0.5, 0.75)}
    want = {k: v for k, v in want.items() if v}
    # a detection beyond the first max_dets can't take a truth from an earlier one, so the lists are prefixes of each other
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def loop_nms(boxes, method, sigma, nt, threshold):
    left, out = [list(r) for r in boxes], []
    while left:
        best = min(left, key=lambda r: (-r[6], r[1]))
        left.remove(best)
        out.append((best[0], best[1], best[6]))
        for r in left:
            if r[0] != best[0]:
                continue
            w, h = min(r[4], best[4]) - max(r[2], best[2]) + 1, min(r[5], best[5]) - max(r[3], best[3]) + 1
            inter = max(w, 0) * max(h, 0)
            area = lambda b: (b[4] - b[2] + 1) * (b[5] - b[3] + 1)
            ov = inter / (area(r) + area(best) - inter)
            r[6] *= {"hard": 0.0 if ov > nt else 1.0, "linear": 1 - ov if ov > nt else 1.0, "gaussian": float(np.exp(-ov * ov / sigma))}[method]
        left = [r for r in left if r[0] != best[0] or r[6] >= threshold]
    return out


@pytest.mark.parametrize("crowded", [20_000, 18])
@pytest.mark.parametrize("method", ["hard", "linear", "gaussian"])
def test_soft_nms_matches_a_loop(spark, method, crowded):
    """Whole images, and those of more than 18 boxes in the parts that don't touch; one holds only boxes below the threshold."""
    rng = random.Random(2)
    rows = [(*r, rng.randint(1, 30) / 30) for r in random_boxes(rng, 200, 9, 50 if crowded > 18 else 150)]
    rows += [(99, i, 9.0 * i, 0.0, 9.0 * i + 5, 5.0, 0.0001 * (1 + i % 5)) for i in range(20)]
    rows = [(*r[:6], 0.0005) if r[1] % 17 == 0 else r for r in rows]
    got = D.soft_nms(spark.createDataFrame(rows, f"image_id long, id long, {BOX}, score double"), method, crowded=crowded)
    want = loop_nms(rows, method, 0.5, 0.3, 0.001)
    key = lambda rows: sorted((r[0], r[1], f"{r[2]:.12f}") for r in rows)
    assert key(got.collect()) == key(want)
    assert D.soft_nms(spark.createDataFrame([], f"image_id long, id long, {BOX}, score double")).count() == 0


def test_greedy_match_matches_a_loop(spark):
    rng = random.Random(3)
    gt, dt = [(*r, r[1] % 4 > 0) for r in random_boxes(rng, 80, 10, 40)], random_boxes(rng, 120, 10, 40)
    got = {r[0]: tuple(r[1:]) for r in D.greedy_match(spark.createDataFrame(gt, f"image_id long, id long, {BOX}, care boolean"), spark.createDataFrame(dt, f"image_id long, id long, {BOX}"), 0.3).collect()}
    inter = lambda a, b: max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
    area = lambda a: (a[4] - a[2]) * (a[5] - a[3])
    for image in range(10):
        g, d = ([r for r in sorted(x, key=lambda r: r[1]) if r[0] == image] for x in (gt, dt))
        care = [b for b in d if not any(not a[6] and inter(a, b) / area(b) > 0.5 for a in g)]
        used = set()
        for a in g:
            if a[6]:
                hit = next((b[1] for b in care if b[1] not in used and inter(a, b) / (area(a) + area(b) - inter(a, b)) > 0.3), None)
                used |= {hit} - {None}
        assert got[image] == (sum(a[6] for a in g), len(care), len(used))


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_tiles_of_a_mask_join_without_a_seam(spark, tile):
    rng = np.random.default_rng(tile)
    rows = [(s, x, y, int(rng.random() < 0.7)) for s in range(2) for y in range(23) for x in range(31 - 6 * s)]
    df = spark.createDataFrame(rows, "slide_id int, x int, y int, v int").where("NOT (x = 30 AND y < 20) AND NOT (x = 3 AND y = 3)")
    key = lambda d: sorted(map(tuple, d.collect()))
    whole = key(D.mask_morphology(df, 3, 7, tile=512))
    assert key(D.mask_morphology(df, 3, 7, tile=tile)) == whole and len(whole) == 23 * 31 + 23 * 25


def loop_kitti(gt, dt, name, least, difficulty):
    """ap11, ap40 by the protocol's own order: one truth, one detection, one threshold after another."""
    height, occluded, truncated = ((D.LEAST_HEIGHT[difficulty], D.MOST_OCCLUDED[difficulty], D.MOST_TRUNCATED[difficulty]) if difficulty is not None else (None,) * 3)
    inter = lambda a, b: max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)
    area = lambda a: (a[5] - a[3]) * (a[6] - a[4])
    iou = lambda a, b: inter(a, b) / (area(a) + area(b) - inter(a, b))

    def of_gt(a):
        if a[2].lower() == name:
            return int(difficulty is not None and (a[6] - a[4] <= height or a[7] > occluded or a[8] > truncated))
        return 1 if difficulty is not None and D.NEIGHBOURS.get(name) == a[2].lower() else -1

    def of_dt(b):
        if difficulty is not None and b[6] - b[4] < height:
            return 1
        return 0 if b[2].lower() == name else -1

    images = sorted({r[0] for r in gt} | {r[0] for r in dt})
    split = {i: (sorted((r for r in gt if r[0] == i), key=lambda r: r[1]), sorted((r for r in dt if r[0] == i), key=lambda r: r[1])) for i in images}
    scores, n = [], sum(of_gt(a) == 0 for a in gt)
    for g, d in split.values():
        used = set()
        for a in g:
            able = [b for b in d if of_gt(a) >= 0 and of_dt(b) >= 0 and b[1] not in used and iou(a, b) > least]
            if able:
                b = max(able, key=lambda b: b[7])
                used.add(b[1])
                if of_gt(a) == 0 and of_dt(b) == 0:
                    scores.append(b[7])
    scores.sort(reverse=True)
    thresholds, due = [], 0
    for i, s in enumerate(scores):
        left = (i + 1) / n
        right = (i + 2) / n if i < len(scores) - 1 else left
        if right - due < due - left and i < len(scores) - 1:
            continue
        thresholds.append(s)
        due += 1 / 40
    precision = [0.0] * 41
    for at, limit in enumerate(thresholds):
        tp = fp = 0
        for g, d in split.values():
            d, used = [b for b in d if b[7] >= limit], set()
            for a in g:
                able = [b for b in d if of_gt(a) >= 0 and of_dt(b) >= 0 and b[1] not in used and iou(a, b) > least]
                sure = [b for b in able if of_dt(b) == 0]
                if able:
                    b = max(sure, key=lambda b: iou(a, b)) if sure else able[0]
                    used.add(b[1])
                    tp += of_gt(a) == 0 and of_dt(b) == 0
            stuff = [a for a in g if a[2] == "DontCare" and difficulty is not None]
            fp += sum(of_dt(b) == 0 and b[1] not in used and not any(inter(a, b) > least * area(b) for a in stuff) for b in d)
        precision[at] = tp / (tp + fp) if tp else 0.0
    best = [max(precision[i:]) for i in range(41)]
    return sum(best[::4]) / 11 * 100, sum(best[1:]) / 40 * 100


@pytest.mark.parametrize("difficulty", [None, 0, 2])
@pytest.mark.parametrize("n", [40, 400])
def test_kitti_ap_from_truths_and_detections(spark, n, difficulty):
    rng = random.Random(n)
    kinds = ["Car", "Car", "Car", "Van", "Pedestrian", "person_sitting", "DontCare"]
    gt = [(r[0], r[1], rng.choice(kinds), *r[2:], rng.randint(0, 3), rng.randint(0, 6) / 10) for r in random_boxes(rng, n, n // 6, 90)]
    dt = []
    for a in gt:
        for _ in range(rng.randint(0, 2)):
            move = [x + rng.randint(-6, 6) for x in a[3:7]]
            dt.append((a[0], len(dt), rng.choice(kinds[:5]), *map(float, (move[0], move[1], max(move[0] + 1, move[2]), max(move[1] + 1, move[3]))), rng.randint(0, 60) / 60))
    classes = ("car", "pedestrian", "cyclist")
    truth = spark.createDataFrame(gt, f"image_id long, id long, class string, {BOX}, occluded int, truncated double")
    found = spark.createDataFrame(dt, f"image_id long, id long, class string, {BOX}, score double")
    got = {r["class"]: (r.ap11, r.ap40) for r in D.kitti_frames_ap(truth, found, classes, 0.5, difficulty).collect()}
    want = {k: loop_kitti(gt, dt, k, 0.5, difficulty) for k in classes}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and (got["car"][1] > 0 or n < 400)
    none = D.kitti_frames_ap(truth.limit(0), found.limit(0), ("car",)).collect()
    assert [tuple(r) for r in none] == [("car", 0, 0.0, 0.0)]


def test_images_alike_are_worked_on_side_by_side(spark):
    rng = random.Random(11)
    rows = [(i, side, rng.random()) for i in range(500) for side in (0, 1) for _ in range(rng.randint(0, 2))]
    df = spark.createDataFrame(rows, "image_id long, side int, id double")

    def run(t, g, d):
        assert (np.diff(t["id"][g], axis=1) >= 0).all() and (t["side"][g] == 0).all() and (t["side"][d] == 1).all()
        assert all(len(set(t["image_id"][np.append(a, b)])) == 1 for a, b in zip(g, d, strict=True))
        yield pa.table({"n": [len(g)], "rows": [g.size + d.size]})

    got = D._alike(df, ["image_id"], ["id"], 41, run, "n long, rows long").collect()
    assert len(got) <= 8 and sum(r.n for r in got) == len({r[0] for r in rows}) and sum(r.rows for r in got) == len(rows)


def test_coco_ap_of_classes_over_many_ranges_and_chunks(spark, monkeypatch):
    for name, n in (("CHUNK", 7), ("ALIKE_ROWS", 60), ("ALIKE_NUMBERS", 500)):
        monkeypatch.setattr(D, name, n)
    rng = random.Random(12)
    gt, dt = random_boxes(rng, 90, 8), [(*r, rng.randint(0, 9) / 9) for r in random_boxes(rng, 260, 8)]
    kind, crowd = lambda r: r[0] % 3, {r[1] for r in gt if r[1] % 11 == 0}
    truth = spark.createDataFrame([(r[0], kind(r), *r[1:], int(r[1] in crowd)) for r in gt], f"image_id long, category_id long, id long, {BOX}, iscrowd int")
    found = spark.createDataFrame([(r[0], kind(r), *r[1:]) for r in dt] + [(99, 7, 999, 0.0, 0.0, 1.0, 1.0, 0.5)], f"image_id long, category_id long, id long, {BOX}, score double")
    result = D.coco_ap(truth, found, (0.3, 0.6), (2, 100))
    assert result.columns == ["area", "max_dets", "iou", "ap", "ar"] and "Window" not in result._jdf.queryExecution().toString()
    got = {(r.area, r.max_dets, r.iou): (r.ap, r.ar) for r in result.collect()}
    want = {}
    for a, lo, hi in D.AREAS:
        for m, t in ((m, t) for m in (2, 100) for t in (0.3, 0.6)):
            each = [x for k in range(3) if (x := loop_ap([r for r in gt if kind(r) == k], [r for r in dt if kind(r) == k], t, (lo, hi), m, crowd))]
            if each:
                want[a, m, t] = tuple(np.mean(each, axis=0))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 8
    assert D.coco_ap(truth.limit(0), found).count() == 0 and D.coco_ap(truth, found.limit(0), (0.5,), (100,)).agg({"ap": "max", "ar": "max"}).first()[:] == (0.0, 0.0)
