"""Operators that SQL can't express, on small frames with known answers."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions.common import global_index
from loomfield.operators import aggregates as A
from loomfield.operators import detection as D
from loomfield.operators import joins as J
from loomfield.operators import predicates as P
from loomfield.operators import sampling as SA
from loomfield.operators import vectors as V
from loomfield.sources import files as S

def test_keys_may_be_expressions(spark):
    samples = spark.createDataFrame([(1, '{"sha": "a"}'), (2, '{"sha": "b"}'), (3, "{}"), (4, None)], "id long, meta string")
    counts = spark.createDataFrame([("a", 4), ("b", 200), ("z", 3)], "sha string, count long")
    key = F.get_json_object("meta", "$.sha")
    got = J.weight_join(samples, counts, key=key, counts_key="sha")
    assert got.columns == ["id", "meta", "weight"] and {r.id: r.weight for r in got.collect()} == {1: 0.25, 2: 0.005, 3: 1.0, 4: 1.0}
    named = samples.withColumn("sha", key)
    assert {r.id: r.weight for r in J.weight_join(named, counts, key="sha").collect()} == {1: 0.25, 2: 0.005, 3: 1.0, 4: 1.0}
    kept = J.block_overrep(samples, counts, key=key, counts_key="sha")
    assert kept.columns == samples.columns and {r.id for r in kept.collect()} == {1, 3, 4}
    assert {r.id for r in J.block_overrep(named, counts, key="sha").collect()} == {1, 3, 4}


def test_rates_of_nothing_are_null(spark):
    empty = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.0)], "path string, rate double")
    assert sorted(map(tuple, SA.normalize_rates(empty).collect())) == [("a", None), ("b", None)]
    bad = spark.createDataFrame([("x", "c", "f1"), ("x", "c", "f2"), (None, "c", "f2"), ("y", "d", "f3")], "dataset string, category string, filepath string")
    progress = spark.createDataFrame([("x", 0), (None, 4), ("z", 6)], "dataset string, checked long")
    got = sorted((tuple(r) for r in A.qc_report(bad, progress).collect()), key=str)
    assert got == sorted([
        ("dataset", "x", None, 0, 2, 2, None), ("dataset", None, None, 4, 1, 1, 25.0), ("dataset", "y", None, None, 1, 1, None),
        ("category", None, "c", 10, 3, 2, 30.0), ("category", None, "d", 10, 1, 1, 10.0), ("total", None, None, 10, 4, 3, 40.0),
    ], key=str)


BOXES = "image_id long, id long, x1 double, y1 double, x2 double, y2 double"


def test_tar_samples(spark, tmp_path):
    for shard in range(2):
        with tarfile.open(tmp_path / f"{shard}.tar", "w") as tar:
            for i in range(3):
                for ext, body in (("txt", f"sample_{shard}{i}"), ("json", "{}")):
                    info = tarfile.TarInfo(f"{i:06d}.{ext}")
                    info.size = len(body)
                    tar.addfile(info, io.BytesIO(body.encode()))
    (tmp_path / "broken.tar").write_bytes(b"no archive")
    got = {(r["shard"].rsplit("/")[-1], r["key"]): {k: bytes(v) for k, v in r["members"].items()} for r in S.src_read_tar_samples(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got["1.tar", "000002"] == {"txt": b"sample_12", "json": b"{}"}


def test_greedy_match(spark):
    gt = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, True), (1, 2, 20.0, 0.0, 30.0, 10.0, False), (2, 1, 0.0, 0.0, 4.0, 4.0, True)], BOXES + ", care boolean")
    dt = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 9.0), (1, 2, 0.0, 0.0, 10.0, 10.0), (1, 3, 21.0, 1.0, 29.0, 9.0)], BOXES)
    got = {r[0]: tuple(r[1:]) for r in D.greedy_match(gt, dt).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 0, 0)}


def test_soft_nms(spark):
    dets = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0, 0.9), (1, 2, 0.0, 0.0, 9.0, 9.0, 0.8), (1, 3, 50.0, 50.0, 59.0, 59.0, 0.5)], BOXES + ", score double")
    got = lambda m: {r["id"]: r["score"] for r in D.soft_nms(dets, m).collect()}
    assert got("hard") == {1: 0.9, 3: 0.5} and got("linear") == {1: 0.9, 3: 0.5}
    assert got("gaussian")[2] == pytest.approx(0.8 * np.exp(-1 / 0.5))
    with pytest.raises(ValueError):
        D.soft_nms(dets, "none")


def test_coco_ap_of_a_perfect_and_a_half_result(spark):
    gt = spark.createDataFrame([(i, 1, i, 0.0, 0.0, 10.0, 10.0, 0) for i in range(4)], "image_id long, category_id long, id long, x1 double, y1 double, x2 double, y2 double, iscrowd int")
    dt = gt.drop("iscrowd").selectExpr("*", "0.9 AS score")
    value = lambda d: {(r["area"], r["iou"]): (r["ap"], r["ar"]) for r in D.coco_ap(gt, d, (0.5,), (100,)).collect()}
    assert value(dt)["all", 0.5] == pytest.approx((1.0, 1.0)) and value(dt)["small", 0.5] == pytest.approx((1.0, 1.0))
    assert value(dt.where("image_id < 2"))["all", 0.5] == pytest.approx((51 / 101, 0.5))


def test_mask_morphology_drops_specks_and_fills_holes(spark):
    mask = np.zeros((20, 20), int)
    mask[3:17, 3:17] = 1
    mask[9, 9] = 0
    mask[0, 19] = 1
    rows = [(0, x, y, int(mask[y, x])) for y in range(20) for x in range(20)]
    got = {(r["x"], r["y"]): r["v"] for r in D.mask_morphology(spark.createDataFrame(rows, "slide_id int, x int, y int, v int"), 3, 5).collect()}
    assert got[19, 0] == 0 and got[9, 9] == 1 and got[10, 5] == 1


def test_whitening_gives_unit_mean_variance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) @ np.diag([1, 2, 3, 4])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    stats = V.feature_mean_cov(df, "embedding").first()
    assert np.allclose(np.array(stats["cov"]).reshape(4, 4), np.cov(x.T)) and np.allclose(stats["mean"], x.mean(0))
    w = np.array([r["whitened"] for r in V.whiten_fit_apply(df, "embedding").collect()])
    assert np.allclose(w.var(0, ddof=1), 1) and np.allclose(w.mean(0), 0)


def test_reranking_keeps_near_rows_near(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(6)
    rows = []
    for i in range(120):
        v = centres[i % 6] + rng.normal(0, 0.05, 6)
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
    got = V.k_reciprocal_rerank(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k1=8, k2=3, queries="vec_id < 6").collect()
    assert got and all(0 <= r["dist"] <= 1 for r in got)
    for q in range(6):
        best = min((r for r in got if r["qid"] == q), key=lambda r: r["dist"])
        assert best["gid"] % 6 == q


def test_global_index_has_no_gaps(spark):
    for parts in (1, 7):
        rows = global_index(spark.range(1000).repartition(parts), "id").orderBy("id").collect()
        assert [r["idx"] for r in rows] == list(range(1000))


def test_weights_and_presets_reject_unknown_names(spark):
    df = spark.createDataFrame([("a", [0.1, 0.2, 0.3])], "md5 string, channels array<double>")
    counts = spark.createDataFrame([("a", 4)], "md5 string, count long")
    got = [J.weight_join(df, counts, m).first()["weight"] for m in ("inv_frequency", "inv_frequency_sq", "inv_log", "uniform")]
    assert got == pytest.approx([1 / 4, 1 / 16, 1 / np.log(5), 1])
    with pytest.raises(ValueError):
        J.weight_join(df, counts, "other")
    with pytest.raises(ValueError):
        P.channel_normalize(df, preset="other")


def test_streams_leave_no_rows_in_the_driver(spark):
    from loomfield.plans import sources

    before = {t.name for t in spark.catalog.listTables()}
    for name in ("stream_sequence_split", "stream_filter_counters", "stream_metric_state"):
        assert sources.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_masks_of_all_events(spark, tmp_path):
    from loomfield.plans import vectors

    spark.range(9500).selectExpr("id AS event_id", "20.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    assert vectors.QUERIES["mask_morphology"](spark, str(tmp_path)).select("slide_id").distinct().count() == 10


def test_votes_of_equal_sums_go_to_the_lowest_class(spark):
    parts = [0.1, 0.2, 0.3]
    clips = [(v, k, p) for v in range(6) for k, order in ((2, parts), (4, parts[::-1]), (1, [0.3, 0.1])) for p in (order if v % 2 else order[::-1])]
    for n in (1, 3):
        got = A.clip_vote(spark.createDataFrame(clips, "video long, class long, p double").repartition(n))
        assert {r.video: r.pred for r in got.collect()} == dict.fromkeys(range(6), 2)
    got = A.clip_vote(spark.createDataFrame(clips, "video long, class long, p double").coalesce(1))
    assert {r.video: r.pred for r in got.collect()} == dict.fromkeys(range(6), 2)
