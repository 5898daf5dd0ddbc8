"""Streams that stop and go on: windows, merged statistics, and states of another shape."""

import time

import numpy as np
import pytest

from loomfield.operators import ranking as R
from loomfield.streaming import samples as T

FRAMES = "object long, frame long, ended boolean"


def run(spark, tmp, rows, **kw):
    spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    stream = spark.readStream.schema(FRAMES).parquet(f"{tmp}/in")
    T.stream_to_table(T.stream_sequence_split(stream, **kw), f"{tmp}/out", f"{tmp}/check")
    return sorted(map(tuple, spark.read.parquet(f"{tmp}/out").collect()))


@pytest.mark.parametrize("length, min_len, step", [(3, 2, 5), (4, 1, 2), (5, 3, 5), (2, 2, 1), (3, 3, 7)])
def test_windows_of_a_stream_are_those_of_a_table(spark, tmp_path, length, min_len, step):
    frames = [(o, f) for o in range(3) for f in range(0, 17 + o)]
    part = lambda f: [(o, i, False) for o, i in frames if f(i)]
    kw = {"length": length, "min_len": min_len, "step": step, "ended": "ended"}
    run(spark, tmp_path, part(lambda i: i < 4), **kw)
    before = run(spark, tmp_path, part(lambda i: i >= 4), **kw)
    assert all(n == length for _, _, n, _, _ in before)
    got = run(spark, tmp_path, [(o, None, True) for o in range(3)], **kw)
    batch = R.sliding_sequences(spark.createDataFrame(frames, "object long, frame long"), length, min_len, step)
    assert got == sorted(map(tuple, batch.select("object", "seq", "n", "first_frame", "last_frame").collect()))
    starts = {(o, s): [f for f in range(17 + o)][s * step : s * step + length] for o in range(3) for s in range(30)}
    assert got == sorted((o, s, len(w), w[0], w[-1]) for (o, s), w in starts.items() if len(w) >= min_len)
    # an ended object begins anew
    again = run(spark, tmp_path, [(0, 100 + i, False) for i in range(length)], **kw)
    assert set(again) - set(got) == {(0, 0, length, 100, 99 + length)}


def test_an_idle_object_gives_its_tail_once(spark, tmp_path):
    def feed(rows):
        spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    feed([(1, i, False) for i in range(6)])
    stream = T.stream_sequence_split(spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/in"), 4, 2, 4, idle_ms=500)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
    try:
        want, end = [(1, 0, 4, 0, 3), (1, 1, 2, 4, 5)], time.time() + 60
        seen = lambda: sorted(map(tuple, spark.read.schema("object long, seq long, n long, first_frame long, last_frame long").parquet(f"{tmp_path}/out").collect())) if (tmp_path / "out").exists() else []
        while seen() != want and time.time() < end:
            time.sleep(0.5)
        feed([(2, 0, False)])
        time.sleep(3)
        assert seen() == want
    finally:
        query.stop()


def test_a_step_below_one_is_an_error(spark):
    stream = spark.createDataFrame([], FRAMES)
    for kw in ({"step": 0}, {"length": 0}, {"min_len": 0}):
        with pytest.raises(ValueError):
            T.stream_sequence_split(stream, **({"length": 3, "min_len": 1, "step": 1} | kw))
    with pytest.raises(ValueError):
        R.sliding_sequences(spark.createDataFrame([], "object long, frame long"), 3, 1, 0)


def test_odd_frames_poses_and_videos(spark):
    frames = spark.createDataFrame([(0, i) for i in range(8)], "object long, frame long")
    got = sorted(map(tuple, R.sliding_sequences(frames, 3, 3, 5).select("seq", "n", "first_frame", "last_frame").collect()))
    assert got == [(0, 3, 0, 2), (1, 3, 5, 7)]
    poses = spark.createDataFrame([(0, []), (1, None), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0, 1.0])], "id long, pose array<double>")
    assert {r["id"]: r["joints"] for r in R.pose_normalize(poses).collect()} == {0: [], 1: [], 2: [], 3: [[0.0, 0.0, 0.0, 1.0]]}
    videos = spark.createDataFrame([(0, 0), (1, 3), (2, 20)], "video long, n long")
    for strategy in ("interval", "segment", "all"):
        assert {r["video"] for r in R.clip_index(videos, 4, strategy).collect()} == {1, 2}
    for strategy in R.FRAME_STRATEGIES:
        for r in R.frame_sample(videos, 4, strategy).collect():
            n = {1: 3, 2: 20}[r["video"]]
            assert len(r["ids"]) == 4 and all(0 <= i < n for i in r["ids"])
            assert strategy not in ("middle", "random", "random_interval") or r["ids"] == sorted(r["ids"])
    scenes = spark.createDataFrame([("s", i, 0 if i % 4 == 0 else 1) for i in range(12)], "scene string, ts long, frame_idx int")
    assert {r["group_idx"] for r in R.sequence_groups(scenes).collect()} == {0, 1, 2}
    assert {r["group_idx"] for r in R.sequence_groups(scenes, limit=2).collect()} == {0, 1}


def test_statistics_go_on_in_another_process(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) * [1, 2, 3, 4] + 100
    batch = lambda rows: spark.createDataFrame([(v.tolist(),) for v in rows], "v array<double>")
    state = str(tmp_path / "state")
    parts = [x[:1], x[1:2], x[2:30], x[:0], x[30:]]
    for i, rows in enumerate(parts):
        T.FeatureStats("v", state)(batch(rows), i)  # each time a new object: nothing is known but what is stored
        T.FeatureStats("v", state)(batch(rows), i)  # and a batch that is run again counts once
        seen = sum(map(len, parts[: i + 1]))
        found = T.FeatureStats("v", state).state(spark).first()
        assert found["n"] == seen and np.allclose(found["mean"], x[:seen].mean(0))
        assert seen == 1 or np.allclose(np.reshape(found["cov"], (4, 4)), np.cov(x[:seen].T))
    assert len(list((tmp_path / "state").glob("batch=*"))) == 2
    with pytest.raises(ValueError, match="components"):
        T.FeatureStats("v", state)(batch(x[:3, :3]), 9)
    spark.range(1).write.mode("overwrite").parquet(f"{state}/batch=9")
    with pytest.raises(ValueError, match="columns"):
        T.FeatureStats("v", state)(batch(x[:3]), 10)


def test_a_checkpoint_of_other_columns_is_refused(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    T.stream_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    T.stream_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    with pytest.raises(ValueError, match="other columns"):
        T.stream_to_table(stream.selectExpr("id", "id + 1 AS more"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
