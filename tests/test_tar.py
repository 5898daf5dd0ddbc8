"""Tar shards: written in two phases, read back by byte ranges, also without an index or broken."""

import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from loomfield.operators.sampling import assign_shards
from loomfield.sources import tar

SCHEMA = "subdir long, shard_id long, idx long, key string, members map<string,binary>"


def samples(spark, n=60, size=10):
    rows = spark.range(n).select(F.col("id").alias("idx"), F.concat(F.lit("x"), F.repeat(F.lit("é"), (F.col("id") * 37 % 700).cast("int"))).cast("binary").alias("b"))
    return assign_shards(rows, size, 2).select("subdir", "shard_id", "idx", "key", F.create_map(F.lit("bin"), "b", F.lit("json"), F.lit(b"{}")).alias("members"))


def plain(df):
    return {(r.shard.rsplit("/", 2)[-2] + "/" + r.shard.rsplit("/")[-1], r.key): {k: bytes(v) for k, v in r.members.items()} for r in df.collect()}


def files(out):
    return sorted(os.path.relpath(os.path.join(d, f), out) for d, _, names in os.walk(out) for f in names)


@pytest.mark.parametrize("range_bytes", [700, 5000, 1 << 30])
@pytest.mark.parametrize("index", [True, False])
def test_round_trip_by_byte_ranges(spark, tmp_path, range_bytes, index):
    out, rows = str(tmp_path / "out"), samples(spark)
    assert tar.sink_tar_shards(rows.repartition(7), out) == 6
    if not index:
        for f in files(out):
            if f.endswith(tar.INDEX):
                os.remove(f"{out}/{f}")
    got = tar.src_tar_samples(spark, out, range_bytes)
    assert plain(got) == {(f"{r.subdir}/shard_{r.shard_id:06d}.tar", r.key): {k: bytes(v) for k, v in r.members.items()} for r in rows.collect()}
    assert got.count() == 60 and (range_bytes > 1 << 20 or got.rdd.getNumPartitions() > 12)
    sizes = tar.src_tar_members(spark, out, range_bytes).groupBy("ext").agg(F.sum("size"), F.count("*"))
    assert {tuple(r) for r in sizes.collect()} == {("json", 120, 60), ("bin", sum(1 + 2 * (i * 37 % 700) for i in range(60)), 60)}


def test_shards_are_plain_tars(spark, tmp_path):
    tar.sink_tar_shards(samples(spark), str(tmp_path))
    with tarfile.open(tmp_path / "4/shard_000003.tar") as t:
        assert t.getnames() == [f"{i:09d}.{e}" for i in range(30, 40) for e in ("bin", "json")]
        assert t.extractfile("000000031.json").read() == b"{}"


def test_complete_shards_are_left_alone_and_broken_ones_replaced(spark, tmp_path):
    out, rows = str(tmp_path), samples(spark)
    tar.sink_tar_shards(rows.where("idx < 35"), out)  # shard 3 has five samples of ten
    before = {f: os.stat(f"{out}/{f}").st_mtime_ns for f in files(out)}
    with open(f"{out}/2/shard_000001.tar", "r+b") as f:
        f.truncate(2000)  # its index no longer belongs to it
    assert tar.sink_tar_shards(rows, out) == 4  # 1, 3, and the new 4 and 5
    assert tar.sink_tar_shards(rows, out) == 0
    assert len(plain(tar.src_tar_samples(spark, out))) == 60
    after = {f: os.stat(f"{out}/{f}").st_mtime_ns for f in files(out)}
    assert [f for f in before if after[f] == before[f]] == [f"{f}{x}" for f in ("2/shard_000000.tar", "4/shard_000002.tar") for x in ("", tar.INDEX)]


def test_a_failed_write_leaves_all_as_it_was(spark, tmp_path):
    out, rows = str(tmp_path), samples(spark)
    tar.sink_tar_shards(rows.where("idx < 30"), out)
    before = {f: open(f"{out}/{f}", "rb").read() for f in files(out)}
    broken = rows.withColumn("key", F.when(F.col("idx") == 41, F.raise_error(F.lit("lost"))).otherwise(F.col("key")))
    writer = rows.select("subdir", "shard_id", "key", "members").unionByName(broken.where("idx > 30").select("subdir", "shard_id", "key", "members"))
    spark.dataSource.register(tar.TarSamples)
    with pytest.raises(Exception, match="lost|TASK|failed|Python"):
        writer.coalesce(2).write.format("tar_samples").mode("append").save(out)
    assert {f: open(f"{out}/{f}", "rb").read() for f in files(out)} == before


def test_foreign_broken_empty_and_nested_archives(spark, tmp_path):
    def write(name, members):
        with tarfile.open(tmp_path / name, "w") as t:
            for path, body in members:
                info = tarfile.TarInfo(path)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))

    write("a.tar", [("d.x/k.jpg", b"1" * 700), ("other", b""), ("d.x/k.seg.png", b"2"), ("k" * 150 + ".txt", b"long name")])
    write("cut.tar", [("one.txt", b"a" * 600), ("two.txt", b"b" * 6000)])
    with open(tmp_path / "cut.tar", "r+b") as f:
        f.truncate(3000)
    (tmp_path / "none.tar").write_bytes(b"no archive")
    (tmp_path / "empty.tar").write_bytes(b"")
    (tmp_path / "_half").mkdir()
    write("_half/x.tar", [("x.txt", b"x")])
    got = {(r.shard.rsplit("/")[-1], r.key): {k: bytes(v) for k, v in r.members.items()} for r in tar.src_tar_samples(spark, str(tmp_path), 1000).collect()}
    assert got == {("a.tar", "d.x/k"): {"jpg": b"1" * 700, "seg.png": b"2"}, ("a.tar", "other"): {"": b""}, ("a.tar", "k" * 150): {"txt": b"long name"}, ("cut.tar", "one"): {"txt": b"a" * 600}}
    (tmp_path / "bare").mkdir()
    assert tar.src_tar_samples(spark, str(tmp_path / "bare")).count() == 0


def test_rows_that_no_tar_can_hold_are_refused(spark, tmp_path):
    for key, members in ((None, {"a": b"x"}), ("k", None), ("k", {})):
        with pytest.raises(ValueError):
            tar.sink_tar_shards(spark.createDataFrame([(2, 0, 0, key, members)], SCHEMA), str(tmp_path))
    assert tar.sink_tar_shards(spark.createDataFrame([], SCHEMA), str(tmp_path / "new")) == 0


def test_many_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    out, rows = str(tmp_path / "out"), samples(spark)
    tar.sink_tar_shards(rows, out)
    reader = tar.TarReader({"path": out, "rangebytes": "700"}, contents=True)
    alone = reader.partitions()
    monkeypatch.setattr(tar, "MANY_TASKS", 5)
    few = reader.partitions()
    assert len(few) <= 5 < 12 < len(alone) and sum(r.end - r.begin for p in few for r in p.ranges) == sum(size for _, size in tar._shards(out))
    read = lambda parts: [(s, k, m) for p in parts for b in reader.read(p) for s, k, m in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert read(few) == read(alone) and len(read(few)) == 60
    monkeypatch.setattr(tar, "RANGE_BYTES", 2000)
    bounded = reader.partitions()
    assert max(sum(r.end - r.begin for r in p.ranges) for p in bounded) <= 2000 and len(few) < len(bounded) < len(alone) and read(bounded) == read(alone)
