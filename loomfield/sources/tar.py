"""Tar shards of samples as a Spark data source: a writer that commits in two phases, and a reader that cuts shards by byte ranges.

A shard is a tar of samples; a sample is a key and its members, named key.ext. Beside a shard stands its index (Parquet:
key, ext, offset and size of each member, and in its metadata the bytes of the tar it belongs to), so that a task can go
straight to its samples. A shard without an index, or with one of another size, is read by its headers alone: contents are
skipped, and a broken shard gives the samples that are whole. No task holds a shard: samples come in batches of bounded bytes.

Tasks write to a folder of their own below out/_temporary; the driver moves a shard into place only when all tasks have
ended well, the index after the tar. So a killed write leaves old shards as they were, and a lost executor's tasks run again
in another folder. Paths are those of pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import tarfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a shard that a task reads, and bytes and samples of a batch.
RANGE_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 16 << 20, 1000
#: Tasks from which on small ranges share one, up to RANGE_BYTES: each task costs its start, and a result that the driver keeps.
MANY_TASKS = 1000
INDEX = ".idx"
_INDEX_SCHEMA = pa.schema([("key", pa.string()), ("ext", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
SAMPLES = "shard string, key string, members map<string,binary>"
MEMBERS = "shard string, key string, ext string, offset long, size long"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _shards(root: str) -> list[tuple[str, int]]:
    """Path and bytes of each tar below root, or of root if it is one; what begins with _ or . is none of ours."""
    store, path = file_system(root)
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    inside = lambda p: p[len(path) :].strip("/").split("/")
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".tar") and not any(x[:1] in "_." for x in inside(f.path) if x))


def sample_name(name: str) -> tuple[str, str]:
    """Key and extension of a member: the base name up to its first dot, and the rest."""
    folder, slash, base = name.rpartition("/")
    stem, _, ext = base.partition(".")
    return folder + slash + stem, ext


def members_of(store: fs.FileSystem, path: str, size: int) -> list[tuple[str, str, int, int]]:
    """key, ext, offset, size of all whole members of a shard, in order, from its index or else from its headers."""
    if store.get_file_info(path + INDEX).type == fs.FileType.File:
        table = pq.read_table(path + INDEX, filesystem=store)
        if (table.schema.metadata or {}).get(b"bytes") == str(size).encode():
            return list(zip(*(table[c].to_pylist() for c in _INDEX_SCHEMA.names), strict=True))
    found = []
    with store.open_input_file(path) as file:
        try:
            with tarfile.open(fileobj=file, mode="r:") as tar:
                for m in tar:
                    if m.isfile() and m.offset_data + m.size <= size:
                        found.append((*sample_name(m.name), m.offset_data, m.size))
        except tarfile.TarError:
            pass
    return found


@dataclass
class Range:
    """The samples of a shard whose first member begins within a range of bytes."""

    path: str
    size: int
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What a task reads, range after range; those that adjoin in a shard are one."""

    ranges: list[Range]


class TarReader(DataSourceReader):
    """Partitions by byte ranges; the driver lists files and reads none."""

    def __init__(self, options: dict, contents: bool):
        self.root, self.contents = options["path"], contents
        self.bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[InputPartition]:
        shards = _shards(self.root)
        each = lambda size: range(0, max(size, 1), self.bytes)
        n = sum(len(each(size)) for _, size in shards)
        share = -(-n // MANY_TASKS)  # ranges for a task
        parts, held, count = [Ranges([])], 0, 0
        for path, size in shards:
            for at in each(size):
                end = min(at + self.bytes, size)
                if count and (count >= share or held + end - at > RANGE_BYTES):
                    parts.append(Ranges([]))
                    held = count = 0
                last = parts[-1].ranges
                if last and last[-1].path == path:
                    last[-1].end = end
                else:
                    last.append(Range(path, size, at, end))
                held, count = held + end - at, count + 1
        return parts

    def read(self, part: Ranges):
        for each in part.ranges:
            yield from self._read(each)

    def _read(self, part: Range):
        store, _ = file_system(self.root)
        samples: dict[str, list[tuple[str, int, int]]] = {}
        for key, ext, offset, size in members_of(store, part.path, part.size):
            samples.setdefault(key, []).append((ext, offset, size))
        mine = [(key, m) for key, m in samples.items() if part.begin <= m[0][1] < part.end]
        if not self.contents:
            rows = [(part.path, key, *m) for key, ms in mine for m in ms]
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["shard", "key", "ext", "offset", "size"])
            return
        rows, held = [], 0
        with store.open_input_file(part.path) as file:
            for key, members in mine:
                rows.append((key, [(ext, file.read_at(size, offset)) for ext, offset, size in members]))
                held += sum(m[2] for m in members)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield self._batch(part.path, rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(part.path, rows)

    @staticmethod
    def _batch(path: str, rows: list) -> pa.RecordBatch:
        last = [list(dict(m).items()) for _, m in rows]  # of members of one name the last counts
        columns = [pa.array([path] * len(rows)), pa.array([k for k, _ in rows]), pa.array(last, pa.map_(pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["shard", "key", "members"])


@dataclass
class Written(WriterCommitMessage):
    """The shards that a task has written: where they are, and where they belong."""

    shards: list[tuple[str, str]]


class _Shard:
    """A tar being written, and its index."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path, self.rows = store, path, []
        self.file = store.open_output_stream(path)
        self.tar = tarfile.TarFile(fileobj=self.file, mode="w")

    def add(self, key: str, members: list[tuple[str, bytes]]) -> None:
        for ext, content in sorted(members):
            content = content or b""
            info = tarfile.TarInfo(f"{key}.{ext}")
            info.size, info.mode = len(content), 0o644
            self.tar.addfile(info, io.BytesIO(content))
            padded = -(-len(content) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
            self.rows.append((key, ext, self.tar.offset - padded, len(content)))

    def close(self) -> None:
        self.tar.close()
        size = self.file.tell()
        self.file.close()
        columns = zip(*self.rows, strict=True) if self.rows else ([],) * 4
        schema = _INDEX_SCHEMA.with_metadata({"bytes": str(size)})
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), self.path + INDEX, filesystem=self.store)


class TarWriter(DataSourceArrowWriter):
    """Rows (subdir, shard_id, key, members), those of a shard one after another, become out/subdir/shard_NNNNNN.tar."""

    def __init__(self, options: dict):
        self.out, self.job = options["path"], uuid.uuid4().hex

    def _temporary(self) -> tuple[fs.FileSystem, str, str]:
        store, out = file_system(self.out)
        return store, out.rstrip("/"), f"{out.rstrip('/')}/_temporary/{self.job}"

    def write(self, iterator) -> Written:
        store, _, top = self._temporary()
        folder, shard, done, now = f"{top}/{TaskContext.get().taskAttemptId()}", None, {}, None
        store.create_dir(folder, recursive=True)
        for batch in iterator:
            for subdir, shard_id, key, members in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("subdir", "shard_id", "key", "members")), strict=True):
                name = f"{subdir}/shard_{shard_id:06d}.tar"
                if name != now:
                    if shard:
                        shard.close()
                    if name in done:
                        raise ValueError(f"the rows of {name} don't stand together")
                    now, done[name] = name, f"{folder}/{name.replace('/', '-')}"
                    shard = _Shard(store, done[name])
                shard.add(key, list(dict(members or []).items()))
        if shard:
            shard.close()
        return Written([(path, name) for name, path in done.items()])

    def commit(self, messages) -> None:
        store, out, top = self._temporary()
        for path, name in (s for m in messages if m for s in m.shards):
            place = f"{out}/{name}"
            store.create_dir(place.rpartition("/")[0], recursive=True)
            if store.get_file_info(place + INDEX).type == fs.FileType.File:
                store.delete_file(place + INDEX)
            store.move(path, place)
            store.move(path + INDEX, place + INDEX)
        self._clear(store, top)

    def abort(self, messages) -> None:
        store, _, top = self._temporary()
        self._clear(store, top)

    @staticmethod
    def _clear(store: fs.FileSystem, top: str) -> None:
        above = top.rpartition("/")[0]
        if store.get_file_info(top).type == fs.FileType.Directory:
            store.delete_dir(top)
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)  # no other job writes here


class TarSamples(DataSource):
    """tar_samples: one row for each sample of the shards below path, with its contents; option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "tar_samples"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options, contents=True)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TarWriter(self.options)


class TarMembers(DataSource):
    """tar_members: one row for each member of the shards below path, without contents."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options, contents=False)


def _load(spark: SparkSession, source: type[DataSource], root: str, range_bytes: int) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("rangeBytes", range_bytes).load(root)


def src_tar_samples(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """shard, key, members (map of extension to bytes): one row for each sample of each tar below root; a broken tar gives its whole samples, other files nothing."""
    return _load(spark, TarSamples, root, range_bytes)


def src_tar_members(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """shard, key, ext, offset, size: one row for each whole member of each tar below root; contents are not read."""
    return _load(spark, TarMembers, root, range_bytes)


def shards_written(spark: SparkSession, out: str) -> DataFrame:
    """subdir, shard_id, n: the whole samples of each shard below out; a sample is whole if it has as many members as its shard's largest."""
    empty = "subdir long, shard_id long, n long"
    store, path = file_system(out)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return spark.createDataFrame([], empty)
    name = "/([0-9]+)/shard_([0-9]+)\\.tar$"
    each = src_tar_members(spark, out).where(F.col("shard").rlike(name)).groupBy("shard", "key").agg(F.count("*").alias("members"))
    whole = each.groupBy("shard", "members").agg(F.count("*").alias("n")).groupBy("shard").agg(F.max_by("n", "members").alias("n"))
    return whole.select(*(F.regexp_extract("shard", name, i).cast("long").alias(c) for i, c in ((1, "subdir"), (2, "shard_id"))), "n")


def sink_tar_shards(df: DataFrame, out: str) -> int:
    """Write rows (subdir, shard_id, idx, key, members) as out/subdir/shard_NNNNNN.tar, samples by idx; the number of shards written.

    A shard that is there with as many whole samples as df has for it is left alone, and its rows aren't shuffled; others
    are written anew. A row without members is a sample without files, which a tar can't hold: such rows are refused.
    """
    spark = df.sparkSession
    if not df.where(F.col("key").isNull() | F.col("members").isNull() | (F.size("members") == 0)).isEmpty():
        raise ValueError("each sample needs a key and at least one member")
    wanted = df.groupBy("subdir", "shard_id").agg(F.count("*").alias("n"))
    open_ = wanted.join(shards_written(spark, out), ["subdir", "shard_id", "n"], "left_anti").select("subdir", "shard_id").cache()
    try:
        n = open_.count()
        if n:
            rows = df.join(open_, ["subdir", "shard_id"], "left_semi").repartition("subdir", "shard_id").sortWithinPartitions("subdir", "shard_id", "idx")
            spark.dataSource.register(TarSamples)
            rows.select("subdir", "shard_id", "key", "members").write.format(TarSamples.name()).mode("append").save(out)
    finally:
        open_.unpersist()
    return n
