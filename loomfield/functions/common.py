"""Seeded order, exponential keys, a gap-free global index, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and one machine does all the work (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """Spark's own file system of a path, and the path in it; for small things that the driver keeps."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none, if there is no such folder."""
    store, at = _hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    store, at = _hadoop(spark, path)
    store.delete(at, True)


def small_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    store, at = _hadoop(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    store, at = _hadoop(spark, path)
    stream = store.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


class Tables:
    """Tables that a job needs while it runs, in a folder of the shared folder that goes with the block, whether it ends well or not."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str = "") -> None:
        delete(self.spark, f"{self.folder}/{name}" if name else self.folder)

    def __exit__(self, *_) -> None:
        self.drop()


def seed_key(key: Column, seed: int | str = 42) -> Column:
    """The sort key of seeded order: the same for a seed and a key, however rows are partitioned."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit(key: Column, seed: int | str = 42) -> Column:
    """A number in (0, 1) with 52 bits, by seed and key."""
    return (F.conv(F.substring(seed_key(key, seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def exp_key(key: Column, weight: Column, seed: int | str = 42) -> Column:
    """Exp(1) / weight: ordering by it samples without replacement in proportion to weight."""
    return -F.log(unit(key, seed)) / weight


def global_index(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """df with a gap-free index from 0 in a total order, without a window over all rows.

    Rows are sorted by range and written once, for ranges are drawn anew with every run; each range's offset is the sum of
    the counts before it (one number for each range).
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "indexed").withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()
    base, rows = 0, []
    for part, n in counts:
        rows.append((part, base))
        base += n
    offsets = df.sparkSession.createDataFrame(rows, "__part long, __base long")
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__base") + local).drop("__at", "__part", "__base")
