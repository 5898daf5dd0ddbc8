"""Streams of samples: ingestion, running counters and metrics, merged statistics, resumption and sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomfield.functions.common import delete, names_in, small_text, write_small_text
from loomfield.operators.vectors import feature_mean_cov


def stream_ingest_samples(spark: SparkSession, path: str, schema: str, counts: DataFrame, max_files: int = 100, content: str | F.Column = "text", max_count: int = 100, labels: dict[str, F.Column] | None = None) -> DataFrame:
    """A stream of new shards' samples with image_key and weight (1 / count of the content); contents that occur too often are filtered.

    content is a column or an expression over the sample's columns; labels adds columns by name, each from an expression.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    keyed = stream.withColumns({"image_key": F.md5(content)} | (labels or {}))
    joined = keyed.join(counts.select(F.col("md5").alias("image_key"), "count"), "image_key", "left").withColumn("count", F.coalesce("count", F.lit(1)))
    return joined.where(F.col("count") <= max_count).withColumn("weight", 1 / F.col("count")).drop("count")


def stream_filter_counters(stream: DataFrame, kept: F.Column, by: str = "dataset") -> DataFrame:
    """dataset, seen, filtered, pct, running."""
    out = stream.groupBy(by).agg(F.count("*").alias("seen"), F.count(F.when(~kept, 1)).alias("filtered"))
    return out.withColumn("pct", F.col("filtered") / F.col("seen") * 100)


def stream_metric_state(stream: DataFrame, margin: float = 2.0) -> DataFrame:
    """Running n, right, fails, caught, false_alarms of (score, label): sums that merge over workers."""
    fail, bad = F.col("score") > margin, F.col("label") == 1
    count = lambda cond: F.count(F.when(cond, 1))
    return stream.agg(F.count("*").alias("n"), count(fail == bad).alias("right"), count(bad).alias("fails"), count(fail & bad).alias("caught"), count(fail & ~bad).alias("false_alarms"))


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """One n, mean, cov of two by the pairwise update (each a row or none)."""
    both = a.unionByName(b)
    total = both.agg(F.collect_list(F.struct("n", "mean", "cov")).alias("s"))  # two rows at most
    x, y = F.col("s")[0], F.col("s")[1]
    n = x["n"] + y["n"]
    mean = F.zip_with(x["mean"], y["mean"], lambda p, q: (p * x["n"] + q * y["n"]) / n)
    d = F.size(x["mean"])
    gap = F.zip_with(x["mean"], y["mean"], lambda p, q: p - q)
    sums = F.zip_with(x["cov"], y["cov"], lambda p, q: p * (x["n"] - 1) + q * (y["n"] - 1))
    cov = F.transform(sums, lambda v, i: (v + F.get(gap, F.floor(i / d).cast("int")) * F.get(gap, i % d) * x["n"] * y["n"] / n) / (n - 1))
    merged = total.where(F.size("s") == 2).select(n.alias("n"), mean.alias("mean"), cov.alias("cov"))
    return merged.unionByName(total.where(F.size("s") == 1).select(x["n"].alias("n"), x["mean"].alias("mean"), x["cov"].alias("cov")))


class FeatureStats:
    """A foreachBatch sink that keeps the running n, mean and covariance of a stream's vectors below state_path, in a folder for each batch.

    A batch takes the state before its own and writes its own anew, so one that is run again counts once, and another process
    goes on where this one ended. Only the last two states are kept. Vectors of another length than the state's, and a
    state of other columns, are refused. Empty batches leave the state as it is.
    """

    COLUMNS = [("n", "bigint"), ("mean", "array<double>"), ("cov", "array<double>")]

    def __init__(self, vec: str, state_path: str):
        self.vec, self.path = vec, state_path.rstrip("/")

    def _versions(self, spark: SparkSession) -> list[int]:
        whole = lambda v: "_SUCCESS" in names_in(spark, f"{self.path}/{v}")
        return sorted(int(v.removeprefix("batch=")) for v in names_in(spark, self.path) if v.startswith("batch=") and whole(v))

    def state(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The last state, or the last one before a batch; None if there is none."""
        versions = [v for v in self._versions(spark) if before is None or v < before]
        if not versions:
            return None
        found = spark.read.parquet(f"{self.path}/batch={versions[-1]}")
        if found.dtypes != self.COLUMNS:
            raise ValueError(f"the state has other columns: {found.dtypes}")
        return found

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.where(F.col(self.vec).isNotNull())
        sizes = batch.agg(F.min(F.size(self.vec)), F.max(F.size(self.vec))).first()
        if sizes[0] is None:
            return
        known = self.state(spark, batch_id)
        width = known.select(F.size("mean")).first()[0] if known is not None else sizes[0]
        if tuple(sizes) != (width, width):
            raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components, the state is of {width}")
        stats = feature_mean_cov(batch, self.vec)
        out = merge_stats(known, stats) if known is not None else stats
        out.select(F.col("n").cast("long").alias("n"), "mean", "cov").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")  # one row
        for old in [v for v in self._versions(spark) if v < batch_id][:-1]:
            delete(spark, f"{self.path}/batch={old}")


def stream_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run what is new to its end; a restart with the checkpoint handles only the rest. A checkpoint of a stream with other columns is refused."""
    spark, kept = stream.sparkSession, f"{checkpoint.rstrip('/')}/columns.json"
    shape = stream.schema.json()
    known = small_text(spark, kept)
    if known is not None and known != shape:
        raise ValueError(f"{checkpoint} belongs to a stream of other columns: {known}")
    if known is None:
        write_small_text(spark, kept, shape)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_sequence_split(stream: DataFrame, length: int, min_len: int, step: int, ended: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """object, seq, n, first_frame, last_frame from (object, frame), frames of an object in order: windows of length at every step as they fill.

    Short last windows of min_len frames or more are given once, when an object ends: on a row whose ended column is true
    (its frame doesn't count), or, with idle_ms, in the first batch after it has had no row for so long (for streams that run on; an availableNow run wouldn't end). Then its state
    goes; what comes later is a new sequence from 0. The state of an object is its frames from the next window's start on,
    length + step at most, and how many frames there are still to skip.
    """
    if step < 1 or length < 1 or min_len < 1:
        raise ValueError("length, min_len and step must be 1 at least")

    def windows(key, seq: int, skip: int, frames: list, least: int):
        """The windows of at least so many frames, and what is left."""
        rows = []
        while True:
            gone = min(skip, len(frames))
            skip, frames = skip - gone, frames[gone:]
            if len(frames) < least:
                return rows, seq, skip, frames
            part = frames[:length]
            rows.append((key, seq, len(part), part[0], part[-1]))
            seq, skip = seq + 1, step

    def split(key, batches, state: GroupState):
        seq, skip, frames = state.get if state.exists else (0, 0, [])
        frames, end = list(frames), state.hasTimedOut
        for pdf in batches if not end else ():
            last = pdf["ended"].fillna(False).astype(bool)
            frames += pdf["frame"][~last].tolist()
            end |= bool(last.any())
        rows, seq, skip, frames = windows(key[0], seq, skip, sorted(frames), length)
        if end:
            rows += windows(key[0], seq, skip, frames, min_len)[0]
            state.remove()
        else:
            state.update((seq, skip, frames))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["object", "seq", "n", "first_frame", "last_frame"])

    mark = F.col(ended).cast("boolean") if ended else F.lit(False)
    frames = stream.select("object", F.coalesce(F.col("frame"), F.lit(0)).alias("frame"), (mark | F.col("frame").isNull()).alias("ended")) if ended else stream.where("frame IS NOT NULL").select("object", "frame", mark.alias("ended"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return frames.groupBy("object").applyInPandasWithState(split, "object long, seq long, n long, first_frame long, last_frame long", "seq long, skip long, frames array<long>", "append", timeout)
