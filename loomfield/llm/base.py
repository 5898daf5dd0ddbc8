"""What the operators share: walking Arrow batches, texts and sizes."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions.common import materialize, read_table, shared_dir  # noqa: F401

#: Rows, and bytes on average, that a worker turns into Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 512, 4_000_000


#: Rows of texts that go to Python at a time where a job sets it.
TEXT_ROWS = 1_000


def slices(batches, rows: int = SLICE_ROWS):
    """Small pieces of the Arrow batches of a task, so that few texts are Python objects at once."""
    for batch in batches:
        each = max(1, min(rows, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def give_back() -> None:
    """Gives the free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def given_back(run):
    """A task's function on batches that gives the worker's free memory back when it ends: workers live on, and what they hold adds up."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Within it, at most so many rows go to Python at a time: for columns of many bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; stops counting beyond them."""
    return df.limit(rows + 1).count() <= rows


def own_prefix(df: DataFrame) -> str:
    """A prefix for columns of our own that no column of df begins with, in either case."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings without nulls, one after another, and where each ends; nothing is copied."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), ends[1:] - ends[0]


def runs_in_texts(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each longest run of bytes that are inside, and the number of runs of each text; a run never crosses the end of a text."""
    starts = np.concatenate([[0], ends[:-1]])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = starts < ends
    first[starts[full]] = inside[starts[full]]
    last[ends[full] - 1] = inside[ends[full] - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1 - begin, np.diff(np.searchsorted(begin, ends), prepend=0)
