"""Records of huge JSON documents, cut by byte ranges: one file of any size is many tasks' work.

A document is an object whose values are arrays of objects, {"images": [{…}, …], "annotations": […], …}; a file holds one
or more, on one line or many. Where a range begins, a reader can't know whether it stands within a string, how deep, or in
which array. So each range first says what it does to either state: whether it turns quotes round, and how it changes the
depth if it begins outside a string or inside one. Running values over the ranges of a file (one row a range) give each its
true state; a second pass finds the array that was opened last; a third gives the records that begin in the range, reading
on past its end for the last of them. A task holds a range and one record, never a file.

Files are UTF-8 without compression; paths are those of pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions.common import materialize
from loomfield.sources.tar import file_system

#: Tasks at most for the ranges of all files; beyond it a task reads several, one after another.
MOST_TASKS = 20_000
#: Bytes of a file that a task reads at once, bytes read on for a name or a record that crosses a range's end, rows of a batch.
RANGE_BYTES, MORE_BYTES, BATCH_ROWS = 8 << 20, 64 << 10, 5_000
QUOTE, BACKSLASH = b'"\\'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


class Marks(NamedTuple):
    """Places of quotes and brackets of some bytes, quotes before each place, and the depth's step there (quotes: 0)."""

    at: np.ndarray
    quotes: np.ndarray
    step: np.ndarray


def marks(data: bytes, escaped: bool) -> Marks:
    """The quotes that no backslash escapes, and all brackets; escaped: an odd run of backslashes stands before data."""
    got = np.frombuffer(data, np.uint8)
    step = _STEP[got]
    quote = got == QUOTE
    slashes = np.flatnonzero(got == BACKSLASH)
    if escaped and len(got):
        slashes = np.concatenate([[-1], slashes])
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=slashes[0] - 2) != 1)  # of each run
        length = np.diff(np.append(first, len(slashes)))
        after = slashes[first] + length
        odd = after[(length % 2 == 1) & (after < len(got))]
        quote[odd] = False
    at = np.flatnonzero(quote | (step != 0))
    is_quote = quote[at]
    return Marks(at, np.cumsum(is_quote) - is_quote, np.where(is_quote, 0, step[at]))


def _odd_slashes(file, begin: int) -> bool:
    """Whether an odd run of backslashes ends where the range begins."""
    n = 0
    while begin - n > 0:
        block = file.read_at(min(64, begin - n), max(0, begin - n - 64))
        rest = len(block) - len(block.rstrip(b"\\"))
        n += rest
        if rest < len(block):
            break
    return n % 2 == 1


def _depths(m: Marks, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a place stands outside strings (an opening quote does), and the depth before it."""
    outside = (m.quotes + inside) % 2 == 0
    step = np.where(outside, m.step, 0)
    return outside, depth + np.cumsum(step) - step


def names_at_top(data: bytes, m: Marks, inside: bool, depth: int, end: int) -> tuple[np.ndarray, list[str]]:
    """Places before end where a string begins at depth 1, and what it says ("" if it ends beyond data): there the array before is closed."""
    outside, before = _depths(m, inside, depth)
    is_quote = m.step == 0
    opens = np.flatnonzero(is_quote & outside & (before == 1) & (m.at < end))
    names = []
    for i in opens:  # a few for each document
        closed = i + 1
        while closed < len(m.at) and not is_quote[closed]:  # brackets within the name
            closed += 1
        names.append(json.loads(data[m.at[i] : m.at[closed] + 1], strict=False) if closed < len(m.at) else "")
    return m.at[opens], names


def _read(path: str, begin: int, end: int):
    store, inner = file_system(path)
    with store.open_input_file(inner) as file:
        return file.read_at(end - begin, begin), _odd_slashes(file, begin)


def _survey(batches):
    """What each range does to the state, begun outside a string or inside one."""
    for batch in batches:
        for path, begin, end in zip(*(c.to_pylist() for c in batch.select(["path", "begin", "end"]).columns), strict=True):
            m = marks(*_read(path, begin, end))
            outside, _ = _depths(m, False, 0)
            yield pa.RecordBatch.from_pylist([{"path": path, "begin": begin, "end": end, "flips": int((m.step == 0).sum() % 2), "out": int(m.step[outside].sum()), "in": int(m.step[~outside].sum())}], schema=pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("begin", "end", "flips", "out", "in"))]))


def _last_names(batches):
    """The last string at depth 1 that begins in each range."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            data, escaped = _read(r["path"], r["begin"], r["end"] + MORE_BYTES)
            _, names = names_at_top(data, marks(data, escaped), bool(r["inside"]), r["depth"], r["end"] - r["begin"])
            r["name"] = names[-1] if names else None
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("begin", "end", "inside", "depth")), ("name", pa.string())]))


def records_of(path: str, begin: int, end: int, inside: bool, depth: int, section: str | None, wanted: str):
    """The records of the wanted array that begin in the range, as text."""
    store, inner = file_system(path)
    with store.open_input_file(inner) as file:
        data, escaped = file.read_at(end - begin + MORE_BYTES, begin), _odd_slashes(file, begin)
        m = marks(data, escaped)
        places, names = names_at_top(data, m, inside, depth, end - begin)
        names = [section, *names]
        outside, before = _depths(m, inside, depth)
        is_open = outside & (m.step == 1) & (before == 2) & (m.at < end - begin)
        is_open &= np.array([n == wanted for n in names])[np.searchsorted(places, m.at, side="right")]
        shuts = m.at[outside & (m.step == -1) & (before == 3)]
        for start in m.at[is_open & (np.frombuffer(data, np.uint8)[m.at] == ord("{"))]:
            k = np.searchsorted(shuts, start)
            yield data[start : shuts[k] + 1] if k < len(shuts) else _to_its_end(file, begin, data, start)


def _to_its_end(file, begin: int, data: bytes, start: int) -> bytes:
    """A record that goes on past data: blocks of growing size are read until it closes."""
    record, more = data[start:], MORE_BYTES
    while True:
        block = file.read_at(more, begin + start + len(record))
        if not block:
            raise ValueError(f"the document ends within a record that begins at byte {begin + start}")
        record, more = record + block, more * 2
        m = marks(record, False)
        outside, before = _depths(m, False, 0)
        shut = m.at[outside & (m.step == -1) & (before == 1)]
        if len(shut):
            return record[: shut[0] + 1]


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges over as many tasks as there are: rows so small would be joined into one task if the number weren't given."""
    return ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)), "path", "begin")


def json_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, begin, end, inside, depth, section of each range of the files below path: the state in which it begins. One row a range, written to the shared folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"))
    refused = F.raise_error(F.concat(F.lit("a compressed file can't be cut into ranges: "), F.col("path"))).cast("long")
    files = files.withColumn("size", F.when(F.col("path").rlike("\\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"), refused).otherwise(F.col("size"))).where("size > 0")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    ranges = ranges.select("path", "begin", F.least("size", F.col("begin") + range_bytes).alias("end"))
    earlier = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    seen = materialize(_dealt(ranges).mapInArrow(_survey, "path string, begin long, end long, flips long, out long, in long"), "json-survey")
    inside = seen.withColumn("inside", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    step = F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("in"))
    state = inside.withColumn("depth", F.coalesce(F.sum(step).over(earlier), F.lit(0)))
    named = _dealt(state.select("path", "begin", "end", "inside", "depth")).mapInArrow(_last_names, "path string, begin long, end long, inside long, depth long, name string")
    return materialize(named.select("path", "begin", "end", "inside", "depth", F.last("name", True).over(earlier).alias("section")), "json-ranges")


def json_records(ranges: DataFrame, section: str, schema: str) -> DataFrame:
    """The records of one array as columns of the schema; fields that a record lacks are null, others go."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                for text in records_of(r["path"], r["begin"], r["end"], bool(r["inside"]), r["depth"], r["section"], section):
                    rows.append(text.decode())
                    if len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(rows)], ["record"])
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["record"])

    found = _dealt(ranges).mapInArrow(run, "record string")
    return found.select(F.from_json("record", schema).alias("x")).select("x.*")
