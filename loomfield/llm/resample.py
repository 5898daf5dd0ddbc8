"""Importance resampling of documents towards a target corpus.

Features are runs of words, hashed to buckets. Bucket counts of the documents and of the target give each bucket an
integer gain, the scaled log ratio of its smoothed shares; a document's weight is the mean gain of its features, floored.
Texts are scored as arrays of bytes: words, their CRC states and those of the runs come from whole batches at once. A
Gumbel number of the document's hash is added, so the highest scores are a draw without replacement in proportion to
exp(weight / 1000). The order of all scores comes from a distributed radix sort (radix.py).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.common import Tables
from loomfield.llm.base import given_back, materialize, runs_in_texts, slices, text_bytes, text_or_empty
from loomfield.llm.radix import radix_places

BUCKETS = 10_000
#: Bytes of a word that are hashed in step with other words; what is longer goes on alone.
STEP_BYTES = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def _crc_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(0xEDB88320), state >> 1)
    return state


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def crc_states(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The running CRC-32 state of each run of bytes, from its state before; ~state is the checksum."""
    order = np.argsort(STEP_BYTES + 1 - np.minimum(size, STEP_BYTES + 1).astype(np.uint8), kind="stable")  # the longest first
    now, at = state[order], begin[order]
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, STEP_BYTES + 1), minlength=STEP_BYTES + 2))  # runs of more than j bytes
    for j in range(STEP_BYTES):
        some = longer[j]
        if not some:
            break
        now[:some] = _CRC[(now[:some] ^ data[at[:some] + j]) & 255] ^ now[:some] >> 8
    for i in range(longer[STEP_BYTES]):
        a, b = int(at[i]) + STEP_BYTES, int(at[i] + size[order[i]])
        now[i] = zlib.crc32(data[a:b].tobytes(), int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def feature_buckets(data: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all single words, those of all pairs of neighbours, and each text's number of words. data: UTF-8 bytes of all texts up to ends."""
    data = _LOWER[data]
    begin, size, words = runs_in_texts(_IN_WORD[data], ends)
    one = crc_states(np.full(len(begin), _ONES), data, begin, size)
    has_next = np.ones(len(begin), bool)
    has_next[np.cumsum(words)[words > 0] - 1] = False
    left = np.flatnonzero(has_next)
    spaced = _CRC[(one[left] ^ np.uint32(32)) & 255] ^ one[left] >> 8
    two = crc_states(spaced, data, begin[left + 1], size[left + 1])
    return (~one % np.uint32(buckets)).astype(np.int64), (~two % np.uint32(buckets)).astype(np.int64), words


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks send a row for each of their buckets; the driver gets a number a bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for part in slices(batches):
            one, two, _ = feature_buckets(*text_bytes(part.column(0)), buckets)
            counts += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    found = texts.select(text_or_empty(text_col).alias("text")).mapInArrow(given_back(run), "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source, in doubles."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight (the floored mean of the features' gains; 0 without features) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            one, two, words = feature_buckets(*text_bytes(part.column(1)), len(gains))
            pairs = np.maximum(words - 1, 0)
            total = np.zeros(len(words), np.int64)
            for found, each in ((one, words), (two, pairs)):
                sums, upto = np.concatenate([[0], np.cumsum(gains[found])]), np.cumsum(each)
                total += sums[upto] - sums[upto - each]
            features = words + pairs
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, features, weight))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(given_back(run), f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) with 32 bits, by seed and key; a null key counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank.

    Of the rows of least_words words or more, percent of 100 (rounded down) with the highest scores are drawn and ranked
    from 1, ties to the smaller id; all others have a null rank. Rows that repeat an id are documents of their own; those
    of equal score and id rank in any order. A null id draws as an empty one and comes after the others on a tie. Null,
    empty and wordless texts have no features and weight 0. An empty docs gives no rows, an empty target counts as one
    without features. Ids must be whole numbers. Other columns are ignored. The result reads two tables in the shared folder.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = importance_weights(docs.withColumn(id_col, F.col(id_col).cast("long")), gains, id_col, text_col)
    rows = materialize(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "importance-weights")
    with Tables(docs.sparkSession, "resample") as tables:
        placed, n = radix_places(rows.where(F.col("n_words") >= least_words).drop("n_words"), [("score", False), ("id", True)], tables)
        drawn = materialize(placed.withColumn("rank", F.when(F.col("place") < percent * n // 100, F.col("place") + 1)).drop("place"), "importance-ranks")
    rest = rows.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
