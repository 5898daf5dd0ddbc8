"""Toxicity by subword-bag embeddings, averaged into a linear softmax and trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with marks at both ends), a document the mean of its words;
one linear layer with two outputs reads that mean. Vectors and layer are trained together. A misspelling never seen
shares most n-grams with the word it hides, and so its vectors.

As everything up to the softmax is linear, a trained model gives each word one number, and a document's logit is the
mean of its words' numbers: scoring is a look-up in a worker's cache, and words that it misses are hashed in bulk.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions.common import Tables
from loomfield.llm.base import give_back, given_back, slices, text_or_empty

WORD = re.compile(r"\w+")
GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
#: Labelled rows of each class that training takes at most: those with the smallest hash of their id.
TRAIN_TOXIC, TRAIN_CLEAN = 2_000, 5_000
#: Bytes of features that training takes to the driver at most, half for each class; rows are taken in the order of the hash of their id.
TRAIN_BYTES = 100_000_000
#: Words of score 0 that every mean has besides a document's own, so that a few words alone decide little.
SMOOTH = 10
CACHE_ENTRIES = 150_000

_cache: dict = {"model": None, "words": {}}


@dataclass(frozen=True)
class Model:
    """The score of every n-gram bucket (difference of the two logits) and the bias."""

    version: str
    bucket_score: np.ndarray
    bias: float


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of all words, one after another, and the place where each word's begin."""
    raw = [f"<{w}>".encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32) + np.uint32(1)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes to the word's end
    rows = np.zeros((len(data), len(GRAMS)), np.uint32)
    valid = np.zeros((len(data), len(GRAMS)), bool)
    for k, n in enumerate(GRAMS):
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(16777619) ^ data[i : i + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        rows[:m, k] = h % np.uint32(BUCKETS)
        valid[:, k] = left >= n
    per_byte = valid.sum(1)
    ends = np.cumsum(per_byte)
    starts = np.concatenate([[0], ends[np.cumsum(sizes)[:-1] - 1]]) if len(raw) else np.zeros(0, np.int64)
    return rows[valid], starts


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text; a text without words has none."""
    counts = Counter(WORD.findall(text.lower()))
    if not counts:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    buckets, starts = grams(list(counts))
    sizes = np.diff(np.append(starts, len(buckets)))
    weight = np.fromiter(counts.values(), np.float64, len(counts)) / (sum(counts.values()) + SMOOTH) / sizes
    some, place = np.unique(buckets, return_inverse=True)
    return some.astype(np.uint16), np.bincount(place, np.repeat(weight, sizes)).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.5, decay: float = 2e-5, seed: int = 5) -> Model:
    """Embeddings and softmax trained jointly by AdaGrad over (buckets, weights, label) rows, both classes with the same weight in all; without both classes, a model that scores 0 or 1 alike."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(f"constant-{labels[:1].tolist()}", np.zeros(BUCKETS), 4.0 if labels[:1].tolist() == [1] else -4.0)
    weight = (len(labels) / 2 / np.bincount(labels, minlength=2)).astype(np.float32)[labels]
    vectors = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    sums = [np.full_like(vectors, 1e-6), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)]
    gain = np.float32(20)  # means over many words are small
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs) + 0.01)
        for at in np.split(order := rng.permutation(len(rows)), range(batch, len(order), batch)):
            sizes = [len(rows[i][0]) for i in at]
            cols, inverse = np.unique(np.concatenate([rows[i][0] for i in at]), return_inverse=True)
            x = np.zeros((len(at), len(cols)), np.float32)
            x[np.repeat(np.arange(len(at)), sizes), inverse] = np.concatenate([rows[i][1] for i in at]) * gain
            hidden = x @ vectors[cols]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p *= weight[at, None] / np.float32(len(at))
            grads = [x.T @ (p @ layer.T) + np.float32(decay) * vectors[cols], hidden.T @ p, p.sum(0)]
            for part, g, total, where in ((vectors, grads[0], sums[0], cols), (layer, grads[1], sums[1], slice(None)), (bias, grads[2], sums[2], slice(None))):
                total[where] += g * g
                part[where] -= step * g / np.sqrt(total[where])
    towards = layer[:, 1] - layer[:, 0]
    score = (vectors.astype(np.float64) @ towards.astype(np.float64)) * float(gain)
    return Model(f"trained-{len(rows)}-{score.sum():.12g}", score, float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth id by CRC-32 is kept from training; a row without an id is not held out (and never trains)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model of the labelled rows that aren't held out: at most most_toxic and most_clean of them, by the hash of their id, and most_bytes of features.

    Labels other than 0 and 1 and rows without an id don't count; of several labels of an id the largest does. Rows of docs that
    repeat an id all train. A null or empty text trains as one without words. Without usable labels every text scores alike, below 0.5.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    chosen = usable.where("y = 1").orderBy("h", "id").limit(most_toxic).union(usable.where("y = 0").orderBy("h", "id").limit(most_clean))

    def run(batches):
        for part in slices(batches, 128):
            pairs = [features(t) for t in part.column(0).to_pylist()]
            raw = [pa.array([x[i].tobytes() for x in pairs], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*raw, pa.array([b.nbytes + w.nbytes for b, w in pairs], pa.int64()), *part.columns[1:]], ["buckets", "weights", "size", "y", "id", "h"])

    with Tables(docs.sparkSession, "toxicity") as tables:
        # at most most_toxic + most_clean ids are broadcast
        texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y", "id", "h")
        found = tables.write(texts.mapInArrow(given_back(run), f"buckets binary, weights binary, size long, y int, id {dict(docs.dtypes)[id_col]}, h long"), "features")
        # a window over the few rows that were chosen
        upto = found.select("y", "h", "id", F.sum("size").over(Window.partitionBy("y").orderBy("h", "id")).alias("upto"))
        within = upto.where(F.col("upto") <= most_bytes // 2).select("id").distinct()
        found = found.join(F.broadcast(within), "id", "left_semi").select("buckets", "weights", "y", "id").toArrow()
    # views of the Arrow buffers in the order of the ids: the sample stands in the driver's memory once, and is given back
    order, y = pc.sort_indices(found["id"]).to_pylist(), found["y"].to_pylist()
    rows = [(np.frombuffer(found["buckets"][i].as_buffer(), np.uint16), np.frombuffer(found["weights"][i].as_buffer(), np.float32), y[i]) for i in order]
    model = train(rows)
    del rows, found
    give_back()  # what training took stays with the driver's process otherwise, for all stages after it
    return model


def _score(texts: list[str], model: Model) -> list[float]:
    if _cache["model"] != model.version:
        _cache.update(model=model.version, words={})
    known = _cache["words"]
    logits = []
    for text in texts:
        words = WORD.findall(text.lower())
        found = list(map(known.get, words))
        if None in found:
            missed = list({w for w, s in zip(words, found, strict=True) if s is None})
            if len(known) + len(missed) > CACHE_ENTRIES:
                known.clear()
                missed = list(set(words))
            buckets, starts = grams(missed)
            sizes = np.diff(np.append(starts, len(buckets)))
            known.update(zip(missed, (np.add.reduceat(model.bucket_score[buckets], starts) / sizes).tolist(), strict=True))
            found = list(map(known.__getitem__, words))
        logits.append(model.bias + sum(found) / (len(found) + SMOOTH))
    return logits


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: toxic likelier) and predicted (1 from 0.5 on); all columns of docs stay, but for columns of these two names, which are replaced.

    A null or empty text, or one without words, scores as the bias alone says. Ids may be null or repeat; each row is scored alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "predicted")
    names = [f"c{i}" for i in range(len(rest.columns))]  # a table may have columns of any names
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, rest.schema.fields, strict=True)]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    at = [n.lower() for n in rest.columns].index(text_col.lower())

    def run(batches):
        for part in slices(batches):
            texts = [t or "" for t in part.column(at).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(_score(texts, sent.value)), -50, 50)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return rest.toDF(*names).mapInArrow(given_back(run), schema).toDF(*rest.columns, "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that the model rejects; their columns stay, and so do repeated rows, rows without an id and empty texts that the model lets pass. An empty table stays empty."""
    model = fit(docs, labels, id_col, text_col)
    return score_toxicity(docs, model, id_col, text_col).where("predicted = 0").select(*docs.columns)
