"""Packing along a space-filling curve.

Each document's token ids become a hashed vector (one coordinate for each bucket of ids), projected to three dimensions
by a fixed table of signs; the direction of that projection, on a grid, has a Hilbert key. Documents stand in the
order of their keys, so neighbours in a sequence are alike, and the stream of their ids is cut every `length` tokens:
only the last sequence of all can have room left.

Ids are written once, with their keys and counts. Only the narrow columns (key, row, count) are sorted by range; running
sums within a range and the ranges' totals give each document its place in the stream. The ids meet their place by one
join on the row's number, where each row cuts itself into its pieces.
"""

from __future__ import annotations

import itertools
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.base import TEXT_ROWS, given_back, materialize, rows_per_batch, slices, text_bytes, text_or_empty

DIMENSIONS, BITS = 3, 10
BUCKETS = 1024
#: Pieces in each of the two generations of a worker's cache.
CACHE_ENTRIES = 120_000
def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden) if b != ord("\n")}


_BYTES = _byte_characters()
_LETTER = np.isin(np.arange(256), [ord(c) for c in string.ascii_letters])
#: Marks after letters begin a pre-token; an apostrophe may belong to the letters after it.
_MARK = np.isin(np.arange(256), [ord(c) for c in string.punctuation if c != "'"])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)

_workers: dict = {}


class Pieces:
    """Ids (little-endian unsigned 16-bit numbers) of pieces of text, encoded once and kept in two generations: what a full one hasn't been asked for is forgotten with the next."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.young, self.old = {}, {}
        words = ["a", "abc", "hello", "straße", "àéÿµª"]
        #: Whether upper case means nothing, and whether letters may go to the merges as they are.
        self.folds = all(self.alone(w.upper()) == self.alone(w) for w in words[:3])
        self.plain = all(self._merged([w])[0] == self.alone(w) for w in words)

    def alone(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of words of Latin-1 letters, which no normalization but lower case changes, by the vocabulary's merges alone."""
        merge = self.tok.model.tokenize
        text = "\n".join(words).lower() if self.folds else "\n".join(words)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(_BYTES)
        return [np.array([t.id for t in merge(w)], "<u2").tobytes() for w in text.split("\n")]

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        ascii, latin, other = [], [], []
        for p in pieces:
            if not (self.plain and p.isalpha()):
                other.append(p)
            elif p.isascii():
                ascii.append(p)
            else:
                (latin if max(p) <= "\xff" else other).append(p)
        found = {}
        for some, way in ((ascii, self._merged), (latin, self._merged), (other, self._each)):
            if some:
                found.update(zip(some, way(some), strict=True))
        return found

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.young.get, pieces))
        missed = [p for p, raw in zip(pieces, found, strict=True) if raw is None]
        if missed:
            again = list(map(self.old.get, missed))
            known = {p: raw for p, raw in zip(missed, again, strict=True) if raw is not None}
            known |= self._encode([p for p, raw in zip(missed, again, strict=True) if raw is None])
            if len(self.young) + len(known) > CACHE_ENTRIES:
                self.young, self.old = {}, self.young
            self.young |= known
            found = [known[p] if raw is None else raw for p, raw in zip(pieces, found, strict=True)]
        return found


def _spaced(texts: pa.Array, folds: bool) -> pa.Array:
    """The texts with a space between ASCII letters and a mark after them, in lower case if that is all the same."""
    data, ends = text_bytes(texts)
    data = _LOWER[data] if folds else data
    at = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    bounds = np.append(0, ends)
    bounds += np.searchsorted(at, bounds)  # a space on the border of two texts is the second's
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(np.insert(data, at, 32))])


def token_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, end_id after each, one text after another, and where each text ends.

    The tokenizer never joins characters across white space, nor letters and the marks after them, so pieces between these
    are encoded once and kept; a text with one of the tokenizer's special strings is one piece.
    """
    if path not in _workers:
        _workers[path] = Pieces(path)
    pieces = _workers[path]
    spaced = _spaced(texts, pieces.folds)
    whole = np.zeros(len(texts), bool)
    for s in pieces.special:
        for form in (texts, pc.ascii_lower(texts)) if pieces.folds else (texts,):
            whole |= pc.match_substring(form, s).to_numpy(zero_copy_only=False)
    alone = [pieces.alone(t) for t in texts.filter(pa.array(whole)).to_pylist()]
    cut = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", spaced) if alone else spaced)
    words = cut.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    # behind the distinct pieces stand the end and the whole texts
    raw = [*pieces.ids_of(distinct), np.array([end_id], "<u2").tobytes(), *alone]
    flat, size = np.frombuffer(b"".join(raw), "<u2"), np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    upto = np.asarray(cut.offsets).astype(np.int64)
    word = np.insert(np.asarray(words.indices).astype(np.int64), np.concatenate([upto[1:][whole], upto[1:]]), np.concatenate([len(distinct) + 1 + np.arange(len(alone)), np.full(len(texts), len(distinct))]))
    ends_of_word = np.cumsum(size[word])
    at = np.repeat((np.cumsum(size) - size)[word] - (ends_of_word - size[word]), size[word]) + np.arange(ends_of_word[-1] if len(word) else 0)
    extra = np.arange(1, len(texts) + 1) + np.cumsum(whole)
    return flat[at], ends_of_word[upto[1:] + extra - 1]


def projection(dimensions: int = DIMENSIONS, buckets: int = BUCKETS, seed: int = 11) -> np.ndarray:
    """Coordinates of every 16-bit id: the signs of its bucket."""
    rng = np.random.default_rng(seed)
    signs = rng.choice(np.array([-1.0, 1.0], np.float32), (buckets, dimensions))
    ids = np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)
    return signs[(ids >> np.uint32(16)) % buckets]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of unsigned grid points (rows), by the transposed-axes method."""
    x = points.astype(np.uint32).T.copy()
    n = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = q - np.uint32(1)
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - np.uint32(1)), t)
        q >>= np.uint32(1)
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> np.uint32(b) & np.uint32(1)).astype(np.int64)
    return key


def curve_keys(ids: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids stand one after another up to ends; there is an id at least in each."""
    sums = np.add.reduceat(table[ids], np.concatenate([[0], ends[:-1]]), axis=0)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(norm > 0, norm, 1)
    grid = np.clip((unit + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(grid.astype(np.uint32))


def _encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """row, id, n_tokens, key, ids of every row, written to the shared folder."""

    def run(batches):
        table = projection()
        task, counter = TaskContext.get().partitionId(), itertools.count()
        for part in slices(batches):
            ids, ends = token_ids(part.column(1), path, end_id)
            counts = np.diff(ends, prepend=0)
            rows = [(task << 33) + next(counter) for _ in counts]
            blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), part.column(0), pa.array(counts), pa.array(curve_keys(ids, ends, table)), blobs], ["row", "id", "n_tokens", "key", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    with rows_per_batch(docs.sparkSession, TEXT_ROWS):
        return materialize(rows.mapInArrow(given_back(run), f"row long, id {kind}, n_tokens long, key long, ids binary"), "packing-ids")


def _placed(narrow: DataFrame, parts: int) -> DataFrame:
    """row, place: the tokens before each row in the order of (key, row)."""

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.asarray(batch.column(1))
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), batch.column(1)], ["row", "part", "within", "n_tokens"])
            before = int(ends[-1]) if len(ends) else before

    ordered = narrow.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("row", "n_tokens")
    # written, since ranges are drawn anew whenever the plan runs
    ordered = materialize(ordered.mapInArrow(run, "row long, part long, within long, n_tokens long"), "packing-places")
    totals = sorted(ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row for each of `parts`
    bases = list(itertools.accumulate((n for _, n in totals), initial=0))
    spark = narrow.sparkSession
    table = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, bases, strict=False)], "part long, base long")
    return ordered.join(F.broadcast(table), "part").select("row", (F.col("base") + F.col("within")).alias("place"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 16 bits).

    A document's ids are those of its text and end_id. Sequences of `length` tokens are full, but for the last. A null text
    is empty: its document is end_id alone. Ids may be null or repeat: every row of docs is a document of its own. An
    empty table gives no pieces. Other columns are ignored. A tokenizer of more than 65,536 ids raises ValueError.
    """
    encoded = _encoded(docs, tokenizer_path, end_id, id_col, text_col)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(encoded.select("row", "n_tokens", "key"), parts)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 64):
            at, starts, lengths, crcs, sequences, offsets, pieces = [], [], [], [], [], [], []
            for i, (place, raw) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                n, start = len(raw) // 2, 0
                wide = np.frombuffer(raw, "<u2").astype("<u4")
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    take = min(length - offset, n - start)
                    at.append(i)
                    starts.append(start)
                    lengths.append(take)
                    crcs.append(zlib.crc32(wide[start : start + take].tobytes()))
                    sequences.append(sequence)
                    offsets.append(offset)
                    pieces.append(raw[2 * start : 2 * (start + take)])
                    start += take
            taken = pa.array(at, pa.int64())
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(taken), *longs, part.column(1).take(taken), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()), pa.array(pieces, pa.binary())], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    joined = encoded.join(placed, "row").select("id", "n_tokens", "place", "ids")
    pieces = joined.mapInArrow(given_back(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("id", id_col)
