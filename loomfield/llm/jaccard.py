"""N-gram Jaccard join by PartEnum signatures.

Sets fall into size bands, each 1 / similarity wide; sets of one band or of neighbouring bands can be similar, and a
similar pair of at most r elements each differs in at most k = 2 r (1 - s) / (1 + s) elements. The feature domain (the
64-bit hashes) is cut into coarse partitions and each of these into FINE fine ones. If a pair differs in at most k
elements, at most k // 2 of the coarse partitions hold two differences or more; in each of the others the pair agrees on
a subset of the fine partitions that leaves one out. These subsets are enumerated: what a set holds in one is a
signature. A set has signatures for its own band and for the next.

Sets of SMALL elements or fewer would leave most of so many partitions empty, and an empty subset is the same in all sets. They
have fewer coarse partitions, k // (j + 1) + 1, so that in one of them a pair differs in j elements at most, and each has
more fine ones, of which every subset that leaves j out is enumerated. j and the number of fine partitions are those of the
fewest signatures with which few unrelated sets would share one (`small_plan`).

Otherwise there are k // 2 + t coarse partitions, so that a similar pair agrees in t of them at least. A set may then leave out its
signatures in a fixed order of all signatures as long as they are of t - 1 coarse partitions at most: the last one on
which a pair agrees stays with both. The order begins with those that cover the fewest elements, which say the least.

Signatures are matched in buckets of their hash, in a stream: a task holds each signature of its bucket once, whatever the
number of sets that have it, and a signature that many sets of one task have is sent once. Each set is paired with two
sets (the least and the largest id) of each of its signatures. Then, wherever sets of one signature are still in different
components, every pair of them is taken. So a large group of copies costs few comparisons, and no link that could
join two components is left out. A pair of near copies shares hundreds of signatures and need be taken at one: signatures
have one order for all sets, those that most sets have first, and each set keeps its LEADING first ones at hand. A pair is
passed over at every signature but the first of those that lead both sets; where none does, it is taken at each.

Before a pair is checked on the sets themselves, parity sketches are compared: about one bit for each element, flipped by
every element that hashes to it. Sketches differ in no more bits than sets in elements, so a pair whose sketches differ
in more than (|a| + |b|) (1 - s) / (1 + s) bits is none.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions.common import Tables
from loomfield.llm.base import TEXT_ROWS, fits_broadcast, given_back, materialize, own_prefix, rows_per_batch, slices, text_bytes, text_or_empty

WORDS, PERCENT = 5, 80
#: Fine partitions of a coarse one; a signature leaves one out.
FINE = 3
#: Largest edge of the bands that leave out more than one fine partition; the share of pairs of unrelated sets that may share
#: a signature there, and the signatures of a set for a band, at most.
SMALL, UNRELATED, MOST_SIGNATURES = 46, 2e-5, 130
#: Signatures of a bucket on average, of a worker's buffer before it is sent, and bytes of a signature within its bucket.
BUCKET_SIGNATURES, BUFFER_SIGNATURES, SIGNATURE_BYTES = 1_000_000, 500_000, 5
#: 64-bit numbers that a sketch is folded to, and their columns.
FOLD = 8
FOLDS = [f"f{i}" for i in range(FOLD)]
#: Signatures of a set by which a pair is known to be taken elsewhere.
LEADING = 16
#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _P2
    x ^= x >> np.uint64(27)
    x *= _P1
    x ^= x >> np.uint64(31)
    return x


def _odd(at: np.ndarray) -> np.ndarray:
    return _mix(at.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
#: A number for each byte, the same for A-Z and a-z, and one for each place in a word.
_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * _P1)
_CODES[65:91] = _CODES[97:123]
_PLACES = _odd(np.arange(4096))


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of runs of these sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts that stand one after another up to ends, and each text's number of words."""
    starts = np.concatenate([[0], ends[:-1]])
    ink = ~_WHITE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    full = starts < ends  # texts meet without white space between them
    first[starts[full]] = ink[starts[full]]
    last[ends[full] - 1] = ink[ends[full] - 1]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    size = np.flatnonzero(last) + 1 - begin
    place = _places(size)
    terms = _PLACES[place] if size.max() <= len(_PLACES) else _odd(place)
    terms *= _CODES[data[ink]]
    hashes = _mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64))
    return hashes, np.diff(np.searchsorted(begin, ends), prepend=0)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles, sorted, one text after another, and their numbers.

    data: UTF-8 bytes of all texts up to ends. A text of fewer than n words is one shingle, one without words has none.
    """
    h, words = _words(data, ends)
    upto, m = np.cumsum(words), len(h)
    sums = np.zeros(m, np.uint64)
    for i in range(min(n, m)):
        sums[: m - i] += h[i:] * _PLACES[i]
    keys = _mix(sums)
    keep = np.ones(m, bool)
    for back in range(1, n):
        keep[(upto - back)[words >= back]] = False
    few = (words > 0) & (words < n)
    for d in np.flatnonzero(few).tolist():
        a, b = upto[d] - words[d], upto[d]
        keys[a] = _mix((h[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a))[0]
        keep[a] = True
    keys, count = keys[keep], np.where(words >= n, words - n + 1, few)
    at = 0
    for end in np.cumsum(count).tolist():
        keys[at:end].sort()
        at = end
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    begins = (np.cumsum(count) - count)[count > 0]
    fresh[begins] = True
    sizes = np.zeros(len(ends), np.int64)
    if len(begins):
        sizes[count > 0] = np.add.reduceat(fresh, begins, dtype=np.int64)
    return keys[fresh], sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums (mod 2**64) of values over runs of these sizes, which may be 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def set_ids(keys: np.ndarray, sizes: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each set, by the seed, and a second number that tells sets apart whose ids are the same."""
    ids = _mix(_sums(_mix(keys + np.uint64(seed)), sizes) + sizes.astype(np.uint64))
    return ids.view(np.int64), _sums(_mix(keys ^ _P1), sizes).view(np.int64)


def band_edges(percent: int, most: int) -> list[int]:
    """The largest size of each band; band i holds the sizes from edges[i - 1] + 1 to edges[i]."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, (edges[-1] + 1) * 100 // percent))
    return edges


def partitions(edge: int, percent: int) -> tuple[int, int]:
    """The coarse partitions for sets up to edge (0 if similar sets are equal there), and in how many of them a similar pair agrees."""
    k = 2 * edge * (100 - percent) // (100 + percent)
    t = 3 + k // 8
    return (k // 2 + t if k else 0), t


@lru_cache
def small_plan(edge: int, percent: int) -> tuple[int, int, int] | None:
    """For sets up to edge: the coarse partitions, the fine ones of each, and how many of these a signature leaves out; None if similar sets are equal there.

    Two unrelated sets share a signature if both have no element in what it covers. Of the plans with MOST_SIGNATURES at
    most it is the one of the fewest signatures that keeps within UNRELATED, or else the one that comes nearest.
    """
    k = 2 * edge * (100 - percent) // (100 + percent)
    if not k:
        return None
    size, plans = max(1, edge * percent * 9 // 1000), []  # of the smaller sets that use the plan
    for out in range(1, k + 1):
        coarse = k // (out + 1) + 1
        for fine in range(out + 1, 13):
            count = coarse * math.comb(fine, out)
            if count <= MOST_SIGNATURES or fine == out + 1:
                share = count * (1 - (1 - out / fine) / coarse) ** (2 * size)
                plans.append((share > UNRELATED, count if share <= UNRELATED else share, coarse, fine, out))
    return min(plans)[2:]


def _small_signatures(keys: np.ndarray, sizes: np.ndarray, mixed: np.ndarray, band: np.ndarray, edges: np.ndarray, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Signatures for the bands up to SMALL, and the sets that they are of."""
    found, owners = [], []
    ends = np.cumsum(sizes)
    for b in np.unique(band[(sizes > 0) & (edges[np.minimum(band, len(edges) - 1)] <= SMALL)]).tolist():
        plan = small_plan(int(edges[b]), percent)
        if plan is None:
            continue
        coarse, fine, out = plan
        sets = np.flatnonzero((band == b) & (sizes > 0))
        size, cells = sizes[sets], coarse * fine
        at = np.repeat(ends[sets] - size, size) + _places(size)
        cell = ((keys[at] >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(sets)) * cells, size)
        held = np.bincount(cell, minlength=len(sets) * cells).reshape(len(sets), cells)
        begin = (ends[sets] - size)[:, None] + np.cumsum(held, 1) - held  # the elements of a cell stand together
        sums = _mix((mixed[begin + held] - mixed[begin]).reshape(len(sets), coarse, fine) * _P1 + _PLACES[:fine])
        kept = np.array(list(combinations(range(fine), fine - out)))
        label = (np.uint64(b << 40 | 1 << 39) + np.arange(coarse * len(kept), dtype=np.uint64)).reshape(coarse, len(kept))
        found.append(_mix(sums[:, :, kept].sum(-1) * _P1 + _mix(label)).ravel())
        owners.append(np.repeat(sets, coarse * len(kept)))
    return found, owners


@lru_cache
def _plans(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of all bands of sizes below 2**31, and for each band over SMALL the coarse partitions and t."""
    edges = band_edges(percent, 1 << 31)
    return (np.array(edges), *np.array([(0, 1) if e <= SMALL else partitions(e, percent) for e in edges]).T)


def signatures(keys: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of sets, and the place of the set of each; small sets, whose only partners are copies, may have none."""
    edges, coarse_of, t_of = _plans(percent)
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(keys))])
    found, owners = [], []
    for ahead in (0, 1):
        band = np.searchsorted(edges, sizes) + ahead
        for whole, part in zip((found, owners), _small_signatures(keys, sizes, mixed, band, edges, percent), strict=True):
            whole += part
        coarse = np.where(sizes > 0, coarse_of[band], 0)
        cells = FINE * coarse
        begin = np.cumsum(cells) - cells
        whole = np.repeat(cells > 0, sizes)
        cell = ((keys >> np.uint64(32)) * np.repeat(cells, sizes).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(begin, sizes)
        held = np.bincount(cell[whole], minlength=int(cells.sum()))
        # the elements of a set are sorted, so those of a cell stand together
        set_starts = np.cumsum(sizes) - sizes
        before = np.cumsum(held) - held
        kept_before = np.cumsum(np.where(cells > 0, sizes, 0)) - np.where(cells > 0, sizes, 0)
        at = before + np.repeat(set_starts - kept_before, cells)
        sums = (mixed[at + held] - mixed[at]).reshape(-1, FINE)
        held = held.reshape(-1, FINE)
        sums = _mix(sums * _P1 + _PLACES[:FINE])
        label = (np.repeat(band, coarse) << 40 | _places(coarse) << 2).astype(np.uint64)[:, None] + np.arange(FINE, dtype=np.uint64)
        sigs = _mix((sums.sum(1, keepdims=True) - sums) * _P1 + _mix(label))
        # the order in which signatures may be left out: by the elements that they cover, then by themselves
        order = (np.minimum(held.sum(1, keepdims=True) - held, 255).astype(np.uint64) << np.uint64(56)) | (sigs >> np.uint64(8))
        least = order.min(1)
        first = np.zeros(len(sizes), np.uint64)
        a = 0
        for d in np.flatnonzero(coarse).tolist():
            b = a + coarse[d]
            first[d] = np.partition(least[a:b], t_of[band[d]] - 1)[t_of[band[d]] - 1]
            a = b
        stays = order >= np.repeat(first, coarse)[:, None]
        found.append(sigs[stays])
        owners.append(np.repeat(np.repeat(np.arange(len(sizes)), coarse), stays.sum(1)))
    return np.concatenate(found), np.concatenate(owners)


def sketches(keys: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each set's parity sketch, of 512 bits or the power of two that isn't below its size, and its fold to FOLD signed 64-bit numbers."""
    bits = np.maximum(64 * FOLD, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    place = (keys & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(begin, sizes)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8))
    folds = np.bitwise_xor.reduceat(packed.view(np.int64).reshape(-1, FOLD), begin // (64 * FOLD), axis=0)
    raw = packed.tobytes()
    return [raw[a : a + n] for a, n in zip((begin // 8).tolist(), (bits // 8).tolist(), strict=True)], folds


def _sets(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """id, n_shingles, set_id, check, the folded sketch and, once for each set in a task, sketch of every row."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        seen = set()
        for part in slices(batches, 128):
            keys, sizes = shingle_sets(*text_bytes(part.column(1)), n)
            ids, check = set_ids(keys, sizes, seed)
            raw, folds = sketches(keys, sizes)
            once = []
            for i, s in zip(ids.tolist(), raw, strict=True):
                once.append(None if i in seen else s)
                seen.add(i)
            columns = [part.column(0), *map(pa.array, (sizes, ids, check, *folds.T)), pa.array(once, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_id", "check", *FOLDS, "sketch"])

    numbers = "".join(f"{f} long, " for f in FOLDS)
    return docs.mapInArrow(given_back(run), f"id {kind}, n_shingles long, set_id long, check long, {numbers}sketch binary")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def _star_rows(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, owner, and the least and the largest owner of the key, of distinct rows of the keys that two or more owners have. Keys are sorted."""
    starts, sizes = _runs(key)
    low, high = (np.repeat(f.reduceat(owner, starts), sizes) if len(starts) else owner for f in (np.minimum, np.maximum))
    many = low != high
    key, owner, low, high = key[many], owner[many], low[many], high[many]
    order = np.lexsort((owner, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    order = order[fresh]
    return key[order], owner[order], low[order], high[order]


_SHARED = "sig long, set_id long, low long, high long"


def _shared(docs: DataFrame, n: int, percent: int, seed: int, buckets: int) -> DataFrame:
    """sig, set_id, low, high: the signatures that two or more sets share, with the sets that have them and two centres for each."""

    def messages(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, turn: int) -> pa.RecordBatch:
        """For each bucket its signatures and who has them; one owner stands for all of this task, whose rows pass on as they are."""
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        _, sizes = _runs(keys)
        starts = np.cumsum(sizes) - sizes
        rows = _star_rows(keys[many := np.repeat(sizes > 1, sizes)], ids[owner[many]])
        low = np.minimum.reduceat(ids[owner], starts)
        keys = keys[starts]
        names, owner = np.unique(low, return_inverse=True)
        cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40))
        raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES]
        out = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own, place = np.unique(owner[cuts[b] : cuts[b + 1]], return_inverse=True)
            out.append((b, names[own].tobytes(), raw[cuts[b] : cuts[b + 1]].tobytes(), place.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes(), None))
        out.append(((TaskContext.get().partitionId() * 31 + turn) % buckets, None, None, None, np.stack([rows[0].view(np.int64), *rows[1:]]).tobytes()))
        kinds = (pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "ids", "sigs", "owners", "rows"])

    def deal(batches):
        seen = set()  # of this task: a copy's signatures are sent once
        pending, names, turn = [], [], 0
        count = owners = 0
        for part in slices(batches, 128):
            keys, sizes = shingle_sets(*text_bytes(part.column(1)), n)
            ids, _ = set_ids(keys, sizes, seed)
            fresh = np.zeros(len(ids), bool)
            for d, i in enumerate(ids.tolist()):
                if i not in seen:
                    seen.add(i)
                    fresh[d] = True
            keys, sizes, ids = keys[np.repeat(fresh, sizes)], sizes[fresh], ids[fresh]
            sigs, owner = signatures(keys, sizes, percent)
            bucket = (sigs >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            pending.append((bucket << np.uint64(40) | sigs & np.uint64((1 << 40) - 1), owner + owners))
            names.append(ids)
            count, owners = count + len(sigs), owners + len(ids)
            if count >= BUFFER_SIGNATURES:
                yield messages(*map(np.concatenate, zip(*pending, strict=True)), np.concatenate(names), turn)
                pending, names, turn = [], [], turn + 1
                count = owners = 0
        if count:
            yield messages(*map(np.concatenate, zip(*pending, strict=True)), np.concatenate(names), turn)

    def match(batches):
        held, pending, count = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        table = lambda sig, *rest: pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), *map(pa.array, rest)], ["sig", "set_id", "low", "high"])

        def meet():
            """The rows of pending signatures among themselves and with those held; each signature is held with its least owner."""
            key, owner = (np.concatenate(x) for x in zip(held, *pending, strict=True))
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            starts, _ = _runs(key)
            return (key[starts], np.minimum.reduceat(owner, starts)), table(*_star_rows(key, owner))

        for batch in batches:
            for bucket, ids, sigs, owners, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows is not None:
                    yield table(*np.frombuffer(rows, np.int64).reshape(4, -1))
                    continue
                wide = np.zeros((len(sigs) // SIGNATURE_BYTES, 8), np.uint8)
                wide[:, :SIGNATURE_BYTES] = np.frombuffer(sigs, np.uint8).reshape(-1, SIGNATURE_BYTES)
                place = np.frombuffer(owners, "<u2" if len(owners) == 2 * len(wide) else "<u4")
                pending.append((wide.view("<u8").ravel() | np.uint64(bucket << 40), np.frombuffer(ids, np.int64)[place]))
                count += len(wide)
                if count >= BUCKET_SIGNATURES:
                    held, found = meet()
                    yield found
                    pending, count = [], 0
        if count:
            yield meet()[1]

    packed = docs.mapInArrow(given_back(deal), "bucket long, ids binary, sigs binary, owners binary, rows binary")
    return packed.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(given_back(match), _SHARED)


def _elements(docs: DataFrame, sets: DataFrame, wanted: DataFrame, n: int, seed: int) -> DataFrame:
    """set_id, elements (their hashes, sorted) of the wanted sets."""
    # one document of each set; a null id can stand for its set only if no other row has it
    ids = sets.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("id").alias("wanted")).select("wanted").distinct()
    ids = F.broadcast(ids) if fits_broadcast(ids, BROADCAST_IDS) else ids
    some = docs.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("id", "text")

    def run(batches):
        seen = set()
        for part in slices(batches, 128):
            keys, sizes = shingle_sets(*text_bytes(part.column(1)), n)
            names, blobs, at = [], [], 0
            for i, size in zip(set_ids(keys, sizes, seed)[0].tolist(), sizes.tolist(), strict=True):
                if i not in seen:
                    seen.add(i)
                    names.append(i)
                    blobs.append(keys[at : at + size].tobytes())
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["set_id", "elements"])

    found = some.mapInArrow(given_back(run), "set_id long, elements binary")
    return found.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.first("elements").alias("elements"))


def _checked(pairs: DataFrame, of_set: DataFrame, value: str, test) -> DataFrame:
    """The pairs (a, b) whose values (those of of_set for their sets) pass the test."""

    def run(batches):
        for part in slices(batches, 256):
            mask = pa.array([test(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    left = pairs.join(of_set.select(F.col("set_id").alias("a"), F.col(value).alias("x")), "a")
    both = left.join(of_set.select(F.col("set_id").alias("b"), F.col(value).alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(given_back(run), "a long, b long")


def _links(tables: Tables, turn: int, pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, n: int, seed: int) -> DataFrame | None:
    """The pairs (a, b) of sets that are similar enough, by their sketches first and then by their elements."""
    wanted = lambda pairs: pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()

    def alike(x: dict, y: dict) -> bool:
        n, m, p, q = x["n"], y["n"], x["sketch"], y["sketch"]
        if 100 * n < percent * m or 100 * m < percent * n:
            return False
        p, q = (np.frombuffer(r, np.uint64).reshape(-1, min(len(p), len(q)) // 8) for r in (p, q))
        apart = np.bitwise_count(np.bitwise_xor.reduce(p) ^ np.bitwise_xor.reduce(q)).sum()
        return bool(int(apart) * (100 + percent) <= (n + m) * (100 - percent))

    def similar(x: bytes, y: bytes) -> bool:
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return 100 * both >= percent * ((len(x) + len(y)) // 8 - both)

    pairs = tables.write(pairs, f"pairs-{turn}")
    drawn = sets.where("sketch IS NOT NULL").join(wanted(pairs), "set_id", "left_semi")
    drawn = drawn.groupBy("set_id").agg(F.first(F.struct(F.col("n_shingles").alias("n"), "sketch")).alias("drawn"))
    near = tables.write(_checked(pairs, drawn, "drawn", alike), f"near-{turn}")
    if near.isEmpty():
        return None
    with rows_per_batch(docs.sparkSession, TEXT_ROWS // 4):
        elements = tables.write(_elements(docs, sets, wanted(near), n, seed), f"elements-{turn}")
        links = tables.write(_checked(near, elements, "elements", similar), f"links-{turn}")
    for name in ("pairs", "near", "elements"):
        tables.drop(f"{name}-{turn}")
    return links


def components(edges: DataFrame, tables: Tables, name: str = "stars") -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b), by large-star and small-star turns until nothing changes."""
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before, turn = tables.write(start, f"{name}-0"), None, 0
    while True:
        found = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == found:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct().toDF("node", "component"))
        before = found
        both = stars.union(stars.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(ends).alias("e")).select("e.*")
        turn += 1
        stars = tables.write(small.where("u <> v").distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")


def _can_link(percent: int) -> Column:
    """Whether the sizes and folded sketches of a row's set and of its other (size, of0, of1, ...) allow a link."""
    n, m = F.col("n_shingles"), F.col("size")
    apart = reduce(Column.__add__, (F.bit_count(F.col(f).bitwiseXOR(F.col(f"o{f}"))) for f in FOLDS))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _led(rows: DataFrame) -> DataFrame:
    """Each (set_id, sig) of rows once, with leading: the set's first LEADING signatures, those that most sets have (held) first."""
    order = Window.partitionBy("set_id").orderBy(F.desc("held"), "sig")
    rows = rows.withColumn("place", F.dense_rank().over(order)).withColumn("again", F.coalesce(F.lag("sig").over(order) == F.col("sig"), F.lit(False)))
    first = F.collect_set(F.when(F.col("place") <= LEADING, F.struct("place", "sig"))).over(Window.partitionBy("set_id"))
    return rows.withColumn("leading", F.sort_array(first)["sig"]).where("NOT again").drop("place", "again", "held")


def _open_pairs(shared: DataFrame, labels: DataFrame | None, sizes: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """a, b: the pairs of sets that share a signature, aren't in one component and can link, all of them.

    In each signature the sets of one component (that of the least set) needn't be compared with each other, so pairs are
    those of a set outside of it with any other.
    """
    named = shared.select("sig", "set_id")
    if labels is not None:
        named = named.join(F.broadcast(labels) if fits_broadcast(labels, BROADCAST_IDS) else labels, "set_id", "left")
        named = named.withColumn("component", F.coalesce("component", "set_id"))
    else:
        named = named.withColumn("component", F.col("set_id"))
    main = named.groupBy("sig").agg(F.min_by("component", "set_id").alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).where("lo <> hi")
    rows = _led(named.join(main.select("sig", "main", "held"), "sig")).join(sizes.select("set_id", "n_shingles", *FOLDS), "set_id")
    rows = tables.write(rows.withColumn("apart", F.col("component") != F.col("main")).drop("main"), "open-rows")
    others = rows.withColumnsRenamed({"set_id": "b", "component": "of", "n_shingles": "size", "apart": "both", "leading": "others"} | {f: f"o{f}" for f in FOLDS})
    # a pair that shares leading signatures is taken at the first of them alone
    here = F.coalesce(F.get(F.array_intersect("leading", "others"), F.lit(0)), F.col("sig")) == F.col("sig")
    fits = (F.col("component") != F.col("of")) & (~F.col("both") | (F.col("set_id") < F.col("b"))) & _can_link(percent) & here
    found = rows.where("apart").join(others, "sig").where(fits)
    return found.select(F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two rows link when 100 * intersection >= percent * union of their shingle sets. A null or empty text, or one without
    words, has no shingles, links with nothing and is its own component. Rows may repeat: rows of equal sets link. A
    null id reaches others and takes their smallest id; alone, its component is null. An empty table gives no rows. Other columns are ignored.
    The result reads two tables in the shared folder, the rows' sets and the components; all others are gone by then.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    seed = 0
    while True:
        with rows_per_batch(spark, TEXT_ROWS):
            sets = materialize(_sets(rows, n, seed), "shingle-sets")
        each = F.max("n_shingles").alias("n_shingles"), *(F.max(f).alias(f) for f in FOLDS), F.min("id").alias("least"), F.count("*").alias("n_rows"), (F.min("check") != F.max("check")).alias("mixed")
        with Tables(spark, "jaccard") as tables:
            sizes = tables.write(sets.where("n_shingles > 0").groupBy("set_id").agg(*each), "sizes")
            if sizes.agg(F.coalesce(F.bool_or("mixed"), F.lit(False))).first()[0]:  # two sets have one id: all draw new ones
                seed += 1
                continue
            # for each element of a large set less than one signature, for a small set so many at most
            most = sizes.agg(F.sum(F.when(F.col("n_shingles") <= SMALL, 2 * MOST_SIGNATURES).otherwise(F.col("n_shingles")))).first()[0] or 0
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(most / BUCKET_SIGNATURES))
            with rows_per_batch(spark, TEXT_ROWS):
                shared = tables.write(_shared(rows, n, percent, seed, buckets), "shared")
            stars = shared.select("set_id", F.explode(F.array("low", "high")).alias("centre")).where("set_id <> centre")
            stars = stars.select(F.least("set_id", "centre").alias("a"), F.greatest("set_id", "centre").alias("b")).distinct()
            links = _links(tables, 0, stars, rows, sets, percent, n, seed)
            labels = None if links is None else components(links, tables, "stars-0").withColumnRenamed("node", "set_id")
            more = _links(tables, 1, _open_pairs(shared, labels, sizes, percent, tables), rows, sets, percent, n, seed)
            if more is not None:
                links = more if links is None else links.union(more)
                labels = components(links, tables, "stars-1").withColumnRenamed("node", "set_id")
            # sets of one row without a link need no label
            reach = sizes.where("n_rows > 1").select("set_id", "least")
            if labels is not None:
                named = sizes.select("set_id", "least").join(labels, "set_id")
                ends = named.groupBy("component").agg(F.min("least").alias("end"))
                ends = F.broadcast(ends) if fits_broadcast(ends, BROADCAST_IDS) else ends
                named = named.join(ends, "component").select("set_id", "end")
                reach = reach.join(named, "set_id", "full").select("set_id", F.coalesce("end", "least").alias("least"))
            reach = materialize(reach.withColumn("linked", F.lit(True)), "components")
            break
    reach = F.broadcast(reach) if fits_broadcast(reach, BROADCAST_IDS) else reach
    whole = sets.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")).join(reach, "set_id", "left")
    return whole.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of the smallest id; documents without words all stay.

    Rows without an id stay. Of rows that repeat the kept id all stay. Columns stay as they are.
    """
    own = own_prefix(docs)
    found = near_duplicates(docs, percent, n, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(own + "gone")).distinct()
    gone = materialize(gone, "near-copies")
    gone = F.broadcast(gone) if fits_broadcast(gone, BROADCAST_IDS) else gone
    return docs.join(gone, F.col(id_col) == F.col(own + "gone"), "left_anti")
