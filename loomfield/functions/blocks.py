"""A table as blocks in files, which tasks read one after another: each row is written once, not copied for each pair of blocks.

A task holds a batch of its own rows and one block at a time. On a line (vectors of one component, distances |x - y|) blocks
are sorted, and a row's neighbours and ranks are found by bisection; elsewhere a batch meets each block's every row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from loomfield.functions.common import shared_dir


class Blocks:
    """df dealt by key to files of some `rows` rows, each sorted by order, in the shared folder."""

    def __init__(self, df: DataFrame, key: str, rows: int, order: list[str]):
        self.path = f"{shared_dir(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
        self.rows = df.count()
        n = max(1, -(-self.rows // rows))
        df.repartition(n, key).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(self.path)

    def __iter__(self) -> Iterator[pa.Table]:
        """The blocks, read by the task that asks."""
        local = self.path.removeprefix("file://").removeprefix("file:")
        store, path = fs.FileSystem.from_uri(local) if ":/" in local else (fs.LocalFileSystem(), local)
        for name in sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")):
            yield pq.read_table(name, filesystem=store)


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's rows as tables of some `rows` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def line_distance(x: np.ndarray, gallery: np.ndarray) -> np.ndarray:
    """|x - y| of vectors of one component; operators that are given this very function find neighbours by bisection."""
    return np.abs(gallery[:, 0] - x[0])


def _first(low: np.ndarray, high: np.ndarray, guess: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the least place in [low, high] from which on test(rows, places) holds, high if nowhere; guess is near it."""
    at, rows = np.clip(guess, low, high), np.arange(len(low))
    for _ in range(3):
        down, up = at[rows] > low[rows], at[rows] < high[rows]
        down[down] = test(rows[down], at[rows[down]] - 1)
        up[up] = ~test(rows[up], at[rows[up]])
        at[rows] += up.astype(np.int64) - down
        rows = rows[up | down]
        if not len(rows):
            return at
    lo, hi = low[rows].copy(), high[rows].copy()
    while (open_ := lo < hi).any():
        r, mid = rows[open_], (lo[open_] + hi[open_]) // 2
        holds = test(r, mid)
        hi[open_], lo[open_] = np.where(holds, mid, hi[open_]), np.where(holds, lo[open_], mid + 1)
    at[rows] = lo
    return at


class Line:
    """A block (y, id), sorted by both with NaN last."""

    def __init__(self, y: np.ndarray, ids: np.ndarray):
        self.m = len(y) - int(np.isnan(y).sum())
        self.y, self.ids, self.none, self.every = y[: self.m], ids[: self.m], ids[self.m :], (y, ids)
        new = np.flatnonzero(np.concatenate([[True], self.y[1:] != self.y[:-1]])) if self.m else np.zeros(0, np.int64)
        self.values, self.starts = self.y[new], np.append(new, self.m)

    def nearer(self, x: np.ndarray, d: np.ndarray, gid: np.ndarray) -> np.ndarray:
        """How many rows stand before (d, gid) in the order of (distance from x, id), for each x; NaN is the largest distance."""
        out, u = np.zeros(len(x), np.int64), self.values
        plain = np.isfinite(x) & ~np.isnan(d)
        nothing = np.isfinite(x) & np.isnan(d)  # only rows without a value are as far
        out[nothing] = self.m + np.searchsorted(self.none, gid[nothing])
        for i in np.flatnonzero(~plain & ~nothing):  # a query without a value, or an infinite one
            y, ids = self.every
            with np.errstate(invalid="ignore"):
                far = np.abs(y - x[i])
            before = ~np.isnan(far) if np.isnan(d[i]) else far < d[i]
            same = np.isnan(far) if np.isnan(d[i]) else far == d[i]
            out[i] = before.sum() + (same & (ids < gid[i])).sum()
        rows = np.flatnonzero(plain)
        x, d, gid = x[rows], d[rows], gid[rows]
        far = lambda r, at: np.abs(u[at] - x[r])
        p, n = np.searchsorted(u, x), np.full(len(rows), len(u))
        zero = np.zeros(len(rows), np.int64)
        right, left = np.searchsorted(u, x + d), np.searchsorted(u, x - d)
        below = [_first(zero, p, left + i, lambda r, at, less=less: less(far(r, at), d[r])) for i, less in ((0, np.less_equal), (1, np.less))]
        above = [_first(p, n, right + i, lambda r, at, more=more: more(far(r, at), d[r])) for i, more in ((0, np.greater_equal), (1, np.greater))]
        count = self.starts[above[0]] - self.starts[below[1]]
        for a, b in (below, above):  # values at the distance itself: their smaller ids
            one = np.flatnonzero(b - a == 1)
            low = self.starts[a[one]]
            end = self.starts[a[one] + 1]
            lo, hi = low.copy(), end.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                less = open_ & (self.ids[np.minimum(mid, self.m - 1)] < gid[one])
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            count[one] += lo - low
            for i in np.flatnonzero(b - a > 1):  # values so near that their distances are rounded to the same
                count[i] += (self.ids[self.starts[a[i]] : self.starts[b[i]]] < gid[i]).sum()
        out[rows] = count
        return out

    def nearest(self, qid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, distance, id (a row for each x, at least k columns): the rows that hold the k nearest by (distance, id), without those of the query's own id."""
        out = [np.zeros((len(x), 3 * (k + 1)), t) for t in (bool, float, np.int64)]
        brute = ~np.isfinite(x)
        p = np.searchsorted(self.y, x)
        for side, at, ok in self._windows(p, k + 1) if self.m else ():
            y, ids, place = self.y[at], self.ids[at], slice(side * (k + 1), (side + 1) * (k + 1))
            after = p + k + 1 if side else p - k - 2
            beyond = self.y[np.clip(after, 0, self.m - 1)]
            with np.errstate(invalid="ignore"):
                far, level = np.abs(y - x[:, None]), np.abs(beyond - x)
            own = ok & (ids == qid[:, None])
            out[0][:, place], out[1][:, place], out[2][:, place] = ok & ~own, far, ids
            # rounding makes values beyond the window as far as others in it, or an id stands in several rows
            rounded = (ok & (far == level[:, None]) & (y != beyond[:, None])).any(1)
            brute |= (after >= 0) & (after < self.m) & rounded | (own.sum(1) > 1)
        last = self.none[: k + 1]
        if len(last):
            place, own = slice(2 * (k + 1), 2 * (k + 1) + len(last)), last[None] == qid[:, None]
            out[0][:, place], out[1][:, place], out[2][:, place] = ~own, np.nan, last
            brute |= own.sum(1) > 1
        for i in np.flatnonzero(brute):
            y, ids = self.every
            others = np.flatnonzero(ids != qid[i])
            with np.errstate(invalid="ignore"):
                far = np.abs(y[others] - x[i])
            best = np.lexsort((ids[others], far))[:k]
            out[0][i] = np.arange(out[0].shape[1]) < len(best)
            out[1][i, : len(best)], out[2][i, : len(best)] = far[best], ids[others][best]
        return tuple(out)

    def _windows(self, p: np.ndarray, n: int):
        """Places of the n rows below x and of the n from x on (sides 0 and 1), and which there are; of a run of equal values that is cut the smallest ids."""
        steps = np.arange(n)
        at = p[:, None] - 1 - steps
        ok = at >= 0
        last = np.maximum(p - n, 0)
        of = np.searchsorted(self.starts, last, "right") - 1
        start, end = self.starts[of], np.minimum(self.starts[np.minimum(of + 1, len(self.starts) - 1)], p)
        cut = at < end[:, None]
        yield 0, np.where(ok, np.where(cut, at - last[:, None] + start[:, None], at), 0), ok
        at = p[:, None] + steps
        ok = at < self.m
        yield 1, np.where(ok, at, 0), ok


def best(k: int, found: np.ndarray, far: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first columns of each row by (distance, id), those that aren't found last."""
    by = np.lexsort((ids, far, ~found), axis=1)[:, :k]
    return tuple(np.take_along_axis(a, by, 1) for a in (found, far, ids))
