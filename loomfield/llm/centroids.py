"""Centroid clustering of integer vectors with a LAESA pivot table.

Each vector's distances to a few fixed pivots are computed and stored once. A round gets the centroids' distances to the
same pivots; by the triangle inequality no centroid is nearer to a vector than the largest difference of their pivot
distances. A vector first takes the exact distance of the centroid whose bound is smallest, then of every centroid whose
bound doesn't exceed it. Distances are exact integers, bounds doubles with a margin for rounding, so no nearest centroid
and no tie is lost. Tasks send a sum for each cluster and dimension; the driver holds k centroids and nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.base import given_back, materialize, slices

#: Pivots, and rows of smallest hash among which they are chosen.
PIVOTS, PIVOT_ROWS = 8, 256
#: Components are held within this, so that a squared distance of up to 1,024 of them fits a long.
MOST = 1 << 25
#: Vectors of a step: their bounds and differences are held at once.
STEP_ROWS = 4096
_MAX_LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id, v (floor(scale * x) of each component) of the rows with exactly dims components, none of them null or non-finite."""
    x = F.col(vector_col).cast("array<double>")
    usable = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * scale).cast("long"), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def hash_order(seed: int) -> list[Column]:
    """The order of the first centroids: by hash, rows of one id by their vectors; a null id counts as an empty one."""
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), F.col("v")]


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows (fewer if they are no more): each has the largest sum of distances to those chosen before."""
    chosen, total = [0], np.zeros(len(rows))
    while len(chosen) < min(n, len(rows)):
        total += np.sqrt(((rows - rows[chosen[-1]]) ** 2).sum(1).astype(float))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return rows[chosen]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to each of few points, from exact squares."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1).astype(float)) for p in points], 1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties to the smaller number), the exact squared distance, and how many exact distances it took."""
    bound = np.zeros((len(x), len(centroids)))
    for j in range(to_pivots.shape[1]):
        a, b = to_pivots[:, j, None], centroid_pivots[None, :, j]
        np.maximum(bound, np.abs(a - b) - (a + b) * 2.0**-48, out=bound)
    first = bound.argmin(1)
    square = lambda rows, of: ((x[rows] - centroids[of]) ** 2).sum(1)
    best, cluster = square(np.arange(len(x)), first), first.copy()
    open_ = bound <= np.sqrt(best.astype(float))[:, None] * (1 + 2.0**-48)
    open_[np.arange(len(x)), first] = False
    taken = len(x) + int(open_.sum())
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        if len(rows):
            d = square(rows, np.full(len(rows), c))
            better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = d[better], c
    return cluster, best, taken


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1)


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, to_pivots of all rows, written once."""

    def run(batches):
        for part in slices(batches, STEP_ROWS):
            to = distances(_matrix(part.column(1), np.int64), pivots)
            ends = pa.array(np.arange(len(to) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(to.ravel()))], ["id", "v", "to_pivots"])

    return materialize(rows.mapInArrow(given_back(run), "id long, v array<int>, to_pivots array<double>"), "pivot-table")


def cluster_sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of the rows nearest to each centroid that has any."""
    to, dims = distances(centroids, pivots), centroids.shape[1]

    def run(batches):
        sums = np.zeros((len(centroids), dims + 1), np.int64)
        for part in slices(batches, STEP_ROWS):
            x = _matrix(part.column(1), np.int64)
            cluster = nearest(x, _matrix(part.column(2), float), centroids, to)[0]
            order = np.argsort(cluster, kind="stable")
            found, begins = np.unique(cluster[order], return_index=True)
            if len(found):
                sums[found, :dims] += np.add.reduceat(x[order], begins)
                sums[found, dims] += np.diff(np.append(begins, len(order)))
        at = np.flatnonzero(np.repeat(sums[:, dims] > 0, dims + 1))
        yield pa.RecordBatch.from_arrays([*map(pa.array, ((at // (dims + 1)).astype(np.int32), (at % (dims + 1)).astype(np.int32), sums.ravel()[at]))], ["cluster", "d", "total"])

    out: dict[int, list] = {}
    sent = table.mapInArrow(given_back(run), "cluster int, d int, total long")
    for c, d, total in sent.groupBy("cluster", "d").agg(F.sum("total")).collect():  # k * (dims + 1) numbers
        out.setdefault(c, [0] * (dims + 1))[d] = total
    return {c: (x[dims], x[:dims]) for c, x in out.items()}


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x), held within +-2**25. The k usable rows of smallest hash of seed and id are the
    first centroids (all, if fewer). Each round assigns every row to the nearest centroid, ties to the smaller number, and
    takes the floored mean of a cluster's rows; a cluster without rows keeps its centroid. Then rows are assigned once more.
    Rows that are null, of another length or hold null or non-finite components give no row. Repeated rows each count, and
    can be centroids each; a null id hashes as an empty one. Inertias end at the largest long. An empty table gives no
    rows. Other columns are ignored. The result reads a table in the shared folder.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale, id_col, vector_col)
    fixed = np.array([r.v for r in rows.orderBy(*hash_order(seed)).limit(max(k, PIVOT_ROWS)).select("v").collect()], np.int64).reshape(-1, dims)
    if not len(fixed):
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, fixed = fixed[:k].copy(), far_apart(fixed, pivots)
    table = pivot_table(rows, fixed)
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(table, centroids, fixed).items():
            centroids[c] = [s // n for s in sums]
    to = distances(centroids, fixed)

    def run(batches):
        for part in slices(batches, STEP_ROWS):
            cluster, distance, _ = nearest(_matrix(part.column(1), np.int64), _matrix(part.column(2), float), centroids, to)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    assigned = materialize(table.mapInArrow(given_back(run), "id long, cluster int, distance long"), "clusters")
    sums = {c: int(s) for c, s in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k numbers
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    total = min(sum(sums.values()), _MAX_LONG)
    facts = spark.createDataFrame([(c, min(s, _MAX_LONG), total, digest(c)) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
