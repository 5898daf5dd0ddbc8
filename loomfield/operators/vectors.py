"""Similarity joins, distances, covariance and whitening of embedding vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.blocks import Blocks, Line, best, gathered, line_distance, numbers
from loomfield.functions.common import materialize

#: Rows in a block of queries and in a block of the gallery, on average.
QUERY_BLOCK, GALLERY_BLOCK = 2048, 4096
#: The same on a line, where a query meets few rows of a block.
LINE_QUERIES, LINE_BLOCK = 1 << 14, 1 << 22


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _blocks(queries: DataFrame, gallery: DataFrame):
    """Queries and gallery (id, v) dealt to every pair of a query block and a gallery block."""
    nq, ng = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-gallery.count() // GALLERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(deal(nq).alias("qb"), every(ng).alias("gb"), "id", "v")
    g = gallery.select(deal(ng).alias("gb"), every(nq).alias("qb"), "id", "v").select("qb", "gb", "id", "v")
    return q, g


def knn_topk_join(queries: DataFrame, gallery: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", digits: int = 9, skip_own: bool = False) -> DataFrame:
    """qid, gid, sim, rank: the k gallery rows of highest cosine (rounded, so that equal ones tie; then the smaller id) for each query row; with skip_own never the row of the query's own id.

    The gallery is written once, in blocks that each task reads one after another; a task keeps k rows for each of its queries,
    and no vector is copied in a shuffle but the queries' own, once.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    q, blocks = pick(queries), Blocks(pick(gallery), "id", GALLERY_BLOCK, ["id"])

    def search(batches):
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        for t in gathered(batches, QUERY_BLOCK):
            qid, x = numbers(t["id"]), unit(_matrix(t["v"]))
            row, gid, sim, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(qid), -np.inf)
            for block in blocks:
                if not block.num_rows:
                    continue
                ids = numbers(block["id"])
                sims = np.round(x @ unit(_matrix(block["v"])).T, digits)
                if skip_own:
                    sims[qid[:, None] == ids[None, :]] = -np.inf
                if len(ids) > k and not len(row):  # a first bound: the k-th largest of this block
                    least = np.partition(np.where(np.isfinite(sims), sims, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
                r, c = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
                row, gid, sim = np.concatenate([row, r]), np.concatenate([gid, ids[c]]), np.concatenate([sim, sims[r, c]])
                by = np.lexsort((gid, -sim, row))
                row, gid, sim = row[by], gid[by], sim[by]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                row, gid, sim, rank = row[keep], gid[keep], sim[keep], rank[keep]
                least[row[rank == k - 1]] = sim[rank == k - 1]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(gid), pa.array(sim), pa.array(rank.astype(np.int32))], ["qid", "gid", "sim", "rank"])

    tasks = max(1, -(-q.count() // QUERY_BLOCK))
    return q.repartition(tasks, "id").mapInArrow(search, "qid long, gid long, sim double, rank int")


def nearest_rows(queries: DataFrame, gallery: DataFrame, distance, k: int) -> DataFrame:
    """qid, gid, dist, rank: the k gallery rows (id, v) nearest to each query row by (distance, id), never that of its own id.

    distance: from a query's v and a matrix of v to an array. Each pair of blocks keeps k rows a query before the merge.
    With line_distance queries go through sorted blocks of the gallery one after another, and rows near a query alone are looked at.
    """
    pick = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    if distance is line_distance:
        return _nearest_on_line(pick(queries), pick(gallery), k)
    q, g = _blocks(pick(queries), pick(gallery))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            gid, y = right["id"].to_numpy(), _matrix(right["v"])
            for qid, x in zip(left["id"].to_pylist(), _matrix(left["v"]), strict=True):
                others = np.flatnonzero(gid != qid)
                d = distance(x, y[others])
                best = np.lexsort((gid[others], d))[:k]
                for column, values in zip(found, (np.full(len(best), qid), gid[others][best], d[best]), strict=True):
                    column.append(values)
        return pa.table(dict(zip(("qid", "gid", "dist"), map(np.concatenate, found), strict=True)))

    kept = q.groupBy("qb", "gb").cogroup(g.groupBy("qb", "gb")).applyInArrow(search, "qid long, gid long, dist double")
    best = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "gid"))
    return kept.withColumn("rank", best).where(F.col("rank") <= k)


def line_value(v: str):
    """The one component of a vector, NaN if there is none."""
    return F.coalesce(F.get(F.col(v), F.lit(0)), F.lit(float("nan")))


def _nearest_on_line(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    blocks = Blocks(gallery.select("id", line_value("v").alias("y")), "id", LINE_BLOCK, ["y", "id"])

    def search(batches):
        for t in gathered(batches, LINE_QUERIES):
            qid, x = numbers(t["id"]), numbers(t["x"])
            top = None
            for block in blocks:
                near = Line(numbers(block["y"]), numbers(block["id"])).nearest(qid, x, k)
                top = best(k, *(near if top is None else map(np.hstack, zip(top, near, strict=True))))
            if top is not None:
                found, far, ids = top
                rank = np.broadcast_to(np.arange(1, found.shape[1] + 1, dtype=np.int32), found.shape)
                columns = np.broadcast_to(qid[:, None], found.shape)[found], ids[found], far[found], rank[found]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["qid", "gid", "dist", "rank"])

    tasks = max(1, -(-queries.count() // LINE_QUERIES))
    return queries.select("id", line_value("v").alias("x")).repartition(tasks, "id").mapInArrow(search, "qid long, gid long, dist double, rank int")


def column_normalized(dist: DataFrame) -> DataFrame:
    """Distances (a_id, b_id, dist) over the largest of their b_id."""
    most = dist.groupBy("b_id").agg(F.max("dist").alias("most"))
    return dist.join(most, "b_id").select("a_id", "b_id", (F.col("dist") / (F.col("most") + 1e-10)).alias("dist"))


def distance_matrix(a: DataFrame, b: DataFrame, metric: str = "sqeuclid", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """a_id, b_id, dist of all rows of a stated query set a against all of b, in blocks: sqeuclid, angle (of cosines) or chord (sqrt(2 - 2 cos) / 2)."""
    if metric not in ("sqeuclid", "angle", "chord"):
        raise ValueError(f"unknown metric {metric!r}")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    q, g = _blocks(pick(a), pick(b))

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a_id": pa.array([], pa.int64()), "b_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        x, y = _matrix(left["v"]), _matrix(right["v"])
        if metric == "sqeuclid":
            d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)
        else:
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            cos = np.clip(unit(x) @ unit(y).T, -1, 1)
            d = np.arccos(cos) if metric == "angle" else np.sqrt(np.maximum(2 - 2 * cos, 0)) / 2
        ids = np.asarray(left["id"].combine_chunks()), np.asarray(right["id"].combine_chunks())
        return pa.table({"a_id": np.repeat(ids[0], len(y)), "b_id": np.tile(ids[1], len(x)), "dist": d.ravel()})

    return q.groupBy("qb", "gb").cogroup(g.groupBy("qb", "gb")).applyInArrow(fill, "a_id long, b_id long, dist double")


def feature_mean_cov(df: DataFrame, vec: str, mask: str | None = None) -> DataFrame:
    """n, mean, cov (d x d, row by row, over n - 1; zeros for one row): one Gram matrix for each partition, then sums; d is the vectors' own length. No rows give no row."""
    rows = df.where(F.col(mask)) if mask else df

    def gram(batches):
        n, s, g = 0, None, None
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(0)]))
            if not len(x):
                continue
            s, g = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), g + x.T @ x)
            n += len(x)
        if n:
            for i in range(len(s)):
                yield pa.RecordBatch.from_pydict({"i": [i], "n": [n], "s": [float(s[i])], "g": [g[i].tolist()]}, schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("g", pa.list_(pa.float64()))]))

    parts = rows.select(F.col(vec).cast("array<double>")).mapInArrow(gram, "i int, n long, s double, g array<double>")
    cells = parts.select("i", "n", "s", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("x").alias("x"))
    means = F.array_sort(F.collect_set(F.when(F.col("j") == 0, F.struct("i", (F.col("s") / F.col("n")).alias("m")))))
    out = cells.groupBy("n").agg(means.alias("ms"), F.array_sort(F.collect_list(F.struct("i", "j", "x"))).alias("xs"))  # d x d cells
    mean = F.transform("ms", lambda m: m["m"])
    out = out.withColumn("mean", mean)
    return out.select("n", "mean", F.transform("xs", lambda c: (c["x"] - F.col("n") * F.get(F.col("mean"), c["i"]) * F.get(F.col("mean"), c["j"])) / F.greatest(F.col("n") - 1, F.lit(1))).alias("cov"))


def hadamard(d: int) -> np.ndarray:
    """An orthogonal d x d matrix: the Sylvester one for powers of two, else the cosine transform's."""
    if d & (d - 1) == 0:
        h = np.ones((1, 1))
        while len(h) < d:
            h = np.block([[h, h], [h, -h]])
        return h / np.sqrt(d)
    k = np.arange(d)
    c = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * d)) * np.sqrt(2 / d)
    c[0] /= np.sqrt(2)
    return c


def whiten_fit_apply(df: DataFrame, vec: str, rotate: bool = True) -> DataFrame:
    """df with whitened: (x - mean) W', where W scales by 1 / sqrt of the mean eigenvalue and, with rotate, turns the eigenvectors onto an orthogonal matrix that spreads variance evenly. Only the d x d covariance reaches the driver."""
    stats = feature_mean_cov(df, vec).first()
    mean = np.array(stats["mean"])
    values, vectors = np.linalg.eigh(np.array(stats["cov"]).reshape(len(mean), len(mean)))
    scale = 1 / np.sqrt(max(values.clip(0).mean(), 1e-12))
    w = scale * (hadamard(len(mean)) @ vectors.T if rotate else np.eye(len(mean)))
    sent = df.sparkSession.sparkContext.broadcast((mean, w))

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        m, t = sent.value
        return pd.Series(list((np.stack(x.to_numpy()) - m) @ t.T)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn("whitened", apply(F.col(vec).cast("array<double>")))


def tangent_map(df: DataFrame, vec: str) -> DataFrame:
    """df with tangent: the logarithm of each unit vector at the mean direction, less the mean of these logarithms."""
    v = F.col(vec).cast("array<double>")
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    unit = df.withColumn("__u", F.transform(v, lambda x: x / norm(v)))
    sums = unit.select(F.posexplode("__u").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).orderBy("d").collect()  # one number for each dimension
    pole = np.array([r["m"] for r in sums])
    sent = df.sparkSession.sparkContext.broadcast(pole / max(np.linalg.norm(pole), 1e-12))

    @F.pandas_udf("array<double>")
    def log(u: pd.Series) -> pd.Series:
        if not len(u):
            return pd.Series([], dtype=object)
        x, p = np.stack(u.to_numpy()), sent.value
        cos = np.clip(x @ p, -1, 1)[:, None]
        side = x - cos * p
        length = np.linalg.norm(side, axis=1, keepdims=True)
        return pd.Series(list(np.where(length > 1e-12, np.arccos(cos) * side / np.maximum(length, 1e-12), 0.0)))

    mapped = unit.withColumn("__t", log("__u"))
    mean = mapped.select(F.posexplode("__t").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("__m"))
    return mapped.crossJoin(F.broadcast(mean)).withColumn("tangent", F.zip_with("__t", "__m", lambda a, b: a - b)).drop("__u", "__t", "__m")  # mean is one row


#: Pairs of ids that a task holds at once, and vectors that it keeps from one batch of pairs to the next.
PAIRS, HELD = 1 << 16, 1 << 17


def _dots(pairs: DataFrame, vectors: Blocks) -> DataFrame:
    """pairs (qid, gid, ...) with dot, the product of their vectors, which tasks read from blocks; a pair without a vector goes.

    No vector is shuffled with a pair. A task keeps the table if it is small, else the vectors that a batch of pairs asks for.
    """

    def wanted(asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        ids, rows = [np.zeros(0, np.int64)], []
        for block in vectors:
            some = numbers(block["id"])
            at = np.arange(len(some)) if asked is None else np.flatnonzero(np.isin(some, asked))
            if len(at):
                ids.append(some[at])
                rows.append(_matrix(block["v"])[at])
        ids = np.concatenate(ids)
        by = np.argsort(ids, kind="stable")
        return ids[by], np.concatenate(rows)[by] if rows else np.zeros((0, 1))

    def products(batches):
        held = None
        for t in gathered(batches, PAIRS):
            sides = [numbers(t[c]) for c in ("qid", "gid")]
            if vectors.rows <= HELD:
                held = held or wanted(None)
            ids, values = held or wanted(np.unique(np.concatenate(sides)))
            if len(ids):
                places = [np.searchsorted(ids, side).clip(max=len(ids) - 1) for side in sides]
                there = np.all([ids[at] == side for side, at in zip(sides, places, strict=True)], axis=0)
                dot = np.concatenate([np.einsum("ij,ij->i", *(values[at[i : i + 8192]] for at in places)) for i in range(0, len(there), 8192)])
                yield from t.append_column("dot", pa.array(dot)).filter(pa.array(there)).to_batches()

    return pairs.mapInArrow(products, ", ".join([*(f"{c} {k}" for c, k in pairs.dtypes), "dot double"]))


def k_reciprocal_rerank(vectors: DataFrame, k1: int = 20, k2: int = 6, lam: float = 0.3, id_col: str = "vec_id", vec: str = "embedding", queries: str = "vec_id % 2 = 1") -> DataFrame:
    """qid, gid, dist: k-reciprocal re-ranking of the gallery rows that a query shares neighbours with; all others are at (1 - lam) + lam * distance.

    Neighbour lists come from the blocked top-k join; reciprocal sets, their expansion by neighbours whose own half-size sets
    overlap by two thirds, exp(-d) weights, query expansion over k2 and the Jaccard distance are joins of sparse rows.
    """
    near = materialize(knn_topk_join(vectors, vectors, k1 + 1, id_col, vec).withColumn("d", 2 - 2 * F.col("sim")), "rerank-near")
    rec = lambda k: near.where(F.col("rank") <= k + 1).select("qid", "gid", "d").join(near.where(F.col("rank") <= k + 1).select(F.col("qid").alias("gid"), F.col("gid").alias("qid")), ["qid", "gid"])
    full, half = rec(k1), rec(k1 // 2)
    sizes = half.groupBy(F.col("qid").alias("mid")).agg(F.count("*").alias("n"))
    via = full.select("qid", F.col("gid").alias("mid")).join(half.select(F.col("qid").alias("mid"), F.col("gid").alias("x")), "mid")
    inside = via.join(full.select("qid", F.col("gid").alias("x")), ["qid", "x"], "left_semi").groupBy("qid", "mid").agg(F.count("*").alias("both"))
    grown = inside.join(sizes, "mid").where(F.col("both") > 2 / 3 * F.col("n")).select("qid", "mid")
    wider = via.join(grown, ["qid", "mid"]).select("qid", F.col("x").alias("gid")).union(full.select("qid", "gid")).distinct()
    unit = Blocks(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")), "id", GALLERY_BLOCK, ["id"])
    weight = _dots(wider, unit).select("qid", "gid", F.exp(-(2 - 2 * F.col("dot"))).alias("w"))
    weight = weight.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("qid")))
    if k2 > 1:
        first = near.where(F.col("rank") <= k2).select("qid", F.col("gid").alias("nb"))
        weight = first.join(weight.select(F.col("qid").alias("nb"), "gid", "w"), "nb").groupBy("qid", "gid").agg((F.sum("w") / k2).alias("w"))
    weight = materialize(weight, "rerank-weights")
    left = weight.where(F.expr(queries.replace(id_col, "qid")))
    right = weight.where(~F.expr(queries.replace(id_col, "qid"))).select(F.col("qid").alias("g"), "gid", F.col("w").alias("w2"))
    shared = left.join(right, "gid").groupBy("qid", F.col("g").alias("gid")).agg(F.sum(F.least("w", "w2")).alias("m"))
    dist = _dots(shared, unit)
    mixed = (1 - F.col("m") / (2 - F.col("m"))) * (1 - lam) + (2 - 2 * F.col("dot")) * lam
    return dist.select("qid", "gid", F.greatest(F.least(mixed, F.lit(1.0)), F.lit(0.0)).alias("dist"))
