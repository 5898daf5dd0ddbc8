"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks; every pair of a query block and a candidate block is one group. In a
group the candidates become postings (dimension -> rows and weights), each sparse query row scatters its weighted
postings into a dense array of scores, and a partition selection keeps k rows for the query. The merge takes the best k
of what the blocks kept. A query meets every candidate exactly once, and no group holds more than one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates and in a block of queries, on average.
CANDIDATE_BLOCK, QUERY_BLOCK = 2048, 2048


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v: floor(scale * x) of each component; rows without an id, a vector or with a null or non-finite component go."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and weight of every component that isn't 0, by row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    dim = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    some = values != 0
    return row[some], dim[some], values[some]


def best_of_block(query_ids, queries, ids, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of each query's k best rows of one block of candidates, and more on no account."""
    order = np.argsort(ids, kind="stable")  # a tie goes to the smaller id, so positions must follow the ids
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sorted_ids = ids[order]
    row, dim, weight = vectors
    row = place[row]
    by = np.lexsort((row, dim))
    row, dim, weight = row[by], dim[by], weight[by]
    width = int(dim[-1]) + 1 if len(dim) else 0
    starts = np.searchsorted(dim, np.arange(width + 1))
    whole = [starts[d + 1] - starts[d] == len(ids) for d in range(width)]
    q_row, q_dim, q_weight = queries
    q_at = np.searchsorted(q_row, np.arange(len(query_ids) + 1))
    out_q, out_v, out_s = [], [], []
    for q, query_id in enumerate(query_ids.tolist()):
        scores = np.zeros(len(ids), np.int64)
        for d, w in zip(q_dim[q_at[q] : q_at[q + 1]].tolist(), q_weight[q_at[q] : q_at[q + 1]].tolist(), strict=True):
            if d >= width:
                continue
            a, b = starts[d], starts[d + 1]
            if whole[d]:
                scores += w * weight[a:b]
            else:  # a row stands at most once in the postings of a dimension
                scores[row[a:b]] += w * weight[a:b]
        others = np.flatnonzero(sorted_ids != query_id)
        mine = scores[others]
        if len(mine) > k:
            least = np.partition(mine, len(mine) - k)[len(mine) - k]
            above, equal = np.flatnonzero(mine > least), np.flatnonzero(mine == least)
            pick = np.concatenate([above, equal[: k - len(above)]])
        else:
            pick = np.arange(len(mine))
        out_q.append(np.full(len(pick), query_id, np.int64))
        out_v.append(sorted_ids[others[pick]])
        out_s.append(mine[pick])
    if not out_q:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest integer inner product of each query row.

    Components become floor(scale * x). Ties go to the smaller vec_id; fewer candidates than k give fewer rows. All
    rows that carry a query's own id are its own and no candidates of it; repeated candidate rows each count. Rows with
    a null id, a null vector or a null or non-finite component take no part. Vectors may differ in length: a
    missing component is 0. Sums are exact while they stay below 2**63. Empty tables give no rows. Other columns are ignored.
    """
    q, c = integer_vectors(queries, id_col, vector_col, scale), integer_vectors(candidates, id_col, vector_col, scale)
    n_q, n_c = q.count(), c.count()
    q_blocks, c_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CANDIDATE_BLOCK))
    deal = lambda col, n: F.pmod(F.xxhash64(col, F.lit(n)), F.lit(n)).cast("int")
    q = q.distinct().select(deal("id", q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), "id", "v")
    # dealt by content, so that a task run again deals alike; of equal rows no more than k can be among the best
    c = c.groupBy("id", "v").agg(F.count("*").alias("n"))
    c = c.select("id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("copy"))
    c = c.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("id", "v", "copy"), F.lit(c_blocks)).cast("int").alias("cb"), "id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            out = (np.zeros(0, np.int64),) * 3
        else:
            out = best_of_block(np.asarray(left["id"].combine_chunks()), _flat(left["v"]), np.asarray(right["id"].combine_chunks()), _flat(right["v"]), k)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    kept = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
