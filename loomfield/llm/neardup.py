"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of a cosine of c or more have a squared distance of at most 2 (1 - c). Vectors are rotated at random, so that
distance spreads evenly, and split into blocks of WIDTH components; in at least one block a pair keeps within the block's
proportional share of the squared distance. So each block is joined by range: vectors fall into cells of the block's first
component, which are two radii wide, and visit the next cell if they are within a radius of it. In a cell, rows are sorted
by that component, each meets the rows within a radius of it, and pairs over the block's budget go. Candidates are verified
by their cosine in double precision on the vectors as they came.

A pair is verified in the first block where it keeps the budget, and nowhere else: rotated components are rounded to
integers once, block distances are exact in integers, and budgets have room for the rounding. Nothing is sent for a pair:
a task sends for each vector how many others it links with, and the links that join its vectors into components.

Equal vectors of a label are one class with a number of copies, so a large group of copies costs one row. A cell of many
classes is cut into tiles by hash, and each pair of tiles is a task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.common import Tables
from loomfield.llm.base import fits_broadcast, given_back, materialize, slices
from loomfield.llm.jaccard import components

#: Components of a block, at most, and rows of a tile, at least and at most.
WIDTH, TILE_ROWS = 16, (512, 8192)
#: Rotated components are whole numbers of this part of one.
UNIT = 1 << 20
#: Pairs of a step, of which block distances are held at once; classes with copies or links that are broadcast at most.
STEP_PAIRS, BROADCAST_CLASSES = 1 << 21, 100_000


@lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def block_edges(dims: int, width: int = WIDTH) -> list[int]:
    """Where the blocks of a vector begin, and its end."""
    n = -(-dims // width)
    return [dims * b // n for b in range(n + 1)]


def budgets(dims: int, least: float, width: int = WIDTH) -> list[int]:
    """The squared distance of each block, in UNIT, that a pair of the least cosine keeps in one block at least."""
    whole = 2 * (1 - least) + 1e-9
    return [int((UNIT * (whole * m / dims) ** 0.5 + m**0.5 + 2) ** 2) + 1 for m in np.diff(block_edges(dims, width)).tolist()]


def _usable(x: Column) -> Column:
    return F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of very large or small components are brought to a size whose square is finite first."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _places(classes: DataFrame, least: float, width: int) -> DataFrame:
    """A row for each class, block and cell: the class's own cells, and those that it visits."""

    def run(batches):
        for part in slices(batches, 2048):
            sizes = np.asarray(part.column(2).value_lengths())
            out = []
            for dims in np.unique(sizes).tolist():
                rows = part.filter(pa.array(sizes == dims))
                x = np.asarray(rows.column(2).flatten()).reshape(-1, dims)
                turned = np.rint(_unit(x) @ rotation(dims) * UNIT).astype(np.int32)
                edges = block_edges(dims, width)
                for b, budget in enumerate(budgets(dims, least, width)):
                    radius = int(budget**0.5) + 1
                    first = turned[:, edges[b]].astype(np.int64)
                    cell = (first + radius) // (2 * radius)  # the middle cell has 0 in its midst
                    visits = first - (cell * 2 * radius - radius) <= radius
                    for own, at, to in ((True, np.arange(len(x)), cell), (False, np.flatnonzero(visits), cell[visits] - 1)):
                        some = rows.take(pa.array(at))
                        ends = np.arange(len(at) + 1, dtype=np.int32) * dims
                        n = len(at)
                        constant = lambda v, kind: pa.array(np.full(n, v), kind)
                        out.append(pa.RecordBatch.from_arrays([
                            some.column(0), some.column(1), constant(dims, pa.int32()), constant(b, pa.int32()), pa.array(to), constant(own, pa.bool_()), some.column(3),
                            some.column(2), pa.ListArray.from_arrays(ends, pa.array(turned[at].ravel())),
                        ], ["class", "grp", "dims", "block", "cell", "own", "copies", "x", "turned"]))
            yield from out

    kind = "class long, grp long, dims int, block int, cell long, own boolean, copies long, x array<double>, turned array<int>"
    return classes.select("class", "grp", "x", "copies").mapInArrow(given_back(run), kind)


class _Forest:
    """Joins rows into components; keeps the links that joined two."""

    def __init__(self, n: int):
        self.of, self.links = np.arange(n), []

    def join(self, row: int, others: np.ndarray) -> None:
        roots = np.unique(self.of[np.append(others, row)])
        if len(roots) > 1:
            self.links += [(int(roots[0]), int(r)) for r in roots[1:]]
            self.of[np.isin(self.of, roots[1:])] = roots[0]


def links_of_tiles(ids, own, copies, x, turned, tile, block: int, least: float, width: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each row the copies of the other tile's rows (of its own, if there is one tile) that it links with here, and links that join components.

    Rows have one length. A pair of two visitors isn't taken, nor one that keeps the budget of a block before this.
    """
    dims = x.shape[1]
    edges, budget = block_edges(dims, width), budgets(dims, least, width)
    length = np.abs(x).max(1, keepdims=True)
    x = x / length  # keeps squares finite
    norm = np.sqrt((x * x).sum(1))
    here = turned[:, edges[block] : edges[block + 1]].astype(np.float64)  # whole numbers: products and sums are exact in doubles
    square, key = (here * here).sum(1), here[:, 0]
    radius = budget[block] ** 0.5 + 1
    counts, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
    low, high = (np.flatnonzero(tile == t) for t in (tile.min(), tile.max()))
    low, high = low[np.argsort(key[low], kind="stable")], high[np.argsort(key[high], kind="stable")]
    one = tile.min() == tile.max()
    step = max(1, STEP_PAIRS // max(1, len(high)))
    for a in range(0, len(low), step):
        rows = low[a : a + step]
        begin, end = np.searchsorted(key[high], [key[rows[0]] - radius, key[rows[-1]] + radius + 1])
        others = high[begin:end]
        near = square[rows][:, None] + square[others][None, :] - 2 * (here[rows] @ here[others].T) <= budget[block]
        near &= own[rows][:, None] | own[others][None, :]
        if one:
            near &= ids[rows][:, None] < ids[others][None, :]
        i, j = np.nonzero(near)
        for at in range(0, len(i), 1 << 16):
            p, q = rows[i[at : at + (1 << 16)]], others[j[at : at + (1 << 16)]]
            for b in range(block):
                apart = turned[p, edges[b] : edges[b + 1]].astype(np.int64) - turned[q, edges[b] : edges[b + 1]]
                fresh = (apart * apart).sum(1) > budget[b]
                p, q = p[fresh], q[fresh]
            alike = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= least
            p, q = p[alike], q[alike]
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            for row, part in zip(*_grouped(p, q), strict=True):
                forest.join(row, part)
    return counts, [(int(ids[a]), int(ids[b])) for a, b in forest.links]


def _grouped(p: np.ndarray, q: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(p, kind="stable")
    rows, begins = np.unique(p[order], return_index=True)
    return rows.tolist(), np.split(q[order], begins[1:]) if len(rows) else []


def _join(places: DataFrame, least: float, width: int, tables: Tables) -> DataFrame:
    """class, n (copies linked with), other (a link that joins components) of all pairs; n or other is null."""
    cell = ["grp", "dims", "block", "cell"]
    sizes = tables.write(places.groupBy(cell).agg(F.count("*").alias("rows")), "sizes")
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    rows = min(max(TILE_ROWS[0], total // (4 * parts)), TILE_ROWS[1])
    sizes = sizes.where("rows > 1").select(*cell, F.ceil(F.col("rows") / rows).cast("int").alias("tiles"))
    tiled = places.join(F.broadcast(sizes) if fits_broadcast(sizes, BROADCAST_CLASSES) else sizes, cell).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumns({"t0": F.least("tile", "with"), "t1": F.greatest("tile", "with")}).drop("with", "tiles")
    tiled = tiled.repartition(*cell, "t0", "t1")  # else a join by cell would hold all tiles of a cell in one task
    flat = lambda c: np.asarray(c.combine_chunks().flatten())

    def run(table: pa.Table) -> pa.Table:
        n, dims, block = table.num_rows, table["dims"][0].as_py(), table["block"][0].as_py()
        ids, own, copies, tile = (table[c].to_numpy() for c in ("class", "own", "copies", "tile"))
        counts, links = np.zeros(n, np.int64), []
        if table["t0"][0] == table["t1"][0] or tile.min() != tile.max():
            counts, links = links_of_tiles(ids, own, copies, flat(table["x"]).reshape(n, dims), flat(table["turned"]).reshape(n, dims), tile, block, least, width)
        some = np.flatnonzero(counts)
        a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
        out = pa.table({"class": ids[some], "n": counts[some], "other": pa.nulls(len(some), pa.int64())})
        return pa.concat_tables([out, pa.table({"class": a, "n": pa.nulls(len(a), pa.int64()), "other": b})])

    return tiled.groupBy(*cell, "t0", "t1").applyInArrow(run, "class long, n long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.93, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows linked with), component_id (the smallest id that links reach), kept.

    Two rows link when their labels are equal and not null, their vectors have one length and their cosine is least or
    more, least being over 0. Rows with a null label, or a vector that is null, empty, all zero or holds null or
    non-finite components link with nothing and are their own component. Repeated rows link with each other. A null id
    reaches others and takes their smallest id; alone, its component is null and it is kept. kept: whether the id is its
    component's; of rows that repeat that id all are. An empty table gives no rows. Other columns are ignored.
    The result reads two tables in the shared folder.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and 1 at most")
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    rows = rows.withColumn("label", F.when(_usable(F.col("x")), F.col("label")))
    with Tables(vectors.sparkSession, "neardup") as tables:
        classes = rows.where("label IS NOT NULL").groupBy("label", "x").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
        classes = tables.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
        labels = tables.write(classes.select("label").distinct().withColumn("grp", F.monotonically_increasing_id()), "labels")
        named = classes.join(F.broadcast(labels) if fits_broadcast(labels, BROADCAST_CLASSES) else labels, "label")
        places = tables.write(_places(named, least, width), "places")
        found = tables.write(_join(places, least, width, tables), "found")
        counts = found.where("n IS NOT NULL").groupBy("class").agg(F.sum("n").alias("n"))
        of = components(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")), tables)
        # a class of one row without links needs no line
        ends = of.join(classes.select("class", "least"), F.col("node") == F.col("class")).groupBy("component").agg(F.min("least").alias("end"))
        ends = of.join(ends, "component").select(F.col("node").alias("class"), "end")
        linked = classes.join(counts, "class", "left").where("copies > 1 OR n IS NOT NULL").join(ends, "class", "left")
        linked = linked.select("label", "x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("end", "least").alias("end"), F.lit(True).alias("linked"))
        linked = materialize(linked, "linked-classes")
    linked = F.broadcast(linked) if fits_broadcast(linked, BROADCAST_CLASSES) else linked
    whole = rows.join(linked, ["label", "x"], "left")
    whole = whole.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("linked"), F.col("end")).otherwise(F.col("id")).alias("component_id"))
    return whole.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
