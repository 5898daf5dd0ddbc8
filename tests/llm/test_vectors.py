"""Resampling, clustering and near-duplicate vectors against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions.common import Tables
from loomfield.llm import centroids, neardup, queries, radix, resample

VECTORS = "vec_id long, embedding array<float>, label int, x string, class long, cell long, v int, grp int, copies int"
SF = "/root/testdata/sf0.001"


def drawn(docs, target, percent, least_words, seed, buckets=10_000):
    """doc_id, n_features, weight, score, rank of each (doc_id, text), by the contract's words."""

    def words(text):
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)

    def found(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in found(text):
            s[b] += 1
    for text in target:
        for b in found(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        f = found(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)), None])
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return [(*r[:4], r[5]) for r in rows]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def test_resample_matches_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(1)
    words = ["Alpha", "beta", "été", "x" * 60, "y" * 300, "漢字", "b2", "_", "-", "c"]
    more = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(100, 400)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    target = spark.createDataFrame([("beta été c beta",), (None,), ("",)], "text string")
    for given, aim in ((docs, target), (docs, target.limit(0)), (no_docs, target)):
        want = drawn([(r.doc_id, r.text) for r in given.collect()], [r.text for r in aim.collect()], 25, 20, 7)
        got = [tuple(r) for r in resample.importance_resample(given, aim).collect()]
        # rows of one id and score rank in any order
        assert sorted(map(key, got)) == sorted(map(key, want))


def test_words_of_neighbouring_texts_stay_apart():
    texts = ["ab cd", "", "ef", "gh ij kl"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    one, two, words = resample.feature_buckets(data, np.cumsum([len(t) for t in texts]))
    assert words.tolist() == [2, 0, 1, 3]
    assert one.tolist() == [zlib.crc32(w) % 10_000 for w in (b"ab", b"cd", b"ef", b"gh", b"ij", b"kl")]
    assert two.tolist() == [zlib.crc32(w) % 10_000 for w in (b"ab cd", b"gh ij", b"ij kl")]


@pytest.mark.parametrize("low, high", [(-50, 50), (-(1 << 63), (1 << 63) - 1), (5, 5)])
def test_radix_sort_of_two_keys(spark, monkeypatch, low, high):
    monkeypatch.setattr(radix, "BLOCK_ROWS", 40)
    rng = random.Random(low)
    rows = [(rng.choice([None, rng.randint(low, high)]), rng.choice([None, rng.randint(-3, 3000)]), str(i)) for i in range(900)]
    with Tables(spark, "radix-test") as tables:
        placed, n = radix.radix_places(spark.createDataFrame(rows, "a long, b long, text string").repartition(5), [("a", False), ("b", True)], tables)
        got = sorted(placed.collect(), key=lambda r: r.place)
    assert n == 900 and [r.place for r in got] == list(range(900)) and len({r.text for r in got}) == 900
    order = lambda a, b: (a is None, -(a or 0), b is None, b or 0)
    assert [order(r.a, r.b) for r in got] == sorted(order(a, b) for a, b, _ in rows)
    with Tables(spark, "radix-test") as tables:
        assert radix.radix_places(spark.createDataFrame([], "a long, b long"), [("a", False)], tables)[0].count() == 0


def odd_vectors(spark, dims, seed=3):
    """Copies, near copies, scaled copies, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, dims))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + rng.standard_normal(dims) * 0.1 * (i % 6)).tolist(), i % 5 % 2) for i in range(120)]
    rows += [(300 + i, base[0].tolist(), 0) for i in range(30)] + [(400, (base[0] * 8).tolist(), 0), (401, (base[0] * -1).tolist(), 0), (402, (base[1] * 1e-30).tolist(), 1), (403, (base[1] * 1e30).tolist(), 1), (7, base[3].tolist(), 1), (7, base[3].tolist(), 1), (None, base[3].tolist(), 1), (None, rng.standard_normal(dims).tolist(), 0)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * dims, 0), (503, [None] + [1.0] * (dims - 1), 0), (504, [float("nan")] * dims, 0), (505, [float("inf")] * dims, 0), (506, base[0].tolist(), None), (507, base[0][:-1].tolist(), 0), (508, base[0][:-1].tolist(), 0)]
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], VECTORS)


def linked(rows, least):
    """vec_id, n_links, component_id, kept of rows (vec_id, embedding, label), every pair compared."""
    fine = [r for r in range(len(rows)) if rows[r][2] is not None and rows[r][1] and all(x is not None and math.isfinite(x) for x in rows[r][1]) and any(rows[r][1])]
    unit = {r: np.array(rows[r][1], float) / max(map(abs, rows[r][1])) for r in fine}
    unit = {r: v / np.sqrt(v @ v) for r, v in unit.items()}
    to = {r: [] for r in range(len(rows))}
    for r in fine:
        to[r] = [s for s in fine if s != r and rows[r][2] == rows[s][2] and len(unit[r]) == len(unit[s]) and unit[r] @ unit[s] >= least]
    out = []
    for r in range(len(rows)):
        seen, more = {r}, [r]
        while more:
            more = [s for m in more for s in to[m] if s not in seen and not seen.add(s)]
        end = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((rows[r][0], len(to[r]), end, rows[r][0] == end))
    return out


@pytest.mark.parametrize("dims, width, tile, least", [(64, 16, (512, 8192), 0.93), (64, 8, (8, 16), 0.93), (33, 16, (20, 30), 0.97), (5, 2, (8, 64), 0.6), (1, 1, (512, 8192), 1.0)])
def test_near_vectors_match_brute_force(spark, monkeypatch, dims, width, tile, least):
    monkeypatch.setattr(neardup, "TILE_ROWS", tile)
    monkeypatch.setattr(neardup, "STEP_PAIRS", 50)
    rows = odd_vectors(spark, dims)
    got = [tuple(r) for r in neardup.near_vectors(rows, least, width).collect()]
    want = linked([(r.vec_id, r.embedding, r.label) for r in rows.collect()], least - (1e-12 if dims == 1 else 0))
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(r[1] for r in got) > 900
    assert neardup.near_vectors(rows.limit(0)).count() == 0


def test_one_pair_in_each_block_and_at_the_budget(spark):
    """Pairs whose whole distance lies in one direction, just inside and just outside of the least cosine."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.93 + (1e-9 if i % 2 else -1e-9)
        rows += [(2 * i, a.tolist(), i), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), i)]
    got = neardup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93)
    assert {r.vec_id: r.n_links for r in got.collect()} == {i: i // 2 % 2 for i in range(120)}


def clustered(rows, k, rounds, dims, scale, seed):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of rows (vec_id, embedding), every distance computed in Python's integers."""
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), at) for at, c in enumerate(centre))
    for turn in range(rounds + 1):
        found = [near(v) for _, v in kept]
        if turn < rounds:
            for c in range(len(centre)):
                own = [v for (_, v), (_, at) in zip(kept, found) if at == c]
                if own:
                    centre[c] = [sum(x) // len(own) for x in zip(*own)]
    inertia = {c: sum(d for d, at in found if at == c) for c in range(len(centre))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, found)]


@pytest.mark.parametrize("dims, k, scale", [(64, 16, 64.0), (3, 5, 2.0), (2, 500, 1.0)])
def test_clusters_match_brute_force(spark, monkeypatch, dims, k, scale):
    monkeypatch.setattr(centroids, "STEP_ROWS", 37)
    rows = odd_vectors(spark, dims)
    got = [tuple(r) for r in centroids.cluster_vectors(rows, k=k, dims=dims, scale=scale).collect()]
    want = clustered([(r.vec_id, r.embedding) for r in rows.collect()], k, 3, dims, scale, 1)
    text = lambda r: tuple(map(str, r))
    assert sorted(map(text, got)) == sorted(map(text, want)) and len(got) > 190
    assert centroids.cluster_vectors(rows.limit(0)).count() == 0


def test_pivots_spare_exact_distances():
    rng = np.random.default_rng(2)
    middle = rng.integers(-2000, 2000, (16, 64))
    x = middle[rng.integers(0, 16, 3000)] + rng.integers(-9, 9, (3000, 64))
    fixed = centroids.far_apart(x[:100], 8)
    cluster, best, taken = centroids.nearest(x, centroids.distances(x, fixed), middle, centroids.distances(middle, fixed))
    d = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all() and taken < 3000 * 16 / 4


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    text = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert text(df.select(cols).collect()) == text(con.sql(queries.ORACLE_SQL[name]).select(*cols).fetchall())


def test_registered_resample_matches_brute_force(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.QUERIES["op11_importance_resample"](spark, SF)
    want = drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 25, 20, 7)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))
    assert got.agg(F.max("rank")).first()[0] == got.where("rank IS NOT NULL").count()
