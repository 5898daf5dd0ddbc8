"""Packing, mixing, line dedup, near duplicates, toxicity, search and the pipeline against brute force, and their odd cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfield.llm import jaccard, linededup, mixing, packing, topk, toxicity
from loomfield.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def _pieces_are_whole(rows, want):
    """want: token ids of each document, as a list of (doc_id, ids)."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(i) for _, i in want)
    for s, parts in sequences.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 4096 or s == max(sequences)
    stock = Counter()
    for i, ids in want:
        stock[i, len(ids)] += 1
    for (i, n), parts in docs.items():
        ids = next(ids for j, ids in want if (j, len(ids)) == (i, n))
        assert sum(p["length"] for p in parts) == n * stock[i, n]
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())


def test_pack(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    docs = odd_docs.where("NOT (doc_id <=> 1)")  # of that id there are two texts
    want = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    _pieces_are_whole(packing.pack(docs, PATH).collect(), want)
    assert packing.pack(no_docs, PATH).count() == 0


def test_token_ids(monkeypatch):
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(PATH), random.Random(2)
    parts = ["a", "é", "'s", " ", "\n", "\x1c", "\x85", "\t", "\u3000", "<|startoftext|>", "1", "²", "漢字", "!", ".,", "<|endoftext|>", "Σ", "İ", "ÀÉß", "ÿµª", "e\u0301", "_-_", "ŁÓ", "😀", "ñ", "World", "don't."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 40)
    for at in range(0, 500, 50):
        ids, ends = packing.token_ids(pa.array(texts[at : at + 50], pa.string()), PATH, 2)
        got = np.split(ids, ends[:-1])
        assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts[at : at + 50]]


def test_hilbert_keys_walk_to_neighbours():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = grid[np.argsort(packing.hilbert_keys(grid, bits=3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_mix_rates(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, "big" if i < 3000 else "small", "t") for i in range(3300)], "doc_id long, source string, text string")
    got = {r[0]: r[1] for r in mixing.mix(docs, targets={"big": 0.5, "small": 0.5}).groupBy("source").count().collect()}
    assert abs(got["big"] - 1650) < 200 and abs(got["small"] - 1650) < 200
    again = mixing.mix(docs.repartition(7), targets={"big": 0.5, "small": 0.5})
    assert {r[0]: r[1] for r in again.groupBy("source").count().collect()} == got
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(odd_docs).columns == [*odd_docs.columns, "copy_no", "source_rate"]
    many = mixing.mix(docs.where("doc_id < 5"), total=200.0).groupBy("doc_id").count()
    assert all(100 < r[1] < 320 for r in many.collect())


def test_line_dedup(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, f"own {i}\n same line \n\nlast {i}", "h" if i < 20 else None, 5) for i in range(40)] + [(99, "same line", "lone", 9)], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(docs, ratio=0.5).collect()}
    assert got[0]["text"] == "own 0\n\nlast 0" and got[0]["n_chars"] == len("own 0\n\nlast 0") and got[30]["text"] == "own 30\n\nlast 30"
    assert got[99]["text"] == "same line" and got[99]["n_chars"] == 9
    assert linededup.drop_boilerplate(odd_docs).columns == odd_docs.columns
    assert linededup.drop_boilerplate(odd_docs).count() == odd_docs.count() and linededup.drop_boilerplate(no_docs).count() == 0


def _components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, no_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(words)
        return w

    rows = []
    for _ in range(25):
        w = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 150]))]
        rows += [edited(w, rng.randint(0, max(1, len(w) // 25))) for _ in range(rng.choice([1, 2, 4]))]
    base, shared = [rng.choice(words) for _ in range(120)], [rng.choice(words) for _ in range(55)]
    rows += [edited(base, rng.randint(1, 4)) for _ in range(60)]
    rows += [shared + [rng.choice(words) for _ in range(rng.randint(5, 90))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs).collect()} == _components(rows)
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_near_duplicates_in_small_buffers(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(80)] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("BUCKET_SIGNATURES", "BUFFER_SIGNATURES"):
        monkeypatch.setattr(jaccard, name, 150)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 3)
    assert {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs).collect()} == _components(rows)


def test_equal_ids_of_different_sets_are_drawn_anew(spark, monkeypatch):
    whole = jaccard.set_ids

    def clash(keys, sizes, seed=0):
        ids, check = whole(keys, sizes, seed)
        return (ids & 3 if seed == 0 else ids), check

    monkeypatch.setattr(jaccard, "set_ids", clash)
    rows = [(i, f"a{i // 2} b c d e f g{i // 2}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs).collect()} == _components(rows)


def _rows_joined(df):
    """The rows that the joins of df make, by what Spark counts when it runs."""
    df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        made = plan.metrics().get("numOutputRows")
        own = made.get().value() if "Join" in kind and made.isDefined() else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_open_pairs_are_taken_once(spark, monkeypatch):
    """Near misses share many signatures; that makes no more rows of a pair, and no pair is lost."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(5):  # two of them have at most one such place in common, and share 0.78 to 0.796 of their shingles
            words[65 * j + 5 * ((i // 13 * j + i) % 13) + 2] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    whole, found = jaccard._open_pairs, []

    def watched(*parts):
        pairs = whole(*parts)
        found.append((_rows_joined(pairs), {tuple(r) for r in pairs.collect()}))
        return pairs

    monkeypatch.setattr(jaccard, "_open_pairs", watched)
    want, pairs = _components(rows), None
    for leading in (16, 0):
        monkeypatch.setattr(jaccard, "LEADING", leading)
        assert {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs).collect()} == want
        made, now = found.pop()
        assert pairs in (None, now)
        pairs = now
        assert len(pairs) > 500 and (leading < 16 or made <= 2 * len(pairs))


def test_training_gives_memory_back(spark, monkeypatch):
    """What training took doesn't stay with the driver's process for the stages after it."""
    done, whole = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows: (whole(rows), done.append("trained"))[0])
    monkeypatch.setattr(toxicity, "give_back", lambda: done.append("given back"), raising=False)
    docs = spark.createDataFrame([(i, "nice words" if i % 2 else "bad words") for i in range(20)], "doc_id long, text string")
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert done == ["trained", "given back"]


def test_near_duplicates_of_odd_rows(odd_docs):
    found = jaccard.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    of = {r["doc_id"]: r["component_id"] for r in found}
    assert of[6] == of[5] == 5 and of[2] == 2 and of[3] == 3 and of[4] == 4
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id IS NULL").count() == 1


def test_shingle_sets_follow_the_words():
    texts = ["", " ", "One two  three\tfour five six", "one TWO three four five six", "one two", "ONE\ntwo", "two one", "éa b c d e", "Éa b c d e", "x" * 9000 + " b c d e f g", "a b c d e f g a b c d e f g", "漢字", "a\x1cb c d e f"]
    data = [t.encode() for t in texts]
    keys, sizes = jaccard.shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    each = [frozenset(x.tolist()) for x in np.split(keys, np.cumsum(sizes)[:-1])]
    brute = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        brute.append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4))))
    assert sizes.tolist() == [len(b) for b in brute]
    for i, a in enumerate(brute):
        for j, b in enumerate(brute):
            assert len(each[i] & each[j]) == len(a & b)


@pytest.mark.parametrize("size", [1, 4, 5, 6, 9, 31, 200, 3000])
def test_signatures_of_similar_sets_meet(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        out, more = (int(rng.integers(0, len(a) // d + 1)) for d in (9, 4))
        b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 64, more, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or len(a) < 5:
            continue
        sizes = np.array([len(a), len(b)])
        sigs, owner = jaccard.signatures(np.concatenate([a, b]), sizes)
        assert len(np.intersect1d(sigs[owner == 0], sigs[owner == 1]))
        raw, folds = jaccard.sketches(np.concatenate([a, b]), sizes)
        p, q = (np.frombuffer(r, np.uint64).reshape(-1, min(map(len, raw)) // 8) for r in raw)
        for x in (np.bitwise_xor.reduce(p) ^ np.bitwise_xor.reduce(q), folds[0] ^ folds[1]):
            assert int(np.bitwise_count(x.view(np.uint64)).sum()) * 180 <= 20 * (len(a) + len(b))


def test_toxicity_learns_misspellings(spark, odd_docs, no_docs):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = i % 3 == 0
        for k in range(0, len(w), 12) if bad else ():
            w[k] = rng.choice(["scoundrel", "villainous", "wretched"])
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out()).where("held").collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) > 0.95 * len(scored)
    odd = " ".join([*words[:20], "scoundrrel", "vilainous", "wretchedd"])
    assert toxicity._score([odd], model)[0] > toxicity._score([" ".join(words[:23])], model)[0] + 1
    assert toxicity.score_toxicity(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score_toxicity(odd_docs, model).columns == [*(c for c in odd_docs.columns if c != "score"), "score", "predicted"]
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    assert toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", F.lit(None).cast("int").alias("toxic"))).bias < 0


def test_toxicity_scores_by_hand(spark):
    rng = np.random.default_rng(7)
    model = toxicity.Model("by-hand", rng.normal(size=toxicity.BUCKETS), -0.3)

    def bucket(gram):
        h = len(gram)
        for b in gram:
            h = (h * 16777619 & 0xFFFFFFFF) ^ (b + 1)
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        return (h ^ h >> 12) % toxicity.BUCKETS

    def brute(text):
        total, words = 0.0, re.findall(r"\w+", (text or "").lower())
        for w in words:
            raw = f"<{w}>".encode()
            found = [model.bucket_score[bucket(raw[i : i + n])] for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
            total += sum(found) / len(found)
        return 1 / (1 + np.exp(-(model.bias + total / (len(words) + toxicity.SMOOTH))))

    texts = ["a", "One two, THREE four!", "été 漢字 x", "", None, "same same same other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(abs(got[i] - brute(t)) < 1e-9 for i, t in enumerate(texts))


def test_toxicity_training_takes_a_bounded_number_of_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} some text", i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda rows: taken.append([(b.nbytes + w.nbytes, y) for b, w, y in rows]))
    for most in (10**9, 2000):
        toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), most_bytes=most)
    assert len(taken[0]) > 40 and 0 < len(taken[1]) < len(taken[0])
    assert all(sum(n for n, y in taken[1] if y == k) <= 1000 for k in (0, 1))


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (None, [1.0]), (403, []), (404, [0.0, 0.5])]
    rows += [(i, rows[7][1]) for i in (500, 501, 502)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = defaultdict(list)
    for r in topk.exact_topk(df.where("vec_id % 100 = 0"), df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: int((a[: min(len(a), len(b))] * b[: min(len(a), len(b))]).sum())
    for q in (i for i in usable if i % 100 == 0):
        want = sorted(((i, dot(usable[q], v)) for i, v in usable.items() if i != q), key=lambda x: (-x[1], x[0]))[:10]
        assert got[q] == want
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mix_sources", "pack"]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    assert 0.7 * before < docs.count() < before
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_stages_of_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("__key", "__n", "__text", "__lines", "__host", "__gone", "_____rate", "row", "place", "ids", "copy_no_")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0
        found = stage(spark, clash, sf)
        if name != "pack":
            assert found.columns == clash.columns
        if name == "line_dedup":
            assert found.count() == odd_docs.count()
        assert name == "mix_sources" or found.where("doc_id IS NULL").count() > 0 and found.where("doc_id IN (2, 3, 4)").count() >= 2


def test_line_dedup_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"own {i}\nsame", "h" if i % 3 else None) for i in range(40)], "doc_id long, text string, source string")
    want = sorted(map(tuple, linededup.drop_boilerplate(docs).collect()), key=str)
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 1)
    assert sorted(map(tuple, linededup.drop_boilerplate(docs).collect()), key=str) == want and "same" not in want[0][1]


def test_pipeline_keeps_a_large_group_of_copies_once(spark):
    import corpus_pipeline

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(6)) for _ in range(800)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    exact, near = [line(30) for _ in range(3)], [line(30) for _ in range(5)]
    rows = [(i, "\n".join(["home about contact", line(30), line(30)]), "h") for i in range(150)]
    rows += [(200 + i, "\n".join(exact), "h") for i in range(20)]
    rows += [(300 + i, "\n".join([*near, line(3)]), "h") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bare = corpus_pipeline.drop_boilerplate_lines(spark, docs, "")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_near_copies(spark, bare, "").collect()}
    before = {i: t for i, t, _ in rows}
    assert sorted(kept) == [*range(150), 200, 300]
    assert kept[200] == before[200] and kept[300] == before[300]
    assert all(kept[i] == before[i].removeprefix("home about contact\n") for i in range(150))


@pytest.mark.parametrize("size", [3, 5, 6, 7, 9, 10, 13, 17, 20, 26, 33, 40, 50, 60])
def test_unrelated_short_sets_share_few_signatures(size):
    counts = {}
    for n in (2000, 8000):
        rng = np.random.default_rng(size)
        keys = np.sort(rng.integers(0, 1 << 64, (n, size), dtype=np.uint64), axis=1).ravel()
        sigs, _ = jaccard.signatures(keys, np.full(n, size))
        _, each = np.unique(sigs, return_counts=True)
        counts[n] = int((each * (each - 1) // 2).sum())
        assert each.max() <= 100
    assert counts[8000] <= 2 * 8000


def test_similar_short_sets_share_a_signature():
    rng, seen = np.random.default_rng(0), 0
    while seen < 1500:
        size = int(rng.integers(2, 70))
        a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        gone = int(rng.integers(0, size // 4 + 2))
        b = np.unique(np.concatenate([a[: size - gone], rng.integers(0, 1 << 64, int(rng.integers(0, gone + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        either = len(a) + len(b) - both
        if both == either or 100 * both < 80 * either:
            continue
        seen += 1
        sigs, owner = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert len(np.intersect1d(sigs[owner == 0], sigs[owner == 1]))
