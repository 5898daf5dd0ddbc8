"""Partitioning, splitting, sampling and mixing of a corpus (seeded, and independent of how rows are partitioned)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.common import exp_key, global_index, seed_key, unit
from loomfield.functions.scan import numbered


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df in a reproducible permutation, with the key it is sorted by."""
    return df.withColumn("order_key", seed_key(F.col(key), seed)).orderBy("order_key", key)


def random_sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement; all, if there are fewer."""
    return df.withColumn("order_key", seed_key(F.col(key), seed)).orderBy("order_key", key).limit(n)


def assign_shards(df: DataFrame, size: int = 10_000, per_subdir: int = 1_000, idx: str = "idx") -> DataFrame:
    """df with shard_id, subdir and the nine-digit key of its index."""
    shard = F.floor(F.col(idx) / size).cast("long")
    return df.withColumn("shard_id", shard).withColumn("subdir", (F.floor(F.col("shard_id") / per_subdir) + 1).cast("long") * per_subdir).withColumn("key", F.lpad(F.col(idx).cast("string"), 9, "0"))


def train_val_split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """df with split: the first int(n * ratio) rows in seeded order are train, the rest val; a ratio of 0 or 1 makes all test."""
    if ratio in (0, 1):
        return df.withColumn("split", F.lit("test"))
    ordered = global_index(df.withColumn("order_key", seed_key(F.col(key), seed)), "order_key", key)
    n = df.count()
    return ordered.withColumn("split", F.when(F.col("idx") < int(n * ratio), "train").otherwise("val")).drop("idx", "order_key")


def stratified_sample(cases: DataFrame, key: str, cls: str, target: int, seed: int = 42, share: float = 0.8) -> DataFrame:
    """All of class 1; share of the rest of the target to class 2, what it leaves to class 3; if class 1 exceeds the target, a sample of it."""
    counts = cases.groupBy().agg(*(F.count(F.when(F.col(cls) == c, 1)).alias(f"n{c}") for c in (1, 2, 3)))
    one = F.least("n1", F.lit(target))
    rest = F.lit(target) - one
    two = F.least("n2", F.floor(rest * share))
    quotas = counts.select(one.alias("q1"), two.alias("q2"), F.least("n3", rest - two).alias("q3"))
    ranked = numbered(cases, [cls], [seed_key(F.col(key), seed), key], "pick").withColumn("pick", (F.col("pick") + 1).cast("int"))
    quota = F.when(F.col(cls) == 1, F.col("q1")).when(F.col(cls) == 2, F.col("q2")).when(F.col(cls) == 3, F.col("q3")).otherwise(0)
    return ranked.crossJoin(F.broadcast(quotas)).where(F.col("pick") <= quota).drop("q1", "q2", "q3")  # quotas is one row


def cap_majority(df: DataFrame, key: str, is_majority: Column, max_rows: int = 15_000, seed: int = 42) -> DataFrame:
    """With more than max_rows rows: max_rows seeded ones of the majority and all others; where the condition is null, a row is none of the majority."""
    is_majority = F.coalesce(is_majority, F.lit(False))
    if df.limit(max_rows + 1).count() <= max_rows:
        return df
    kept = df.where(is_majority).orderBy(seed_key(F.col(key), seed), key).limit(max_rows)
    return kept.unionByName(df.where(~is_majority))


def normalize_rates(listing: DataFrame) -> DataFrame:
    """path, rate: duplicate paths merged, rates that sum to 1; null, if they sum to 0."""
    merged = listing.groupBy("path").agg(F.sum("rate").alias("rate"))
    total = merged.agg(F.sum("rate").alias("total"))
    return merged.crossJoin(F.broadcast(total)).select("path", F.try_divide("rate", "total").alias("rate"))  # total is one row


def allocate_shards(shards: DataFrame, readers: DataFrame, workers: int, seed: int = 42) -> DataFrame:
    """source, shard, reader, worker: a source's shards in seeded order go to readers by their rates (reader, rate).

    Each reader gets the whole part of its share; what is left goes, one each, to the readers of the largest fractions. A
    reader's shards, sorted, are dealt to its workers in turn.
    """
    total = readers.agg(F.sum("rate").alias("total"))
    sized = shards.groupBy("source").agg(F.count("*").alias("n")).crossJoin(readers).crossJoin(F.broadcast(total))
    exact = F.col("n") * F.col("rate") / F.col("total")
    sized = sized.withColumn("whole", F.floor(exact)).withColumn("part", exact - F.floor(exact))
    by = Window.partitionBy("source")
    sized = sized.withColumn("left", F.col("n") - F.sum("whole").over(by)).withColumn("extra", F.row_number().over(by.orderBy(F.desc("part"), "reader")) <= F.col("left"))
    sized = sized.withColumn("take", F.col("whole") + F.col("extra").cast("int"))
    sized = sized.withColumn("stop", F.sum("take").over(by.orderBy("reader"))).withColumn("start", F.col("stop") - F.col("take"))
    ranked = shards.withColumn("at", F.row_number().over(by.orderBy(seed_key(F.concat_ws("/", "source", "shard"), seed), "shard")) - 1)
    ranges = sized.select("source", "reader", "start", "stop")
    dealt = ranked.join(ranges, (ranked["source"] == ranges["source"]) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))).select(ranked["source"], "shard", "reader")
    worker = F.pmod(F.row_number().over(Window.partitionBy("source", "reader").orderBy("shard")) - 1, F.lit(workers))
    return dealt.withColumn("worker", worker)


def least_visited_shards(shards: DataFrame, visits: DataFrame, epoch: int, seed: int = 42) -> DataFrame:
    """source, shard, pick: shards of a source by fewest visits, ties in an order seeded by the epoch."""
    seen = shards.join(visits, ["source", "shard"], "left").withColumn("visits", F.coalesce("visits", F.lit(0)))
    order = Window.partitionBy("source").orderBy("visits", seed_key(F.concat_ws("/", "source", "shard"), f"{seed}:{epoch}"), "shard")
    return seen.withColumn("pick", F.row_number().over(order))


def weighted_reservoir(df: DataFrame, key: str, weight: str, size: int, seed: int = 42) -> DataFrame:
    """The size rows of smallest Exp(1) / weight, and the order in which they are emitted."""
    return df.where(F.col(weight) > 0).withColumn("res_key", exp_key(F.col(key), F.col(weight), seed)).orderBy("res_key", key).limit(size)


def mixture_schedule(rates: DataFrame, n: int) -> DataFrame:
    """pos, source, ordinal: n picks with each source's picks spread evenly by its rate.

    The j-th pick of a source of rate r is due at (j + 1/2) / r; picks in order of their due times keep every short window in
    proportion, as a scheduler of deficits does, but each pick is known by itself and needs no state.
    """
    total = rates.agg(F.sum("rate").alias("total"))
    share = rates.where("rate > 0").crossJoin(F.broadcast(total)).select("source", (F.col("rate") / F.col("total")).alias("share"))
    due = share.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.ceil(F.col("share") * n).cast("int")))).withColumn("due", (F.col("ordinal") + 0.5) / F.col("share"))
    ordered = global_index(due, "due", "source", name="pos")
    return ordered.where(F.col("pos") < n).select("pos", "source", "ordinal")


def mix_sources(df: DataFrame, rates: DataFrame, n: int, key: str, weight: str, seed: int = 42) -> DataFrame:
    """pos, source and key of n rows: each source in the order of its weighted keys, interleaved by the schedule."""
    usable = df.where(F.col(weight) > 0).select("source", key, exp_key(F.col(key), F.col(weight), seed).alias("__k"))
    queued = numbered(usable, ["source"], ["__k", key], "ordinal")
    return mixture_schedule(rates, n).join(queued, ["source", "ordinal"]).select("pos", "source", key)


def class_weights(df: DataFrame, passed: Column, ratio: float) -> DataFrame:
    """df with weight 1 for passed rows and (passed / failed) * ratio for the others."""
    counts = df.agg(F.count(F.when(passed, 1)).alias("p"), F.count(F.when(~passed, 1)).alias("f"))
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", F.when(passed, 1.0).otherwise(F.col("p") / F.col("f") * ratio)).drop("p", "f")  # counts is one row


def source_weights(df: DataFrame, source: str = "source") -> DataFrame:
    """df with weight (N - n_source) / N."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    weights = counts.crossJoin(F.broadcast(total)).select(source, ((F.col("all") - F.col("n")) / F.col("all")).alias("weight"))
    return df.join(weights, source)


def class_balanced_resample(df: DataFrame, key: str, classes: str, seed: int = 42) -> DataFrame:
    """class, draw, key: for each of C classes int(n_class * (1 / C) / share) draws with replacement among its rows."""
    rows = df.select(key, F.explode(F.array_distinct(classes)).alias("class"))
    counts = rows.groupBy("class").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("c"))
    draws = counts.crossJoin(F.broadcast(total)).select("class", "n", F.floor(F.col("n") * (1 / F.col("c")) / (F.col("n") / F.col("all"))).cast("int").alias("m")).where("m > 0")
    draws = draws.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("at", F.floor(unit(F.concat_ws("/", "class", "draw"), seed) * F.col("n")).cast("int"))
    placed = numbered(rows, ["class"], [seed_key(F.concat_ws("/", "class", key), seed), key])
    return draws.join(placed, ["class", "at"]).select("class", "draw", key)


def identity_batches(df: DataFrame, key: str, identity: str, p: int, k: int, seed: int = 42) -> DataFrame:
    """batch, slot, key: chunks of k rows of an identity (identities of fewer rows repeat theirs), p chunks a batch."""
    order = Window.partitionBy(identity).orderBy(seed_key(F.col(key), seed), key)
    ranked = df.select(key, identity).withColumn("at", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(identity)))
    padded = ranked.withColumn("slot_at", F.explode(F.when(F.col("n") >= k, F.array("at")).otherwise(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: s % F.col("n") == F.col("at")))))
    whole = padded.where((F.col("n") < k) | (F.col("slot_at") < F.floor(F.col("n") / k) * k))
    chunked = whole.withColumn("chunk", F.floor(F.col("slot_at") / k)).withColumn("within", F.col("slot_at") % k)
    chunks = global_index(chunked.select(identity, "chunk").distinct().withColumn("o", seed_key(F.concat_ws("/", identity, "chunk"), seed)), "o", identity, "chunk", name="chunk_at")
    return chunked.join(chunks.drop("o"), [identity, "chunk"]).select(F.floor(F.col("chunk_at") / p).alias("batch"), (F.col("chunk_at") % p * k + F.col("within")).alias("slot"), key)


def group_sample(df: DataFrame, key: str, cls: str, n: int, calls: int, seed: int = 42) -> DataFrame:
    """call, class, slot, key: n rows of each class for each call, from a seeded permutation that is drawn anew when used up."""
    sizes = df.groupBy(cls).agg(F.count("*").alias("size"))
    if n * calls < 1:
        raise ValueError("n and calls must be 1 at least")
    asked = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n * calls - 1)))).withColumn("turn", F.floor(F.col("draw") / F.col("size"))).withColumn("at", F.col("draw") % F.col("size"))
    turns = asked.select(cls, "turn").distinct()
    ranked = numbered(df.select(key, cls).join(turns, cls), [cls, "turn"], [seed_key(F.concat_ws("/", "turn", key), seed), key])
    return asked.join(ranked, [cls, "turn", "at"]).select(F.floor(F.col("draw") / n).alias("call"), cls, (F.col("draw") % n).alias("slot"), key)


def pick_references(df: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """group, slot, key: n rows of each group, without replacement where it has enough, else repeating in turn."""
    w = Window.partitionBy(group)
    ranked = df.select(key, group).withColumn("at", F.row_number().over(w.orderBy(seed_key(F.col(key), seed), key)) - 1).withColumn("size", F.count("*").over(w)).where(F.col("at") < n)
    slots = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: s % F.col("size") == F.col("at"))
    return ranked.select(group, F.explode(slots).alias("slot"), key)


def fixed_batches(df: DataFrame, size: int, drop_last: bool = True, pos: str = "idx") -> DataFrame:
    """df with batch_id by position; training drops the partial batch."""
    out = df.withColumn("batch_id", F.floor(F.col(pos) / size).cast("long"))
    return out.where(F.col("batch_id") < df.count() // size) if drop_last else out


def even_shards_padded(df: DataFrame, key: str, fold: str, n: int, seed: int = 42) -> DataFrame:
    """fold, shard, slot, key: n equal shards for each fold, the last ones filled with seeded repeats of the fold."""
    sizes = df.groupBy(fold).agg(F.count("*").alias("size"))
    ranked = numbered(df.select(key, fold), [fold], [seed_key(F.col(key), seed), key]).join(sizes, fold)
    whole = F.ceil(F.col("size") / n) * n
    ranked = ranked.withColumn("at", F.explode(F.when(F.col("at") < whole - F.col("size"), F.array(F.col("at").cast("long"), F.col("at") + F.col("size"))).otherwise(F.array(F.col("at").cast("long")))))
    # with fewer rows than shards a fold's rows are repeated in turn
    per = F.ceil(F.col("size") / n)
    return ranked.select(fold, F.floor(F.col("at") / per).alias("shard"), (F.col("at") % per).alias("slot"), key)
