"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mixture over its share of the corpus. Each document draws
its number of copies from the Poisson distribution of that mean, by inverting it at a number that a hash of the seed
and the document's id fixes; so the draw doesn't depend on partitions or on other documents. Documents are exploded by
their counts, and the copies are dealt by another hash of seed, id and copy and sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.base import fits_broadcast, own_prefix

#: Means above this are drawn as a sum of draws of at most this mean, since exp(-mean) must not vanish.
MOST_MEAN = 64.0
#: Sources that are broadcast with their rates at most; with more, the rates are joined by shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits, of an MD5 of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, source_col: str = "source", temperature: float = 0.5, total: float = 1.0, targets: dict[str, float] | None = None) -> DataFrame:
    """source, n, rate: the mean number of copies of a document of each source.

    The mixture has total times the rows of docs. Shares are those of targets (a source that isn't named gets 0), or in
    proportion to rows ** temperature. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        whole = float(sum(targets.values()))
        named = F.create_map(*(F.lit(x) for k, v in targets.items() for x in (k, v / whole)))
        weighted = counts.withColumn("w", F.coalesce(named[F.col("source")], F.lit(0.0)) if targets else F.lit(0.0))
    sums = weighted.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") * total / F.col("n")).otherwise(0.0)
    return weighted.crossJoin(F.broadcast(sums)).select("source", "n", F.round(rate, 9).alias("rate"))  # sums is one row


def poisson_table(rates: DataFrame) -> DataFrame:
    """rates with draws (how many) and cdf: the distribution function of mean rate / draws, up to where it is 1 in doubles."""
    mean = F.col("rate") / F.col("draws")
    upto = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("mean") / k).alias("p"), (acc["c"] + acc["p"] * F.col("mean") / k).alias("c"), F.array_append(acc["out"], acc["c"] + acc["p"] * F.col("mean") / k).alias("out")
    )
    p0 = F.exp(-F.col("mean"))
    first = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("out"))
    drawn = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN).cast("int"))).withColumn("mean", mean).withColumn("upto", upto)
    return drawn.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), "upto"), first, step, lambda acc: acc["out"])).drop("mean", "upto")


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", temperature: float = 0.5, total: float = 1.0, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with every row repeated as drawn, shuffled over all; the columns of docs, and copy_no (from 0) and source_rate (replaced if docs has them).

    Rows of the same id and source draw alike. A null id draws as an empty one, a null source is a source. An empty table gives no rows.
    """
    rest = docs.drop("copy_no", "source_rate")
    own = own_prefix(rest)
    rates = poisson_table(source_rates(rest, source_col, temperature, total, targets)).select(*(F.col(c).alias(own + c) for c in ("source", "rate", "draws", "cdf")))
    rates = F.broadcast(rates) if fits_broadcast(rest.select(source_col).distinct(), BROADCAST_SOURCES) else rates
    joined = rest.join(rates, F.col(source_col).eqNullSafe(F.col(own + "source")))
    draw = lambda j: F.size(F.filter(F.col(own + "cdf"), lambda c: c < uniform(F.lit(seed), F.col(id_col), j)))
    count = F.aggregate(F.sequence(F.lit(1), own + "draws"), F.lit(0), lambda acc, j: acc + draw(j))
    copies = joined.withColumn(own + "n", count).where(F.col(own + "n") > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col(own + "n") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy_no")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the keys are uniform, so dealing by their hash and sorting within a partition is a shuffle of all rows that needs no second pass for range bounds
    mixed = copies.withColumn(own + "key", key).repartition(parts, own + "key").sortWithinPartitions(own + "key")
    return mixed.select(*rest.columns, "copy_no", F.col(own + "rate").alias("source_rate"))
