"""Documents to packed training sequences, in five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfield.llm import base, jaccard, linededup, mixing, packing, toxicity
from loomfield.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; repeated rows, rows without an id and empty or null texts are scored like any other, and an empty table stays empty."""
    return toxicity.drop_toxic(docs, base.read_table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; copies, which the next stage takes out, count once."""
    return linededup.drop_boilerplate(docs, ratio=0.02, least_pages=3, copies=80)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows without an id and texts without words all stay, and so do rows that repeat the kept id. An empty table stays empty."""
    return jaccard.keep_one(docs, percent=80, n=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's target weight, in a global shuffle; a null source is a source, a null id draws as an empty one, and an empty table stays empty."""
    return mixing.mix(docs, seed=42, temperature=0.5, total=1.0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the space-filling curve; a null text is its end token alone, every row is a document, and an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written to the shared folder before the next reads it."""
    docs = base.read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = base.materialize(docs, f"stage-{name}")
    return docs
