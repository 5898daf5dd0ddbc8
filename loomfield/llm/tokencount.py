"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of pre-token lengths for the vocabulary's own entries: the frequent pre-tokens that the
merges were made for, at most one entry for each id, so its size is bounded by the vocabulary. Tier two is a cache
in each Python worker for what the table misses; a miss is encoded once with the tokenizer's library. No pre-token is
shuffled: every document is counted where it is read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.base import slices, text_or_empty

#: Unicode's White_Space, which the pre-tokenizer's \s means; Python's \s has four control characters more.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of other characters with the space before it, or white space as the pre-tokenizer cuts it. The pre-tokenizer
#: never joins characters of two of these pieces, so the lengths of pieces add up.
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Entries that a worker's cache may hold; then it starts anew.
CACHE_ENTRIES = 400_000

_workers: dict = {}


def _tokenizer(path: str):
    """The tokenizer of a worker or the driver, its special strings and the cache of lengths."""
    if path not in _workers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        cut = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        _workers[path] = (tok, cut, {})
    return _workers[path]


def frequent_lengths(path: str) -> dict[str, int]:
    """Token counts of the vocabulary's entries that are whole pieces of text: at most one for each id."""
    tok, _, _ = _tokenizer(path)
    decoded = {tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())}
    whole = [p for p in decoded if p and "�" not in p and PIECES.fullmatch(p)]
    return dict(zip(whole, map(len, tok.encode_batch_fast(whole, add_special_tokens=False)), strict=True))


def _count(texts: list[str], path: str, table: dict[str, int]) -> list[int]:
    tok, cut, cache = _tokenizer(path)
    counts = []
    for text in texts:
        parts, total = [text], 0
        if cut is not None and "<" in text:
            parts = cut.split(text)
            total = len(parts) - 1
        for part in parts:
            pieces = PIECES.findall(part)
            found = list(map(cache.get, pieces))
            if None in found:
                missed = {p for p, n in zip(pieces, found, strict=True) if n is None}
                if len(cache) + len(missed) > CACHE_ENTRIES:
                    cache.clear()
                    missed = set(pieces)
                rest = []
                for p in missed:
                    n = table.get(p)
                    if n is None:
                        rest.append(p)
                    else:
                        cache[p] = n
                cache.update(zip(rest, map(len, tok.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
                found = map(cache.__getitem__, pieces)
            total += sum(found)
        counts.append(total)
    return counts


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens (as the library counts them, no begin or end tokens;
    special strings in a text count as their one token), over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row is counted alone. Other columns are ignored.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known = table.value
        for part in slices(batches):
            counts = _count(part.column(2).to_pylist(), tokenizer_path, known)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
