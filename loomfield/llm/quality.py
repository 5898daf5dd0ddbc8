"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger stores the measurements and one bit for each failed rule.
Policies are versioned masks over those bits, so a new policy or an ablation needs no second look at the texts.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.base import slices, text_or_empty

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_alpha_words", "n_distinct_words", "n_adjacent")


def rules() -> tuple[tuple[str, Column], ...]:
    """(name, whether a document fails) in the order of their bits; new rules go at the end."""
    m = F.col
    return (
        ("few_words", m("n_words") < 20),
        ("repeated_windows", 100 * m("n_repeat_words") > 30 * m("n_words")),
        ("symbols", m("n_symbols") * 10 > m("n_words")),
        ("repeated_lines", (m("n_lines") >= 6) & (2 * m("n_dup_lines") > m("n_lines"))),
        ("short_words", m("word_chars") < 2 * m("n_words")),
        ("long_words", m("word_chars") > 20 * m("n_words")),
        ("upper_case", (m("n_words") > 0) & (2 * m("n_upper_words") > m("n_words"))),
        ("few_letters", 10 * m("n_alpha_words") < 5 * m("n_words")),
        ("few_distinct_words", (m("n_words") >= 50) & (20 * m("n_distinct_words") < m("n_words"))),
        ("stuttering", 2 * m("n_adjacent") > m("n_words")),
    )


RULE_NAMES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "upper_case", "few_letters", "few_distinct_words", "stuttering")
#: Policy versions: the rules that drop a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "upper_case", "few_letters", "stuttering"),
}


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << RULE_NAMES.index(n) for n in names)


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        keys += ids[k : k + n]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, np.unique(twice)))
    windows = [tuple(words[i : i + WINDOW]) for i in at.tolist()]  # the words themselves decide
    found = Counter(windows)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i, w in zip(at.tolist(), windows, strict=True) if found[w] > 1], np.int64)
    if not len(starts):
        return 0
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    distinct = set(words)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    alpha = sum(map(bytes.isalpha, words))
    if alpha * 2 < len(words):  # letters beyond ASCII and words with a mark at their end
        alpha = sum(any(c.isalpha() for c in w.decode("utf-8", "surrogatepass")) for w in words)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        upper,
        alpha,
        len(distinct),
        sum(map(eq, words, words[1:])),
    )


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, the MEASURES (long) and failed (long, bit i set when rule i fails).

    A null or empty text has no words and fails few_words. Ids may be null or repeat; each row is judged alone. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            rows = [measure(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["id", *MEASURES])

    measured = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0).cast("long") for i, (_, fails) in enumerate(rules())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.select(F.col("id").alias(id_col), *MEASURES, failed.alias("failed"))


def keeps(policy: str, failed: str = "failed") -> Column:
    """Whether a policy keeps the document of a ledger row."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policies(ledger: DataFrame, policies: tuple[str, ...] = ("base", "v1")) -> DataFrame:
    """The ledger with a boolean column kept_<policy> for each policy; the texts are not read again."""
    return ledger.withColumns({f"kept_{p}": keeps(p) for p in policies})


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents, failed by it, and failed by it alone (what dropping the rule would return).

    An empty ledger gives one row per rule with zeros.
    """
    m = mask(POLICIES[policy])
    hit = F.col("failed").bitwiseAND(F.lit(m))
    sums = [F.count("*").alias("n_docs"), F.coalesce(F.bit_or("failed"), F.lit(0)).alias("any_failed")]
    for name in POLICIES[policy]:
        one = F.lit(mask((name,)))
        sums += [F.count(F.when(hit.bitwiseAND(one) != 0, 1)).alias(f"f_{name}"), F.count(F.when(hit == one, 1)).alias(f"a_{name}")]
    table = ledger.agg(*sums)
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"a_{n}").alias("n_failed_alone")) for n in POLICIES[policy]))
    return table.select("n_docs", F.inline(each))
