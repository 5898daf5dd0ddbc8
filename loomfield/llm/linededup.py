"""Line deduplication by site-relative frequency.

Lines that many pages of one host share are its boilerplate: for each host, the pages that contain a line over the
host's pages. Lines are counted by their 64-bit hash, once for each page, with partial sums before the shuffle, so a hot
host or line never gathers rows. A host can have only (lines a page) / (ratio) lines above the ratio.
A page is a row, or, on request, a group of near copies: else a large group makes its own lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm import jaccard
from loomfield.llm.base import fits_broadcast, materialize, own_prefix

#: Boilerplate lines, over all hosts, that are broadcast at most; with more, they are joined by shuffle.
BROADCAST_LINES = 200_000
#: Tasks at least over which such a join deals the pages of each host.
HOST_PARTS = 64
WHITE = " \t\n\x0b\x0c\r"


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def line_hashes(text: Column) -> Column:
    """Hashes of a text's distinct lines without the white space around them; blank lines have none."""
    lines = F.filter(F.transform(F.split(text, "\n"), _stripped), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _counts(docs: DataFrame, host_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """host, line, pages and host_, host_pages; every row is a page."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    counts = pages.select("host", F.explode(line_hashes(F.coalesce("text", F.lit("")))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    return counts, pages.groupBy("host").agg(F.count("*").alias("host_pages")).withColumnRenamed("host", "host_")


def _counts_of_groups(docs: DataFrame, host_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """host, line, pages and host_, host_pages; the rows of a host that are copies at percent of shared passages, or through others, are one page."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = docs.select(F.col(host_col).alias("host"), text.alias("text"), F.xxhash64(text).alias("page"))
    groups = jaccard.near_duplicates(pages, percent, id_col="page").select("page", F.col("component_id").alias("group")).distinct()
    groups = materialize(groups, "page-groups")
    # equal pages are taken once before the join, so that a large group of them is no hot key
    lines = pages.select("host", "page", F.explode(line_hashes(F.col("text"))).alias("line")).distinct().join(groups, "page")
    counts = lines.select("host", "line", "group").distinct().groupBy("host", "line").agg(F.count("*").alias("pages"))
    hosts = pages.select("host", "page").distinct().join(groups, "page").select("host", "group").distinct()
    return counts, hosts.groupBy("host").agg(F.count("*").alias("host_pages")).withColumnRenamed("host", "host_")


def boilerplate(docs: DataFrame, ratio: float, least_pages: int, host_col: str, text_col: str, copies: int | None = None) -> DataFrame:
    """host, line (its hash), pages, host_pages of the lines that more than ratio of their host's pages contain, and least_pages at least. A null host is a host, a null text has no lines, every row is a page unless copies says otherwise; an empty table gives no lines."""
    counts, totals = _counts(docs, host_col, text_col) if copies is None else _counts_of_groups(docs, host_col, text_col, copies)
    counts = counts.where(F.col("pages") >= least_pages)
    totals = F.broadcast(totals) if fits_broadcast(totals, BROADCAST_LINES) else totals
    return counts.join(totals, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("pages") > ratio * F.col("host_pages")).select("host", "line", "pages", "host_pages")


def drop_boilerplate(docs: DataFrame, ratio: float = 0.02, least_pages: int = 3, host_col: str = "source", text_col: str = "text", chars_col: str | None = "n_chars", copies: int | None = None) -> DataFrame:
    """docs with the boilerplate lines of each host taken out of the texts; chars_col, if docs has it, is counted anew where lines went.

    Lines are parted by \\n and compared without the white space around them; blank lines always stay. Every row is a page
    (repeated rows count as pages of their own); with copies, exact copies and near copies (at so many percent of shared
    passages, as jaccard has them, of whatever host) are one page of each of their hosts, in a line's pages and a host's
    alike. A null host is a host; a null text stays null and has no lines; a text all of boilerplate becomes empty, and its
    row stays. Columns stay as they are.
    """
    own = own_prefix(docs)
    dropped = materialize(boilerplate(docs, ratio, least_pages, host_col, text_col, copies).select("host", "line"), "boilerplate")
    by_host = dropped.groupBy("host").agg(F.collect_list("line").alias(own + "lines")).withColumnRenamed("host", own + "host")
    same = F.col(host_col).eqNullSafe(F.col(own + "host"))
    if fits_broadcast(dropped, BROADCAST_LINES):
        joined = docs.join(F.broadcast(by_host), same, "left")
    else:  # the pages of a large host go to many tasks, each with the host's lines
        by_host = by_host.withColumn(own + "part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
        part = F.pmod(F.xxhash64(text_col), F.lit(HOST_PARTS)).cast("int")
        joined = docs.join(by_host, same & (part == F.col(own + "part")), "left")
    gone = F.coalesce(F.arrays_overlap(line_hashes(F.col(text_col)), F.col(own + "lines")), F.lit(False))
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.coalesce((_stripped(x) != "") & F.array_contains(F.col(own + "lines"), F.xxhash64(_stripped(x))), F.lit(False))), "\n")
    out = joined.withColumn(own + "text", F.when(gone, kept).otherwise(F.col(text_col)))
    changed = {text_col: F.col(own + "text")}
    if chars_col and chars_col in docs.columns:
        changed[chars_col] = F.when(gone, F.length(own + "text").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))
