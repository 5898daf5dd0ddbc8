"""Global order of a table by a distributed LSD radix sort.

Rows stand in blocks of bounded size, each at a slot. A pass takes one digit of the key, the least significant first: the
rows of each (block, digit) are counted; a digit's rows begin after those of all smaller digits, and within a digit the
blocks follow one another; so every (block, digit) has a global offset. Then each block goes to one task, which takes its
rows in the order of their slots and gives the i-th row of a digit the place offset + i. The place is the row's block and
slot for the next pass, so every pass is stable, and after the last one the place is the row's rank. A pass shuffles each
row once; digits that no two rows differ in have no pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.common import Tables
from loomfield.llm.base import given_back

#: Bits of a digit, and rows of a block at most.
DIGIT_BITS, BLOCK_ROWS = 11, 500_000


def _distance(key: Column, low: int, high: int, ascending: bool) -> tuple[Column, int]:
    """The key as an unsigned number that is smallest where the order begins, and its number of bits."""
    if high - low < 1 << 63:
        return (key - F.lit(low) if ascending else F.lit(high) - key), (high - low).bit_length()
    turned = key.bitwiseXOR(F.lit(-(1 << 63)))
    return (turned if ascending else F.bitwise_not(turned)), 64


def places_of_block(block: np.ndarray, slot: np.ndarray, digit: np.ndarray, offsets: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The place of each row: the offset of its (block, digit) and the number of rows of that block and digit in slots before its own."""
    radix = 1 << DIGIT_BITS
    _, at, sizes = np.unique(block, return_inverse=True, return_counts=True)
    order = np.empty(len(block), np.int64)
    order[(np.cumsum(sizes) - sizes)[at] + slot] = np.arange(len(block))  # rows by block and slot
    cell = block.astype(np.int64) * radix + digit
    by_cell = order[np.argsort(cell[order], kind="stable")]
    ordered = cell[by_cell]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    within = np.arange(len(ordered)) - np.repeat(begins, np.diff(np.append(begins, len(ordered))))
    cells = offsets[0].astype(np.int64) * radix + offsets[1]
    sort = np.argsort(cells)
    places = np.empty(len(block), np.int64)
    places[by_cell] = offsets[2][sort][np.searchsorted(cells[sort], ordered)] + within
    return places


def radix_places(rows: DataFrame, keys: list[tuple[str, bool]], tables: Tables, place: str = "place") -> tuple[DataFrame, int]:
    """rows with their place (from 0, without gaps) in the order of the long columns keys, each (name, ascending), and their number.

    The first key counts most. Nulls come last in a key. Rows equal in all keys get places in any order among themselves.
    Other columns are carried along; none may be named __block, __slot, __base or __k0, __k1, .... The result reads a table of tables.
    """
    radix = 1 << DIGIT_BITS
    stats = [f(name).alias(f"{tag}{i}") for i, (name, _) in enumerate(keys) for tag, f in (("l", F.min), ("h", F.max), ("n", F.count))]
    found = rows.agg(F.count("*").alias("rows"), *stats).first()
    n, digits, columns = found["rows"], [], {}
    for i, (name, ascending) in reversed(list(enumerate(keys))):
        if found[f"n{i}"]:
            key, bits = _distance(F.col(name), found[f"l{i}"], found[f"h{i}"], ascending)
            columns[f"__k{2 * i}"] = F.coalesce(key, F.lit(0).cast("long"))
            digits += [(f"__k{2 * i}", shift) for shift in range(0, bits, DIGIT_BITS)]
        if 0 < found[f"n{i}"] < n:
            columns[f"__k{2 * i + 1}"] = F.col(name).isNull().cast("long")
            digits.append((f"__k{2 * i + 1}", 0))
    at = F.monotonically_increasing_id()
    state = rows.withColumns(columns).withColumn("__at", at)
    state = state.withColumn("__block", F.shiftright("__at", 33).cast("int")).withColumn("__slot", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    state = tables.write(state, "radix-rows")
    if not digits:  # no two rows differ
        digits = [(None, 0)]
    wanted = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_ROWS))
    size = max(1, -(-n // wanted))
    blocks = (state.agg(F.max("__block")).first()[0] or 0) + 1
    for turn, (key, shift) in enumerate(digits):
        digit = (F.shiftrightunsigned(key, shift).bitwiseAND(radix - 1) if key else F.lit(0)).cast("int")
        state, blocks = _pass(state, digit, blocks, size, tables, turn), max(1, -(-n // size))
        if turn:
            tables.drop(f"radix-{turn - 1}")
    tables.drop("radix-rows")
    state = state.withColumn(place, F.col("__block") * F.lit(size).cast("long") + F.col("__slot"))
    return state.drop("__block", "__slot", *columns), n


def _pass(state: DataFrame, digit: Column, blocks: int, size: int, tables: Tables, turn: int) -> DataFrame:
    """state after one stable counting sort by the digit, in blocks of size rows."""
    counts = tables.write(state.groupBy("__block", digit.alias("digit")).agg(F.count("*").alias("n")), f"counts-{turn}")
    begin, starts = 0, []
    for value, n in sorted(counts.groupBy("digit").agg(F.sum("n")).collect()):  # a row a digit value, 2 ** DIGIT_BITS at most
        starts.append((value, begin))
        begin += n
    starts = state.sparkSession.createDataFrame(starts, "digit int, start long")
    before = Window.partitionBy("digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), "digit")
    offsets = offsets.select("__block", F.col("digit").alias("__digit"), (F.col("start") + F.col("before")).alias("__base"))
    rows = state.withColumns({"__digit": digit, "__base": F.lit(None).cast("long")})
    both = rows.unionByName(offsets, allowMissingColumns=True).repartitionById(blocks, F.col("__block"))
    kept = state.schema.fieldNames()

    def move(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        is_row = table["__base"].is_null()
        offsets, table = table.filter(pa.compute.invert(is_row)), table.filter(is_row)
        if not table.num_rows:
            return
        numbers = lambda t, *names: tuple(t[c].to_numpy() for c in names)
        places = places_of_block(*numbers(table, "__block", "__slot", "__digit"), numbers(offsets, "__block", "__digit", "__base"))
        columns = {c: table[c] for c in kept} | {"__block": pa.array((places // size).astype(np.int32)), "__slot": pa.array(places % size)}
        yield from pa.table(columns).to_batches(max_chunksize=100_000)

    moved = tables.write(both.mapInArrow(given_back(move), state.schema), f"radix-{turn}")
    tables.drop(f"counts-{turn}")
    return moved
