"""Running values within a key of a whole table, also where one key holds a large part of it.

Rows are sorted by range of (key, order) and written once, so that a key of many rows spreads over many ranges. Running
values are first taken within each (range, key); then each range gets, in one row, what the ranges before it (or after it)
hold of the key that it begins (or ends) with. So no window and no task has more than a range's rows, and the driver sees a
row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.common import materialize


class Scan:
    """df in the order of keys and order, written once. Its methods take a frame derived from rows, row by row, and give it back with running values.

    The order should be total within a key: what ties gets any order, though the same in every method.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column]):
        self.keys = keys
        placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
        self.rows = materialize(placed, "scan").withColumn("__part", F.shiftright("__at", 33))

    def _ends(self, frame: DataFrame, values: dict[str, Column]) -> list[tuple]:
        """For each range in order: its number, and (key, first row, rows, values) of its first key and of its last, and its number of keys."""
        each = frame.groupBy("__part", *self.keys).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"), *(v.alias(name) for name, v in values.items()))
        about = F.struct(F.struct(*self.keys), "__from", "__n", F.struct(*values))
        ends = each.groupBy("__part").agg(F.min_by(about, "__from"), F.max_by(about, "__from"), F.count("*"))
        return sorted(ends.collect())  # a row for each range

    def _carried(self, frame: DataFrame, carry: list[tuple], names: list[str]) -> DataFrame:
        """frame with a carried value for each name, null where there is none; carry: range, first and last row that it holds for, and the values."""
        kinds = dict(frame.dtypes)
        schema = ", ".join(["__part long, __low long, __high long", *(f"__c_{n} {kinds[n]}" for n in names)])
        table = F.broadcast(frame.sparkSession.createDataFrame(carry, schema))  # a row for each range
        inside = (F.col("__at") >= F.col("__low")) & (F.col("__at") <= F.col("__high"))
        joined = frame.join(table, "__part", "left")
        return joined.withColumns({f"__c_{n}": F.when(inside, F.col(f"__c_{n}")) for n in names}).drop("__low", "__high")

    def running(self, frame: DataFrame, sums: dict[str, str]) -> DataFrame:
        """frame with running sums, each row's own included: name -> SQL expression, never null."""
        local = Window.partitionBy("__part", *self.keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        out = frame.withColumns({n: F.sum(F.expr(e)).over(local) for n, e in sums.items()})
        carry, before = [], None
        for part, first, last, n in self._ends(frame, {n: F.sum(F.expr(e)) for n, e in sums.items()}):
            key, start, rows, values = first
            if before and str(before[0]) == str(key):
                carry.append((part, start, start + rows - 1, *before[1]))
                if n == 1:
                    before = (key, tuple(a + b for a, b in zip(before[1], values, strict=True)))
                    continue
            before = (last[0], tuple(last[3]))
        out = self._carried(out, carry, list(sums))
        return out.withColumns({n: F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums}).drop(*(f"__c_{n}" for n in sums))

    def numbered(self, name: str = "at", frame: DataFrame | None = None) -> DataFrame:
        """rows (or a frame of them) with their place within the key, from 0."""
        out = self.running(self.rows if frame is None else frame, {name: "1L"})
        return out.withColumn(name, F.col(name) - 1)

    def from_end(self, frame: DataFrame, largest: dict[str, str]) -> DataFrame:
        """frame with the largest value of a SQL expression over the row and those that follow it in its key."""
        local = Window.partitionBy("__part", *self.keys).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)
        out = frame.withColumns({n: F.max(F.expr(e)).over(local) for n, e in largest.items()})
        carry, after = [], None
        most = lambda a, b: max((x for x in (a, b) if x is not None), default=None)
        for part, first, last, n in reversed(self._ends(frame, {n: F.max(F.expr(e)) for n, e in largest.items()})):
            key, start, rows, values = last
            if after and str(after[0]) == str(key):
                carry.append((part, start, start + rows - 1, *after[1]))
                if n == 1:
                    after = (key, tuple(most(a, b) for a, b in zip(after[1], values, strict=True)))
                    continue
            after = (first[0], tuple(first[3]))
        out = self._carried(out, carry, list(largest))
        return out.withColumns({n: F.greatest(n, f"__c_{n}") for n in largest}).drop(*(f"__c_{n}" for n in largest))


def plain(frame: DataFrame) -> DataFrame:
    """frame without the columns that a scan needs."""
    return frame.drop("__at", "__part")


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "at") -> DataFrame:
    """df with each row's place (from 0) within its key."""
    return plain(Scan(df, keys, order).numbered(name))
