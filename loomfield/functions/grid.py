"""A grid of several levels for joins of rectangles: a rectangle lies at the level whose cells are no smaller than it, so it touches four cells at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bounds = list[tuple[Column, Column]]


class Grid:
    """Cells of base * 2 ** level, base being four times the mean longer side of all rectangles, so that most touch one cell; two sides meet at the higher of their levels.

    sides: up to two frames, each with the bounds of its rectangles in x and y. The levels that occur are few (a number for
    each power of two between the smallest and the largest rectangle) and are read by the driver, with one sum.
    """

    def __init__(self, sides: tuple[tuple[DataFrame, Bounds], ...]):
        longer = [df.where(self.finite(b)).select(self._longer(b).alias("s")) for df, b in sides]
        sums = [s.agg(F.sum("s"), F.count("s")).first() for s in longer]
        total, n = sum(x[0] or 0.0 for x in sums), sum(x[1] for x in sums)
        self.base = 4 * total / n if n and 0 < total / n < float("inf") else 1.0
        self.levels = [sorted(s.agg(F.collect_set(self._level(F.col("s")))).first()[0]) for s in longer]

    @staticmethod
    def finite(bounds: Bounds) -> Column:
        """Whether all bounds are numbers."""
        ok = F.lit(True)
        for v in (v for pair in bounds for v in pair):
            ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        return ok

    @staticmethod
    def _longer(bounds: Bounds) -> Column:
        return F.greatest(*(high - low for low, high in bounds)).cast("double")

    def _level(self, longer: Column) -> Column:
        # one more than the logarithm asks for where rounding could have made it too small
        return F.when(longer <= self.base, 0).otherwise(F.ceil(F.log2(longer / self.base) + 1e-9)).cast("int")

    def cell(self, v: Column) -> Column:
        """The cell of a coordinate at the row's level."""
        return F.floor(v / (F.lit(self.base) * F.pow(F.lit(2.0), F.col("level"))))

    def at_levels(self, df: DataFrame, levels: list[int]) -> DataFrame:
        """A row of df for each level."""
        return df.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))

    def placed(self, df: DataFrame, bounds: Bounds, side: int | None, own: str) -> DataFrame:
        """A row of df for each cell (level, gx, gy) that its rectangle touches at its own level and at the higher ones of the other side (0 or 1)."""
        others = self.levels[1 - side] if side is not None else []
        rows = df.where(self.finite(bounds)).withColumn(own, self._level(self._longer(bounds)))
        higher = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda level: level > F.col(own))
        rows = rows.withColumn("level", F.explode(F.concat(F.array(own), higher)))
        for name, (low, high) in zip(("gx", "gy"), bounds, strict=True):
            rows = rows.withColumn(name, F.explode(F.sequence(self.cell(low), self.cell(high))))
        return rows
