"""Running sums and maxima over the ordered rows of a key, for keys of any size.

A plain window sorts all rows of a key in one task. Here rows are laid out once in
one order by key, so that a large key lies in several tasks' stretches, its pieces.
A scan runs a window inside each piece, totals each piece to one row, scans those
rows (as many as a key has pieces) and adds what came before to each piece.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.sources.tables import written

#: Columns of a layout; callers' rows must not have them.
PLACE = ["piece", "pos"]


class Layout:
    """Rows in one order by ``key`` (columns) and ``order`` (columns), and scans of columns of them.

    ``order`` should tell rows of a key apart; ties stand as they come, in one
    fixed order for all scans of this layout. Null keys are a key.
    """

    def __init__(self, rows: DataFrame, key: list[str], order: list):
        if set(PLACE) & set(rows.columns):
            raise ValueError(f"columns {PLACE} are the layout's own")
        laid = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("pos", F.monotonically_increasing_id())
        self.key, self.rows = key, written(laid.withColumn("piece", F.shiftright("pos", 33)), "layout")

    def _scan(self, name: str, value: Column, total, window_total, join, before: bool) -> "Layout":
        """This layout with the column ``name``: the scan of ``value`` up to each row, or of the rows before it only."""
        own = Window.partitionBy(*self.key, "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        held = self.rows.withColumn(f"own {name}", value)
        pieces = held.groupBy(*self.key, "piece").agg(total(f"own {name}").alias("all"))
        earlier = Window.partitionBy(*self.key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        carry = pieces.select(*[F.col(k).alias(f"its {k}") for k in self.key], F.col("piece").alias("its piece"), window_total("all").over(earlier).alias("carried"))
        same = F.col("piece") == F.col("its piece")
        for k in self.key:
            same = same & F.col(k).eqNullSafe(F.col(f"its {k}"))
        joined = held.withColumn(f"own {name}", window_total(f"own {name}").over(own)).join(carry, same, "left")
        out = Layout.__new__(Layout)
        out.key, out.rows = self.key, joined.withColumn(name, join(F.col(f"own {name}"), F.col("carried"))).drop(f"own {name}", "carried", "its piece", *[f"its {k}" for k in self.key])
        return out

    def sums(self, name: str, value: Column, before: bool = False) -> "Layout":
        """Running sum of ``value``; 0 where nothing was summed."""
        return self._scan(name, value, F.sum, F.sum, lambda own, carried: F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0)), before)

    def maxima(self, name: str, value: Column, before: bool = False) -> "Layout":
        """Running maximum of ``value``, nulls left out; null where there was none."""
        return self._scan(name, value, F.max, F.max, lambda own, carried: F.greatest(own, carried), before)

    def with_column(self, name: str, value: Column) -> "Layout":
        """This layout with another column, of the row alone."""
        out = Layout.__new__(Layout)
        out.key, out.rows = self.key, self.rows.withColumn(name, value)
        return out

    def result(self) -> DataFrame:
        return self.rows.drop(*PLACE)
