"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.sources.store import removed, written

#: Bits of a row's place within its partition, as ``monotonically_increasing_id`` has them.
_ROW_BITS = 33


def numbered(df: DataFrame, *by: str, name: str = "rank", after: int = 0, evaluated: bool = False) -> DataFrame:
    """Adds ``name``: ``after`` + 1, + 2, ... in the order of the columns ``by``.

    Rows are dealt out by ranges of ``by``, sorted, and written with their place in their range; a range's rows come after
    those of all ranges before it, which takes one row per range. Rows whose ``by`` are all equal are in one range, in any order.

    Ranges come from a sample, for which Spark would evaluate ``df`` a first time: it is written before, unless it is a table already (``evaluated``).
    """
    rows = df if evaluated else written(df, "rows")
    place = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", place), "places")
    if not evaluated:
        removed(rows)
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes = F.broadcast(sizes.select("_part", (ahead + after + 1).alias("_ahead")))
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("_part", part).join(sizes, "_part").withColumn(name, F.col("_ahead") + within).drop("_part", "_place", "_ahead")
