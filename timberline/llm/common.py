"""What the operators of this subpackage share: written tables and checked broadcasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources.store import removed, written


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, so that lineage ends here."""
    return written(df, name)


#: A table of at most this many rows, with so many bytes of text in them, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has at most ``rows`` rows and ``size`` bytes of text: it is counted and measured here."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(reduce(Column.__add__, texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return n <= rows and held <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if it :func:`fits`, else as it is: a shuffled join follows."""
    return F.broadcast(df) if fits(df, rows, size) else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
