"""Ids, dimensions, and the star join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.order import numbered
from timberline.sources.store import BROADCAST_ROWS, any_of, small, written

#: fact column -> entry column
DIMENSIONS = {"file_id": "file_path", "channel_id": "channel", "level_id": "level", "source_id": "source"}


def assign_ids(entries: DataFrame, after: int = 0, order: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Adds ``id``, from ``after`` + 1 in order of file and line. A long file is numbered by many tasks."""
    return numbered(entries, *order, "line_number", name="id", after=after)


def table_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("max_id"), F.count("*").alias("n"))


def dimensions(entries: DataFrame, stored: dict[str, DataFrame] | None = None, columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """key -> (id, value) for each of ``columns`` (key -> entry column): different values numbered in the order in which they first come.

    One pass over the entries finds the first id of every value of every column. With ``stored`` dimensions of earlier loads, their values keep their ids, and new
    ones are numbered after the highest. Null values have no id, as facts without a value aren't decoded.
    """
    columns = DIMENSIONS if columns is None else columns
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in columns.items()]))
    first = entries.select("id", pairs.alias("p")).filter("p.value is not null").groupBy("p.key", "p.value").agg(F.min("id").alias("first"))
    first = written(first, "values")
    out = {}
    for key in columns:
        new, old = first.filter(F.col("key") == key), (stored or {}).get(key)
        top = 0
        if old is not None:
            new = new.join(small(old.select("value")), "value", "left_anti")
            top = table_stats(old).first()["max_id"]
        new = numbered(new, "first", "value", name="id", after=top).select("id", "value")
        out[key] = new if old is None else old.select("id", "value").unionByName(new)
    return out


def dimension(entries: DataFrame, column: str, stored: DataFrame | None = None) -> DataFrame:
    """(id, value) of one column, as :func:`dimensions`; a written table."""
    return dimensions(entries, None if stored is None else {column: stored}, {column: column})[column]


def _joined(rows: DataFrame, dim: DataFrame, on: str, most: int) -> DataFrame:
    """``rows`` with the other column of ``dim``, by ``on``; inner.

    A dimension of up to ``most`` rows is broadcast. Of a larger one the part that frequent values need is: those that more than one row in 4 x the
    number of shuffle partitions has, of which there can't be more than that number. Rows of all other values are shuffled, and none of those fills a task.
    Where all values are frequent, that is all. ``rows`` are looked at for their counts and for either part, so they are written before, which keeps a chain of joins from being done anew for each.
    """
    dim = written(dim, "dim")
    joined = small(dim, most)
    if joined is not dim:
        return rows.join(joined, on)
    rows = written(rows, "joined")
    spots = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(rows.groupBy(on).agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    frequent = written(dim.join(F.broadcast(counts.filter(F.col("_n") * spots > total).select(on)), on, "left_semi"), "frequent")  # at most ``spots`` rows
    if frequent.count() == dim.count():
        return rows.join(F.broadcast(frequent), on)
    (other,) = [c for c in dim.columns if c != on]
    marked = rows.join(F.broadcast(frequent), on, "left")
    return marked.filter(F.col(other).isNotNull()).unionByName(marked.filter(F.col(other).isNull()).drop(other).join(dim, on))


def encode_fact(entries: DataFrame, dims: dict[str, DataFrame], most: int = BROADCAST_ROWS) -> DataFrame:
    """Entries with ids in place of the dimensions' values. No value's entries meet in one task, however many they are: see :func:`_joined`."""
    return as_fact(encoded(entries, dims, most))


def encoded(entries: DataFrame, dims: dict[str, DataFrame], most: int = BROADCAST_ROWS) -> DataFrame:
    """Entries with the dimensions' ids beside all that they had."""
    for key, column in DIMENSIONS.items():
        entries = _joined(entries, dims[key].select(F.col("id").alias(key), F.col("value").alias(column)), column, most)
    return entries


def as_fact(entries: DataFrame, content: str = "content") -> DataFrame:
    """``content``: the column that has contents, or their keys."""
    return entries.select("id", "line_number", "file_id", "ts", "channel_id", "elapsed_ms", "level_id", "source_id", content, F.array_join("flags", " ").alias("flags"))


def decode_fact(fact: DataFrame, dims: dict[str, DataFrame], most: int = BROADCAST_ROWS) -> DataFrame:
    """The star join: facts with their dimensions' values; joined as in :func:`encode_fact`."""
    for key, column in DIMENSIONS.items():
        fact = _joined(fact, dims[key].select(F.col("id").alias(key), F.col("value").alias(column)), key, most)
    return fact.drop(*DIMENSIONS)


def fetch_by_ids(entries: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """The entries with these ids, by time. Few ids are a list; many are a table with ``id``.

    A list is looked up in the ids' Bloom filters, where a stored table has them (:func:`timberline.sources.sinks.write_entries`): row groups without any of them aren't read.
    """
    if isinstance(ids, list):
        found = entries.filter(any_of("id", ids))
    else:
        found = entries.join(ids, "id", "left_semi")
    return found.orderBy("ts", "line_number", "id")
