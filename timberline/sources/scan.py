"""Log text as numbered lines, and entry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.sources.store import any_of, contents_path, small, written


def _lines(reader, paths: list[str]) -> DataFrame:
    # the place in the scan has to be taken directly over it
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value",
    )


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the files: file_path, file_name, block, place, value. UTF-8; LF, CR and CRLF end lines; empty files give none."""
    return _lines(spark.read, list(paths))


def scan_dir(spark: SparkSession, path: str, glob: str = "*.log*") -> DataFrame:
    """Lines of all files at any depth below ``path`` whose names match ``glob``."""
    return _lines(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob), [path])


def rolled(lines: DataFrame) -> DataFrame:
    """Lines of logs that were rolled into parts, each log in a folder of its own: the folder is the file, and its parts, numbered in their names after the first hyphen, are blocks that follow each other.

    A part has to be smaller than 2^40 bytes.
    """
    part = F.regexp_extract("file_name", r"^[^-]*-(\d+)", 1).cast("long")
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    return lines.withColumns({"file_path": folder, "file_name": F.substring_index(folder, "/", -1), "block": F.shiftleft(part, 40) + F.col("block")})


def local_path(col) -> F.Column:
    """A file URI as a plain path, with escapes resolved."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(col, r"^file:/+", "/"), r"\+", "%2B"))


def with_provenance(lines: DataFrame) -> DataFrame:
    return lines.withColumn("file_path", local_path(F.col("file_path"))).withColumn("file_name", local_path(F.col("file_name")))


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``line_number``, from 1 within each file.

    Lines of a block stand next to each other in the scan, so a line's number within its block is its place less the block's
    first place. Blocks are counted once (one row each), and running sums over a file's blocks give their offsets. No task holds more than a
    block, and lines aren't shuffled where the table of blocks is small.
    """
    blocks = lines.groupBy("file_path", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_path", "block", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(small(written(blocks, "blocks"), 1_000_000, 128 << 20), ["file_path", "block"]).withColumn("line_number", F.col("place") + F.col("shift")).drop("shift", "place")


def read_entries(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """An entry table that :func:`timberline.sources.sinks.write_entries` wrote, with contents; or its entries with these few ids, whose contents alone are looked up."""
    rows = spark.read.parquet(path)
    rows = rows if ids is None else rows.filter(any_of("id", ids))
    at = contents_path(path)
    if "content_key" not in rows.columns:
        return rows
    contents = spark.read.parquet(at)
    if ids is None:
        contents = small(contents)
    else:
        contents = F.broadcast(contents.filter(any_of("content_key", [bytes(r[0]) for r in rows.select("content_key").filter("content_key is not null").distinct().collect()])))
    return rows.join(contents, "content_key", "left").drop("content_key")
