"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import fresh, saved, small, text_or_empty

#: Characters that the second round reads of each text that is left.
PREFIX = 256
#: Bits, as a power of two, of the map that marks what the second round leaves.
BITS = 24


def normalised(text: Column | str) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def _bits(keys: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of 2^``BITS`` bits with one set for each hash in ``keys`` (h), a few MB at most whatever there is to mark."""
    return keys.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))


def _marked(bits: str, h: str) -> Column:
    place = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0


#: The same for other operators.
marks, marked = _bits, _marked


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, and the ``extra`` columns.

    Texts are equal when they are identical after :func:`normalised`. Three rounds narrow the rows down:

    1. the length of every text; only lengths that occur twice go on;
    2. a hash of the first ``prefix`` characters of those; only (length, hash) pairs that occur twice go on;
    3. SHA-256 of the whole text of those; equal digests form a group.

    The first two rounds work on a written table of lengths and hashes, the third reads the texts again. No text is shuffled: the pairs that are left
    mark bits in a map of fixed size, which is broadcast. A text that finds its bit marked by another pair is
    digested for nothing and then is alone with its digest. Group sizes are summed before the shuffle, so a group that holds
    a third of all rows costs one row per task, and the last join may be split by adaptive execution.

    Null and empty texts are equal to each other. Rows that repeat both id and text are members of one group
    and share its ``keep_id``, so all of them count as kept; use :func:`keep_first` to get one of them.
    A null id never wins against another id. Other columns of ``docs`` are not read, whatever their names.
    An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"), *[c.alias(f"_x_{n}") for n, c in (extra or {}).items()])
    extras = [f"_x_{n}" for n in extra or {}]
    length = F.length("_norm").alias("_len")
    head = F.xxhash64(F.substring("_norm", 1, prefix)).alias("_head")

    light = saved(base.select(length, head), "lengths")
    lengths = saved(light.groupBy("_len").count().filter("count > 1").select("_len"), "repeated-lengths")
    heads = light.join(small(lengths), "_len", "left_semi").groupBy("_len", "_head").count().filter("count > 1")
    h = F.pmod(F.xxhash64("_len", "_head"), F.lit(1 << BITS)) + 1
    marks = saved(_bits(heads.select(h.alias("h"))), "marks")

    rows = base.select("_id", *extras, "_norm", length, head).withColumn("_h", h)
    rows = rows.join(F.broadcast(marks), F.bitmap_bucket_number("_h") == F.col("bucket"), "left")  # a broadcast of 2^BITS bits
    rows = saved(rows.select("_id", *extras, F.when(_marked("bits", "_h"), F.sha2("_norm", 256)).alias("_full")), "digests")

    groups = rows.filter("_full is not null").groupBy("_full").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1")
    groups = small(saved(groups, "groups"))
    alone = rows.filter("_full is null").select("*", F.lit(None).cast(groups.schema["_keep"].dataType).alias("_keep"), F.lit(None).cast("long").alias("_size"))
    found = rows.filter("_full is not null").join(groups, "_full", "left").unionByName(alone)  # rows without a key would meet in one task
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), *[F.col(f"_x_{n}").alias(n) for n in extra or {}],
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier id has; of rows that repeat id and text, one stays."""
    own, own_text, text = fresh(docs, "_kept_id"), fresh(docs, "_kept_text"), fresh(docs, "_text_sha256")
    digest = F.sha2(normalised(text_col), 256)
    kept = exact_groups(docs, id_col, text_col, extra={"sha256": digest}).filter("kept")
    kept = kept.select(F.col(id_col).alias(own), F.col("sha256").alias(own_text)).distinct()
    rows = docs.withColumn(text, digest).dropDuplicates([id_col, text])
    return rows.join(kept, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(text) == F.col(own_text)), "left_semi").drop(text)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, extra={"text_sha256": F.sha2(normalised("text"), 256)}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
