"""Mixing sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import saved, small, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a size class in one ordered slice, on average.
SLICE = 20_000


def words(text: Column | str) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def drawn(kind: str, key: Column, seed: int) -> Column:
    """A number in [0, 2^32) that depends on the key and the seed alone."""
    text = F.concat(F.lit(f"{seed}/{kind}/"), F.coalesce(key, F.lit("\x00null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same and ``target``.

    Sources in code-point order, null last, get the weights in turn and share ``share`` times all sizes.
    A target stops at ``ceiling`` times its source's size; what is over is shared again by weight among the
    others, until none is above. That has a closed form: in ascending order of limit / weight, sources are
    full up to the first one that its share of what is then left doesn't fill. The windows here see one row per source.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("w"))
    ranked = ranked.withColumn("top", F.col("source_size") * F.lit(float(ceiling)))
    by_fill = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.select(
        "*", F.row_number().over(by_fill).alias("k"), (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("pool"),
        F.coalesce(F.sum("top").over(before), F.lit(0.0)).alias("full"), (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open"),
    )
    fits = (F.col("pool") - F.col("full")) * F.col("w") <= F.col("top") * F.col("open")
    first = F.min(F.when(fits, F.struct("k", "full", "open"))).over(everything)
    ranked = ranked.withColumn("first", first)
    even = (F.col("pool") - F.col("first.full")) * F.col("w") / F.col("first.open")
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("top")).otherwise(F.least("top", even))
    return ranked.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def size_class(size: Column | str) -> Column:
    """Sizes in classes of about a tenth of their value: 8 for each doubling, so some hundred classes at any scale."""
    size = F.col(size) if isinstance(size, str) else size
    top = F.length(F.bin(size)) - 1  # the highest bit
    return F.when(size < 16, size).otherwise(top * 8 + F.floor(size * 8 / F.pow(F.lit(2.0), top)) - 8 + 100).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 17, slice_rows: int = SLICE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, ``copies``, ``taken`` (copies x size), and the columns in ``carry``, named ``_c_<column>``.

    Every document of a source expects target / source_size copies. The documents of a source stand in a fixed
    order; the running sum of expected copies plus one random offset per source crosses some integers at each
    document, and each crossing emits it once. The order is by size class first, so that a source's taken
    words differ from its target by few documents' sizes instead of by the noise of a random order.

    The running sum is a rank times a constant. The rank is built in two levels: counts of (source, size
    class, slice), of which there are few, are summed over a window; within a slice rows are numbered. A hot source
    has many slices (a hash of the id), so no task orders more than about ``slice_rows`` rows of one source.

    Null sources form a source of their own, ordered last. Null and empty texts have size 0 and may be
    emitted, but take no words. Rows that repeat an id are counted as rows of their own, in any order among
    themselves; rows without an id stand in the order of their texts' hashes. Very long texts are counted whole, as one row. Other columns of ``docs`` are not read unless in ``carry``. An empty table gives an empty result.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x00null/"), F.md5(text_or_empty(text_col).cast("binary"))))  # rows without an id are told apart by their texts
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(source_col).alias("source"), words(text_col).alias("size"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    light = saved(rows.select("id", "key", "source", "size"), "sizes")  # words are counted once, and again only where other columns are carried
    rows = rows if carry else light
    classes = light.groupBy("source", size_class("size").alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    classes = saved(classes, "classes")
    plan = targets(classes.groupBy("source").agg(F.sum("total").alias("source_size")), weights, share, ceiling)
    cut = small(classes.select(F.col("source").alias("_s"), F.col("class").alias("_c"), F.ceil(F.col("n") / slice_rows).cast("long").alias("slices")))

    def sliced(df: DataFrame) -> DataFrame:
        df = df.withColumn("class", size_class("size"))
        df = df.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left").drop("_s", "_c")
        return df.withColumn("slice", drawn("slice", F.col("key"), seed) % F.col("slices"))

    rows = sliced(rows)
    parts = sliced(light).groupBy("source", "class", "slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_s"), F.col("class").alias("_c"), F.col("slice").alias("_p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    planned = plan.select(F.col("source").alias("_s2"), "source_size", "target")
    parts = small(saved(parts.join(planned, F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2"), "slices"))

    inside = Window.partitionBy("source", "class", "slice").orderBy("size", "id", "key")
    numbered = rows.withColumn("n", F.row_number().over(inside))
    numbered = numbered.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")) & (F.col("slice") == F.col("_p")), "left")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset, rank = drawn("offset", F.col("source"), seed) / F.lit(4294967296.0), F.col("ahead") + F.col("n")
    copies = F.floor(each * rank + offset) - F.floor(each * (rank - 1) + offset)
    return numbered.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *[f"_c_{c}" for c in carry],
    )


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it has copies."""
    mixed = mix(docs, carry=tuple(docs.columns), **how).filter("copies > 0")
    mixed = mixed.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null/' || md5(coalesce(text, ''))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
c AS (SELECT *, CASE WHEN size < 16 THEN size ELSE CAST((len(bin(size)) - 1) * 8 + floor(size * 8 / pow(2.0, len(bin(size)) - 1)) - 8 + 100 AS BIGINT) END AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS top FROM s),
r AS (SELECT *, row_number() OVER f AS k, 1.5::DOUBLE * sum(source_size) OVER () AS pool,
  coalesce(sum(top) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
  sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open_w
  FROM w WINDOW f AS (ORDER BY top / w, source NULLS LAST)),
b AS (SELECT *, min(CASE WHEN (pool - full_before) * w <= top * open_w THEN k END) OVER () AS first_k FROM r),
g AS (SELECT max(CASE WHEN k = first_k THEN full_before END) AS first_full, max(CASE WHEN k = first_k THEN open_w END) AS first_open FROM b),
t AS (SELECT source, source_size, CASE WHEN first_k IS NULL OR k < first_k THEN top ELSE least(top, (pool - first_full) * w / first_open) END AS target FROM b, g),
n AS (SELECT c.*, t.source_size, t.target,
  CAST('0x' || substr(md5('17/slice/' || key), 1, 8) AS BIGINT)
    % CAST(ceil(count(*) OVER (PARTITION BY c.source, class) / 20000.0) AS BIGINT) AS slice
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, doc_id NULLS FIRST, key) AS rnk,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
  CAST('0x' || substr(md5('17/offset/' || coalesce(source, chr(0) || 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS off
  FROM n)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(floor(each * rnk + off) - floor(each * (rnk - 1) + off) AS BIGINT) AS copies,
  CAST((floor(each * rnk + off) - floor(each * (rnk - 1) + off)) * size AS BIGINT) AS taken
FROM k
"""
