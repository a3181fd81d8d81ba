"""Loads keep each different content once, and carry none of them through orders and shuffles."""

from pathlib import Path

from pyspark.sql import functions as F

from timberline.operators import dims as D
from timberline.sources import scan, sinks
from timberline.sources.store import contents_path, written


def rows(spark, start, end):
    """Entries of five different contents and one without, and the step that adds contents."""
    texts = spark.range(6).select(F.col("id").alias("text"), F.expr("if(id < 5, repeat(sha2(string(id), 256), 200), null)").alias("content"))
    named = {c: F.concat(F.lit(c), F.col("line_number") % 3) for c in ("file_path", "channel", "level", "source")}
    e = spark.range(start, end).select(F.col("id").alias("line_number"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("elapsed_ms"), (F.col("id") % 6).alias("text"), F.array(F.lit("f")).alias("flags"), F.floor(F.col("id") / 200).alias("date_key")).withColumns(named)
    return e, texts


def shown(df):
    return sorted((r.line_number, r.content, r.id) for r in df.collect())


def test_contents_are_written_once(spark, tmp_path):
    e, texts = rows(spark, 0, 600)
    join = lambda r: r.join(texts, "text").drop("text")
    expected = {r.line_number: r.content for r in join(e).collect()}
    for k, with_key in enumerate((False, True)):
        given, whole = (e.join(texts.select("text", sinks.content_key("content").alias("content_key")), "text"), join) if with_key else (join(e), lambda r: r)
        at = str(tmp_path / f"e{k}")
        sinks.load_replace(given.filter("line_number < 100"), at, whole)
        sinks.load_replace(given.filter("line_number < 300"), at, whole)
        sinks.load_append(spark, given.filter("line_number >= 300"), at, whole)
        assert spark.read.parquet(contents_path(at)).count() == 5 and "content" not in spark.read.parquet(at).columns
        got = shown(scan.read_entries(spark, at))
        assert {n: c for n, c, _ in got} == expected and len(got) == 600 and sorted(i for *_, i in got) == list(range(1, 601))
        some = D.fetch_by_ids(scan.read_entries(spark, at, [7, 311, 9999]), [7, 311, 9999])
        assert shown(some) == [r for r in got if r[2] in (7, 311)] and scan.read_entries(spark, at, []).count() == 0


def test_a_star_keeps_contents_once(spark, tmp_path):
    e, texts = rows(spark, 0, 600)
    whole = e.join(texts, "text").drop("text")
    sinks.load_star(spark, whole.filter("line_number < 300"), str(tmp_path / "s"))
    sinks.load_star(spark, whole.filter("line_number >= 300"), str(tmp_path / "s"))
    fact, dims = sinks.read_star(spark, str(tmp_path / "s"))
    assert spark.read.parquet(contents_path(str(tmp_path / "s/fact"))).count() == 5
    assert {r.line_number: r.content for r in D.decode_fact(fact, dims).collect()} == {r.line_number: r.content for r in whole.collect()}
    assert fact.count() == 600 and dims["file_id"].count() == 3


def test_a_written_table_leaves_no_shuffle(spark):
    def left():
        return sum(f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))

    before = left()
    table = written(spark.range(200_000).select(F.rand(1).alias("x")).repartition(3, "x"), "rows")
    assert table.count() == 200_000 and left() - before < 100_000


def test_entries_of_a_text_that_comes_twice(spark, tmp_path):
    """What is joined to an entry twice makes two rows of it, each with the content that its key names; contents stay once."""
    e, texts = rows(spark, 0, 60)
    twice = texts.unionByName(texts.filter("text = 1"))
    twice = twice.unionByName(spark.createDataFrame([(2, "another")], "text long, content string"))
    join = lambda r: r.join(twice, "text").drop("text")
    keyed = e.join(twice.select("text", sinks.content_key("content").alias("content_key")).distinct(), "text")
    sinks.write_entries(keyed.withColumn("id", F.col("line_number")), str(tmp_path / "e"), whole=join)
    found = scan.read_entries(spark, str(tmp_path / "e"))
    sizes = {(r.line_number % 6, r.content): r["count"] for r in found.groupBy("line_number", "content").count().collect()}
    long = {r.text: r.content for r in texts.collect()}
    assert sizes == {(0, long[0]): 1, (1, long[1]): 2, (2, long[2]): 2, (2, "another"): 2, (3, long[3]): 1, (4, long[4]): 1, (5, None): 1}
    assert spark.read.parquet(contents_path(str(tmp_path / "e"))).count() == 6
