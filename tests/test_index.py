"""The stored index and what loads leave: against scans, plain versions, and what is read."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from timberline.functions import predicates as P
from timberline.functions.fields import header
from timberline.functions.text import analyse, words_of
from timberline.operators import dims as D
from timberline.operators import index as I
from timberline.operators import review as R
from timberline.sources import sinks


def scan_metric(df, name):
    """A figure of the plan's file scans, after ``df`` has been collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    total, leaves = 0, plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.plan() if "QueryStage" in leaf.getClass().getName() else leaf
        inner = leaf.collectLeaves()
        for j in range(inner.size()):
            found = inner.apply(j).metrics().get(name)
            total += found.get().value() if found.isDefined() else 0
    return total


WORDS = ["error", "exception", "excepted", "state", "stat", "the", "a", "de", "red", "redd", "server", "x1", "v1.2", "ab", "b", "straße", "漢", "字"]


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(8)
    levels = ["INFO", "warn", "ERROR", "DEBUG", "TRACE"]
    rows = [(k * 37 % 1000 + 1, " ".join(rng.choices(WORDS, k=rng.randint(0, 14))), rng.choice(levels), rng.choice([[], ["f"], ["f", "G"], None]), k % 9, 20200101 + k % 3) for k in range(300)]
    rows += [(2001, None, None, None, None, None), (None, "error de", "INFO", ["f"], 1, 20200101), (2002, "漢字 red the state's U.S.A.", "INFO", ["f"], 1, 20200101), (2003, "", "INFO", [], 1, 20200101)]
    df = spark.createDataFrame(rows, "id long, content string, level string, flags array<string>, line_number long, date_key long")
    return analyse(df, ("content", "level")).cache()


@pytest.fixture(scope="module")
def index(spark, entries, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "i")
    I.build(entries, at, ("content", "level"))
    return I.opened(spark, at)


def both(name, *args, **how):
    return getattr(I, name)(*args, **how), getattr(P, name)(*args, **how)


@pytest.mark.parametrize(
    "search",
    [
        lambda: both("term", "ERROR"), lambda: both("term", "f", "flag"), lambda: both("term", "g", "flag"), lambda: both("term", "the"), lambda: both("term", "U.S.A."), lambda: both("term", "State's"), lambda: both("term", "漢字"),
        lambda: both("any_term", ["de", "the", "red state"]), lambda: both("phrase", "state the error"), lambda: both("phrase", "de de"), lambda: both("phrase", "the"), lambda: both("phrase", "no such words"), lambda: both("phrase", "red error", slop=3),
        lambda: both("phrase", "de de de", slop=4), lambda: both("phrase", "de red de", slop=2), lambda: both("prefix", "Exc"), lambda: both("prefix", ""), lambda: both("wildcard", "e?c*d"), lambda: both("text_range", "red", "state"), lambda: both("text_range", "red", "state", inclusive=False),
        lambda: both("fuzzy", "exceptoin", least=0.7), lambda: both("fuzzy", "exception", least=0.2), lambda: both("fuzzy", "re", least=0.4), lambda: both("fuzzy", "strasse"), lambda: both("num_range", "line", 2, 5, inclusive=False), lambda: both("num_range", "id", None, 300), lambda: both("num_eq", "date", 20200102),
        lambda: both("everything"), lambda: both("general_errors"),
        lambda: tuple(~x for x in both("term", "de")), lambda: tuple(a & ~b for a, b in zip(both("term", "de"), both("prefix", "e"))), lambda: tuple(~(a | b) & ~c for a, b, c in zip(both("term", "de"), both("phrase", "red error", slop=3), both("term", "f", "flag"))),
    ],
)
def test_stored_searches_equal_scans(entries, index, search):
    clause, predicate = search()
    known = entries.filter("id is not null")
    expected = sorted(r.id for r in known.filter(predicate).select("id").collect())
    assert sorted(r.id for r in I.ids(index, clause).collect()) == expected
    assert tuple(I.count_hits(index, clause).first()) == (len(expected), known.count())
    assert I.level_counts(index, clause).first() == R.level_counts(known, predicate).first()


def test_saved_searches_and_found(entries, index):
    saved = {"a": I.term("de"), "b": ~I.term("de"), "none": I.nothing()}
    hits = {r["name"]: r["hits"] for r in I.saved_counts(index, saved).collect()}
    assert hits["a"] + hits["b"] == entries.filter("id is not null").count() and hits["none"] == 0
    assert {r.id for r in I.found(index, entries, I.term("state")).collect()} == {r.id for r in entries.filter("id is not null").filter(P.term("state")).collect()}


def test_parts_are_the_same_on_both_sides(spark):
    for word in ("", "a", "ab", "straße", "exception"):
        assert sorted(spark.createDataFrame([(word,)], "w string").select(I._parts(F.col("w")).alias("p")).first()["p"]) == I.parts_of(word)


def test_an_empty_index(spark, entries, tmp_path):
    I.build(entries.limit(0), str(tmp_path / "i"), ("content", "level"))
    index = I.opened(spark, str(tmp_path / "i"))
    for clause in (I.everything(), ~I.term("x"), I.phrase("a b c"), I.fuzzy("word"), I.wildcard("a*")):
        assert I.ids(index, clause).collect() == [] and tuple(I.count_hits(index, clause).first()) == (0, 0)


def placed(tokens, wanted, slop):
    spots = [[i for i, t in enumerate(tokens) if t == w] for _, w in wanted]
    for at in itertools.product(*spots):
        shifts = [p - o for p, (o, _) in zip(at, wanted)]
        if len(set(at)) == len(at) and max(shifts) - min(shifts) <= slop:
            return True
    return False


def test_slop_against_all_assignments(spark):
    rng = random.Random(9)
    texts = ["exception", "exception exception", *[" ".join(rng.choices(["p", "q", "r", "z", "y", "the"], k=rng.randint(1, 12))) for _ in range(400)]]
    df = analyse(spark.createDataFrame(list(enumerate(texts)), "id long, content string"), ("content",)).cache()
    for text, slop in (("exception exception", 1), ("p p", 1), ("p p", 3), ("p q p", 2), ("p the q", 1), ("q p p r", 3), ("p p p", 5), ("r z q", 8)):
        wanted = [(o, w) for o, w in enumerate(words_of(text)) if w is not None]
        expected = [i for i, t in enumerate(texts) if placed([None if w == "the" else w for w in t.split()], wanted, slop)]
        assert [r.id for r in df.filter(P.phrase(text, slop=slop)).orderBy("id").collect()] == expected, (text, slop)


def test_searched_words_are_analysed(spark):
    df = analyse(spark.createDataFrame([(1, "the server's down in U.S.A. today AWT-EventQueue-0"), (2, "server"), (3, "queue awt 日本語")], "id long, content string"), ("content",))
    found = lambda p: [r.id for r in df.filter(p).orderBy("id").collect()]
    assert found(P.term("Server's")) == [1, 2] and found(P.term("U.S.A.")) == [1] and found(P.term("AWT-EventQueue-0")) == [1] and found(P.term("the")) == [1, 2, 3]
    assert found(P.term("日本")) == [3] and found(P.term("語")) == [3] and found(P.term("日語")) == [] and found(P.any_term(["down", "日本", "of"])) == [1, 3]


def test_terms_prefixes_and_ranges_read_few_files(spark, tmp_path):
    words = spark.range(40000).select(F.col("id"), F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" every")).alias("content"), F.lit("INFO").alias("level"), F.array().cast("array<string>").alias("flags"), F.lit(1).cast("long").alias("line_number"), F.lit(1).cast("long").alias("date_key"))
    with_parts = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        I.build(analyse(words, ("content", "level")), str(tmp_path / "i"), ("content", "level"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    index = I.opened(spark, str(tmp_path / "i"))
    for table in (index.dictionary, index.postings, index.bitmaps):
        files, total = len(table.inputFiles()), table.count()
        assert files >= 12
        for where in (F.col("term") == "w020000", F.col("term").startswith("w02000"), F.col("term").between("w020000", "w020100")):
            assert scan_metric(table.filter((F.col("field") == "content") & where), "numOutputRows") <= 4 * total / files
    assert I.count_hits(index, I.prefix("w02000")).first()["hits"] == 10 and I.count_hits(index, I.term("every")).first()["hits"] == 40000
    # a term that all entries have is cut by id
    held = [r["n"] for r in index.postings.filter("term = 'every'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(held) > 3 and max(held) < 20000


def test_far_pages_read_no_more(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(500))).alias("ts"), F.concat(F.lit("f"), F.col("id") % 3).alias("file_path"), F.col("id").alias("line_number"))
    R.store_order(rows, str(tmp_path / "o"), rows=400)
    expected = [r.id for r in R.order_chrono(rows).collect()]
    read = {}
    for start in (0, 390, 4700, 4990):
        page = R.stored_page(spark, str(tmp_path / "o"), start, 100)
        read[start] = scan_metric(page, "numFiles")
        assert [(r.place, r.id) for r in page.collect()] == list(enumerate(expected))[start : start + 100]
    assert read[4700] <= read[390] and max(read.values()) <= 6


def test_fetched_ids_skip_row_groups(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") * 7 % 4000).alias("id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("line_number"), F.floor(F.col("id") / 500).alias("date_key"))
    sinks.write_entries(rows.repartition(8), str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert len(stored.inputFiles()) >= 3
    found = D.fetch_by_ids(stored, [77, 1234, 99999])
    assert [r.id for r in found.collect()] == sorted([77, 1234], key=lambda i: i * pow(7, -1, 4000) % 4000)
    assert scan_metric(D.fetch_by_ids(stored, [77]), "numOutputRows") <= 4000 / 2
    assert D.fetch_by_ids(stored, []).count() == 0 and D.fetch_by_ids(stored, list(range(25))).count() == 25


def test_frequent_values_fill_no_task(spark):
    rows = spark.range(20000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 2000)).alias("value"))
    dim = D.dimension(rows, "value").withColumnsRenamed({"id": "key"})
    joined = D._joined(rows, dim, "value", 1)
    assert joined.count() == 20000 and joined.filter("key is null").count() == 0
    spots = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # rows of the frequent value stay in the scan's tasks; others are dealt out by value
        sizes = [r["n"] for r in D._joined(rows, dim, "value", 1).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 20000 * 0.4 and int(spots) >= 4


def test_dimensions_go_on(spark):
    first = spark.createDataFrame([(1, "b", "x"), (2, "a", "x"), (3, "b", None)], "id long, c string, d string")
    second = spark.createDataFrame([(4, "c", "x"), (5, "a", "w"), (6, "0", "x"), (7, None, "x")], "id long, c string, d string")
    columns = {"c_id": "c", "d_id": "d"}
    one = D.dimensions(first, None, columns)
    two = D.dimensions(second, one, columns)
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(one["c_id"]) == [(1, "b"), (2, "a")] and got(two["c_id"]) == [(1, "b"), (2, "a"), (3, "c"), (4, "0")]
    assert got(two["d_id"]) == [(1, "x"), (2, "w")] and got(D.dimensions(second.limit(0), one, columns)["c_id"]) == got(one["c_id"])


@pytest.mark.parametrize(
    "line, fields",
    [
        ("2020-04-29 10:11:12.345 +0000 [main] 12 INFO  a.B - x", ("main", "12", "INFO", " a.B", "x")),
        ("2020-04-29 10:11:12.345\t+0000\t[main]\t12\twarn\ta.B\t-\tx - y", ("main", "12", "warn", "a.B", "x - y")),
        ("2020-04-29 10:11:12.345 0000 [a] 1 INFO b - c] 2 ERROR d - e", ("a] 1 INFO b - c", "2", "ERROR", "d", "e")),
        ("2020-04-29 10:11:12.345 -0000 [a\\b] 1 INFO c - d", None), ("2020-04-29 10:11:12.345 +0000 [a] 1 INFO c-d - e", None), ("2020-04-29 10:11:12.345 +0000 [] 1 INFO c - d", None),
        ("2020-04-29 10:11:12. +0000 [a] 1 INFO c - d", None), ("2020-04-29T10:11:12.345 +0000 [a] 1 INFO c - d", None), ("2020-04-29 10:11:12.345 +0000 [a] 1 INFOS c - d", None), ("2020-04-29 10:11:12.345 +0000 [a] x INFO c - d", None),
        ("2020-04-29 10:11:12.345 +0000 [a] 1 INFO c -d", None), ("2020-04-29 10:11:12.345 +0000 [a]1 INFO c - d", None), ("20 things", None), ("", None), (None, None), ("2020-04-29 10:11:12.345 +0000 [a] 1 TRACE b - ", ("a", "1", "TRACE", "b", "")),
    ],
)
def test_headers_by_position(spark, line, fields):
    head = spark.createDataFrame([(line,)], "value string").select(header("value").alias("h")).first()["h"]
    got = None if head is None else tuple(head)[1:]
    assert (got and (got[0], got[1], got[2], got[3].strip(), got[4])) == (fields and (fields[0], fields[1], fields[2], fields[3].strip(), fields[4]))
