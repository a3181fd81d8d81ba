"""A corpus of edge cases, and laws of scans, pages and counts."""

import pytest
from pyspark.sql import functions as F

from timberline.functions import fields
from timberline.functions import predicates as P
from timberline.functions.text import analyse
from timberline.operators import review as R
from timberline.operators.classify import classify
from timberline.operators.entries import parse, quarantine, with_date_key
from timberline.plans.log_entries import log_entries
from timberline.sources import scan, sinks

HEAD = "2020-04-29 10:11:12.345 +0000 [main] 12 INFO  com.acme.start.App - "


def entries(spark, tmp_path, data: bytes, name="a.log"):
    (tmp_path / name).write_bytes(data)
    return parse(scan.number_lines(scan.scan_dir(spark, str(tmp_path)))).orderBy("line_number").collect()


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_lines_and_continuations(spark, tmp_path, end):
    text = end.join(["before one", "before two", HEAD + "first", "  more", "20 things", HEAD + "second \t", ""])
    first, second = entries(spark, tmp_path, text.encode())
    assert (first.line_number, first.content) == (3, "before one\nbefore two\nfirst\n  more\n20 things")
    assert (second.line_number, second.content, second.channel, second.elapsed_ms, second.level, second.source) == (6, "second", "main", 12, "INFO", "com.acme.start.App")


def test_no_header_empty_file_and_bom(spark, tmp_path):
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "none.log").write_bytes(b"no header\nat all\n")
    (found,) = entries(spark, tmp_path, b"\xef\xbb\xbf" + (HEAD + "x\n").encode())
    assert (found.file_name, found.content) == ("a.log", "x")


@pytest.mark.parametrize(
    "line, channel, level, content",
    [
        (HEAD.replace("INFO ", "warn") + "x", "main", "warn", "x"),
        (HEAD.replace("[main]", "[a [b] c]") + "x", "a [b] c", "INFO", "x"),
        (HEAD + "a b", "main", "INFO", "a b"),
        (HEAD.replace(" +0000", " -0700") + "x", "main", "INFO", "x"),
    ],
)
def test_headers(spark, tmp_path, line, channel, level, content):
    (e,) = entries(spark, tmp_path, line.encode())
    assert (e.channel, e.level, e.content) == (channel, level, content)


def test_a_source_with_a_hyphen_is_no_header(spark, tmp_path):
    (e,) = entries(spark, tmp_path, (HEAD + "x\n" + HEAD.replace("com.acme.start.App", "com.a-b") + "y").encode())
    assert e.content.startswith("x\n2020-04-29")


def test_rejects(spark, tmp_path):
    lines = [HEAD.replace(".345", ".34") + "a", HEAD.replace(".345", ".3456") + "b", HEAD.replace(" 12 ", " 12345678901234567890 ") + "c", HEAD + "d"]
    (tmp_path / "a.log").write_text("\n".join(lines))
    good, bad = quarantine(parse(scan.number_lines(scan.scan_dir(spark, str(tmp_path)))))
    assert [r.content for r in good.collect()] == ["d"]
    assert sorted(r.content for r in bad.collect()) == ["a", "b", "c"]


def test_offsets_and_days(spark):
    df = spark.createDataFrame([("2020-04-29 20:00:00.000 -0700",), ("2020-04-30 03:00:00.000 +0000",)], "s string").select(fields.parse_timestamp("s").alias("ts"))
    assert len({(r.ts, r.date_key) for r in with_date_key(df).collect()}) == 1


def test_splits_do_not_matter(spark, tmp_path):
    text = "\n".join(HEAD + f"entry {i}" + "\nmore" * (i % 5) for i in range(400))
    (tmp_path / "a.log").write_text("top\n" + text)
    (tmp_path / "b.log").write_text(text)

    def read():
        return sorted((r.file_name, r.line_number, r.content) for r in parse(scan.number_lines(scan.scan_dir(spark, str(tmp_path)))).collect())

    whole = read()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert read() == whole and len(whole) == 800
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_brief_flags_and_filetime(spark):
    df = spark.createDataFrame([("x" * 500, ""), ("y" * 501, "a b")], "content string, text string")
    a, b = df.select(fields.content_brief().alias("b"), fields.flags_from_text("text").alias("f")).collect()
    assert (a.b, a.f) == ("x" * 500, []) and (b.b, b.f) == ("y" * 499 + "....", ["a", "b"])


def test_job_paths(spark):
    hexed = "0123456789ABCDEF" * 2
    df = spark.createDataFrame([(f"/x/job-{hexed}/a.log",), (f"/x/JOB-{hexed}/a.log",)], "file_path string")
    df = df.withColumns({c: F.lit("-") for c in ("source", "content", "channel")})
    assert [r.flags for r in classify(df).collect()] == [["worker_log"], []]


def test_laws(spark, tmp_path):
    e = analyse(classify(log_entries(spark, "/root/testdata/sf0.001")).withColumn("date_key", fields.date_key("ts")), ("content",)).cache()
    p = P.general_errors()
    assert e.filter(p).count() + e.filter(~p).count() == e.count()
    counts = R.level_counts(e, p).first()
    assert sum(counts[x] for x in ("info", "warn", "error", "debug", "trace")) == counts["hits"]
    pages = [r.id for k in range(0, 1000, 250) for r in R.page(e, k, 250).collect()]
    assert pages == [r.id for r in R.order_chrono(e).collect()]
    sinks.export_log(e, str(tmp_path / "out"))
    back = quarantine(parse(scan.number_lines(scan.scan_dir(spark, str(tmp_path / "out"), "part-*"))))[0]
    same = ["ts", "channel", "elapsed_ms", "level", "source", "content"]
    assert sorted(map(tuple, back.select(same).collect())) == sorted(map(tuple, e.select(same).collect()))


def test_wildcard_may_not_stand_first():
    with pytest.raises(ValueError):
        P.wildcard("*x")


def test_places_in_any_zone(spark):
    """Orders count by their own leading columns, whatever the session's zone calls a day."""
    from timberline.operators.order import numbered

    e = classify(log_entries(spark, "/root/testdata/sf0.001"))
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("America/Los_Angeles", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = e.withColumn("date_key", fields.date_key("ts")).select("id", *R.BY_DAY)
            plain = sorted(rows.collect(), key=lambda r: (r.date_key, r.line_number, r.file_path, r.id))
            assert {r.id: r["rank"] for r in numbered(rows, *R.BY_DAY, "id").collect()} == {r.id: k + 1 for k, r in enumerate(plain)}
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_entries_hold_whole_texts(spark):
    """Words at the end of long texts are found, and long runs of lines come back from log text as they were."""
    from timberline.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 600").select("text").collect()}
    assert len(texts & {r.content for r in QUERIES["stitch_entries"](spark, sf).collect()}) > 0.9 * len(texts)


def test_phrases_with_slop(spark):
    df = analyse(spark.createDataFrame([(1, "red green blue"), (2, "blue x green red"), (3, "red a b c d e f g h green blue"), (4, "red blue"), (5, None), (6, "")], "id long, content string"), ("content",))
    found = lambda *a, **k: [r.id for r in df.filter(P.phrase(*a, **k)).orderBy("id").collect()]
    assert found("red green blue") == [1] and found("red green blue", slop=2) == [1] and found("red green blue", slop=5) == [1, 2] and found("red green blue", slop=9) == [1, 2, 3]
    assert found("the red") == [1, 2, 3, 4] and found("red blue") == [4] and found("the") == []


def test_a_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from timberline.sources.store import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_postings_of_odd_rows(spark):
    """Null lists, null slots, repeated words, and entries that share none."""
    rows = [(1, ["b", None, "a", "b"], []), (2, None, ["f"]), (3, [], None), (4, ["a"], ["f", "g"]), (5, [None], [])]
    df = spark.createDataFrame(rows, "id long, content_tokens array<string>, flags array<string>").coalesce(1)
    from timberline.functions.text import postings, with_term

    posted = postings(df, ("content",))
    assert sorted(map(tuple, posted.collect())) == [("content", "a", 1, [3]), ("content", "a", 4, [1]), ("content", "b", 1, [1, 4]), ("flag", "f", 2, [1]), ("flag", "f", 4, [1]), ("flag", "g", 4, [2])]
    assert sorted(r.id for r in with_term(df, posted, "A").collect()) == [1, 4] and [r.id for r in with_term(df, posted, "g", "flag").collect()] == [4]
    assert postings(df.filter("false"), ("content",)).count() == 0


def test_possessives_and_acronyms(spark):
    from timberline.functions.text import tokens, words_of

    text = "The dog's end. U.S.A. and u.s. (com.acme.add.i) v1.2.3. x.y a. it's o'neil's 3,5. www.host.org."
    (got,) = spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("t")).first()
    assert got == words_of(text) == [None, "dog", "end", "usa", None, "us", "com.acme.add.i", "v1.2.3", "x.y", None, None, "o'neil", "3,5", "www.host.org"]
