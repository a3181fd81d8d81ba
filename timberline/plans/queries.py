"""The registered queries, and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import fields, text
from timberline.functions import predicates as P
from timberline.operators import classify as C
from timberline.operators import dims as D
from timberline.operators import entries as E
from timberline.operators import review as R
from timberline.operators import texts as T
from timberline.operators.order import numbered
from timberline.plans.log_entries import FLAGS_SQL, analysed, flagged, flagged_rows, loaded, log_entries, of_logs, original_path, parsed, rendered, sql
from timberline.plans.registry import QUERIES, SQL, query
from timberline.schema import ACRONYM, LONE, STOP_WORDS, TOKEN
from timberline.sources import scan, sinks
from timberline.sources.store import workspace


def ms() -> Column:
    return F.unix_millis("ts").alias("ts_ms")


FIELDS = ["file_path", "line_number", "ts_ms", "channel", "elapsed_ms", "level", "source", "content"]


# --- scans -----------------------------------------------------------------------------------------------------------

_LINES = (
    "lines AS (SELECT file_path, file_name, line_number + k AS line_number, text FROM (SELECT file_path, file_name, line_number, generate_subscripts(parts, 1) - 1 AS k, unnest(parts) AS text FROM ("
    " SELECT file_path, file_name, line_number, string_split(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' +0000 [' || channel || '] ' || elapsed_ms || ' ' || rpad(level, 5, ' ') || ' ' || source || ' - ' || content, chr(10)) AS parts FROM log_entries)))"
)


@query(sql("SELECT file_path, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines GROUP BY file_path", _LINES))
def scan_files(spark, sf):
    """A list of paths, with patterns; empty files among them give no lines."""
    at = rendered(spark, sf)
    lines = scan.with_provenance(scan.scan_files(spark, [f"{at}/dir=main/*/part-*", f"{at}/dir=job-*/*/part-*"])).withColumn("file_path", original_path(F.col("file_path")))
    return lines.groupBy("file_path").agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query(sql("SELECT file_name, count(*) AS n_lines FROM lines GROUP BY file_name", _LINES))
def scan_dir(spark, sf):
    lines = scan.scan_dir(spark, rendered(spark, sf), "part-*")
    return lines.groupBy(F.regexp_extract("file_path", "/file_name=([^/]*)/", 1).alias("file_name")).agg(F.count("*").alias("n_lines"))


@query(sql("SELECT file_path, line_number, md5(text) AS text_md5 FROM lines", _LINES))
def number_lines(spark, sf):
    return of_logs(spark, sf, lambda lines: lines.select(original_path(F.col("file_path")).alias("file_path"), "line_number", F.md5(F.col("value").cast("binary")).alias("text_md5")))


@query(sql("SELECT file_path, file_name, count(*) AS n FROM log_entries GROUP BY ALL"))
def provenance(spark, sf):
    return parsed(spark, sf, lambda rows: rows.groupBy("file_path", "file_name").agg(F.count("*").alias("n")))


@query(sql("SELECT id, file_path, line_number, ts_ms, level, array_to_string(flags, ' ') AS flags FROM flagged"))
def read_entries(spark, sf):
    at = workspace(spark, "entries")
    e, whole = flagged_rows(spark, sf)
    sinks.write_entries(e, at, whole=whole)
    return scan.read_entries(spark, at).select("id", "file_path", "line_number", ms(), "level", fields.flags_to_text().alias("flags"))


# --- entries ---------------------------------------------------------------------------------------------------------


@query(sql("SELECT file_path, count(*) FILTER (is_header) AS headers, count(*) FILTER (NOT is_header) AS others FROM (SELECT file_path, line_number IN (SELECT line_number FROM log_entries e WHERE e.file_path = l.file_path) AS is_header FROM lines l) GROUP BY file_path", _LINES))
def detect_headers(spark, sf):
    def counted(lines: DataFrame) -> DataFrame:
        lines = E.detect_headers(lines).groupBy(original_path(F.col("file_path")).alias("file_path"))
        return lines.agg(F.count_if("is_header").alias("headers"), F.count_if(~F.col("is_header")).alias("others"))

    return of_logs(spark, sf, counted)


@query(sql(f"SELECT {', '.join(FIELDS)} FROM log_entries"))
def parse_fields(spark, sf):
    return parsed(spark, sf, lambda rows: rows.select(ms(), *[c for c in FIELDS if c != "ts_ms"]))


@query(sql("SELECT file_path, line_number, content FROM log_entries"))
def stitch_entries(spark, sf):
    return parsed(spark, sf, lambda rows: rows.select("file_path", "line_number", "content"))


@query(sql("SELECT file_path, line_number, CASE WHEN line_number = first THEN 'a preamble' || chr(10) || 'of two lines' || chr(10) || content ELSE content END AS content FROM (SELECT *, min(line_number) OVER (PARTITION BY file_path) AS first FROM log_entries)"))
def stitch_preamble(spark, sf):
    """Every file gets two lines before its first header; they go before that entry's content, and its line moves by two."""

    def stitched(lines: DataFrame) -> DataFrame:
        ahead = lines.groupBy("file_path", "file_name").agg(F.min("block").alias("block")).select("file_path", "file_name", "block", F.posexplode(F.array(F.lit("a preamble"), F.lit("of two lines"))).alias("k", "value"))
        ahead = ahead.select("file_path", "file_name", "block", "value", (F.col("k") + 1).cast("long").alias("line_number"))
        both = lines.withColumn("line_number", F.col("line_number") + 2).select(*ahead.columns).unionByName(ahead)
        return E.stitch(E.detect_headers(both)).select(original_path(F.col("file_path")).alias("file_path"), (F.col("line_number") - 2).alias("line_number"), "content")

    return of_logs(spark, sf, stitched)


@query(sql("SELECT file_path, line_number, ts_ms FROM log_entries"))
def parse_timestamp(spark, sf):
    return parsed(spark, sf, lambda rows: rows.select("file_path", "line_number", ms()))


@query(sql("SELECT file_path, line_number, elapsed_ms FROM log_entries"))
def parse_elapsed(spark, sf):
    return parsed(spark, sf, lambda rows: rows.select("file_path", "line_number", "elapsed_ms"))


@query(sql("SELECT id % 10 = 3 AS rejected, count(*) AS n, CAST(sum(line_number) AS BIGINT) AS lines FROM log_entries GROUP BY ALL"))
def quarantine(spark, sf):
    """Every tenth header gets an elapsed time that doesn't fit or a short fraction of a second; all others stay entries."""
    e = log_entries(spark, sf)
    line = fields.to_log_line()
    broken = F.when(F.col("id") % 20 == 3, F.regexp_replace(line, r"\] \d+ ", "] 99999999999999999999 ")).when(F.col("id") % 20 == 13, F.regexp_replace(line, r"^(\S+ \S+\.\d\d)\d ", "$1 ")).otherwise(line)
    lines = e.select("file_path", "file_name", F.lit(0).cast("long").alias("block"), "line_number", F.posexplode(F.split(broken, "\n")).alias("k", "value")).withColumn("line_number", F.col("line_number") + F.col("k")).drop("k")
    good, bad = E.quarantine(E.parse(lines))
    both = good.select("line_number", F.lit(False).alias("rejected")).unionByName(bad.select("line_number", F.lit(True).alias("rejected")))
    return both.groupBy("rejected").agg(F.count("*").alias("n"), F.sum("line_number").alias("lines"))


# --- fields ----------------------------------------------------------------------------------------------------------


@query(sql("SELECT id, date_key FROM log_entries"))
def date_key(spark, sf):
    return log_entries(spark, sf).select("id", fields.date_key("ts").alias("date_key"))


_BRIEF = "replace(replace(content, chr(10), ' '), chr(13), '')"
_BRIEF = f"CASE WHEN length({_BRIEF}) > 500 THEN substr({_BRIEF}, 1, 499) || '....' ELSE {_BRIEF} END"


@query(sql(f"SELECT id, {_BRIEF} AS content_brief FROM log_entries"))
def content_brief(spark, sf):
    return log_entries(spark, sf).select("id", fields.content_brief().alias("content_brief"))


_LINE = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' +0000 [' || channel || '] ' || elapsed_ms || ' ' || rpad(level, 5, ' ') || ' ' || source || ' - ' || content"


@query(sql(f"SELECT id, {_LINE} AS line FROM log_entries"))
def to_log_line(spark, sf):
    return log_entries(spark, sf).select("id", fields.to_log_line().alias("line"))


_FILES = "dim AS (SELECT file_path, row_number() OVER (ORDER BY min(id)) AS file_id FROM log_entries GROUP BY file_path)"


@query(sql("SELECT id, file_name || '(' || file_id || ')' AS label FROM log_entries JOIN dim USING (file_path)", _FILES))
def file_label(spark, sf):
    e = log_entries(spark, sf)
    dim = D.dimension(e, "file_path").select(F.col("id").alias("file_id"), F.col("value").alias("file_path"))
    return e.join(dim, "file_path").select("id", fields.file_label("file_name", "file_id").alias("label"))


@query(sql("SELECT id, array_to_string(flags, ' ') AS flags FROM flagged"))
def flags_to_text(spark, sf):
    return flagged(spark, sf).select("id", fields.flags_to_text().alias("flags"))


@query(sql("SELECT id, CAST(len(flags) AS BIGINT) AS n_flags, coalesce(flags[1], '-') AS first_flag FROM flagged"))
def flags_from_text(spark, sf):
    back = fields.flags_from_text(fields.flags_to_text())
    return flagged(spark, sf).select("id", F.size(back).cast("long").alias("n_flags"), F.coalesce(F.try_element_at(back, F.lit(1)), F.lit("-")).alias("first_flag"))


@query(sql("SELECT id, (ts_ms * 1000 + 11644473600000000) * 10 AS ticks, ts_ms FROM log_entries"))
def filetime(spark, sf):
    e = log_entries(spark, sf).select("id", fields.to_filetime().alias("ticks"))
    return e.select("id", "ticks", F.unix_millis(fields.from_filetime("ticks")).alias("ts_ms"))


@query(sql(f"SELECT file_name || '(' || file_id || ')' AS file, line_number, ts_ms, {_BRIEF} AS brief FROM log_entries JOIN dim USING (file_path)", _FILES))
def grid_view(spark, sf):
    e = log_entries(spark, sf)
    dim = D.dimension(e, "file_path").select(F.col("id").alias("file_id"), F.col("value").alias("file_path"))
    return e.join(dim, "file_path").select(fields.file_label("file_name", "file_id").alias("file"), "line_number", ms(), fields.content_brief().alias("brief"))


@query(sql(f"SELECT id, {', '.join(FIELDS)}, date_key, array_to_string(flags, ' ') AS flags FROM flagged WHERE id = 51"))
def entry_detail(spark, sf):
    return flagged(spark, sf).filter("id = 51").select("id", ms(), *[c for c in FIELDS if c != "ts_ms"], "date_key", fields.flags_to_text().alias("flags"))


# --- flags -----------------------------------------------------------------------------------------------------------

_KEYS = {"problem_processing_item": "flag_problem_item", "session_is_closed": "flag_session_closed"}


def _flag(flag: str) -> None:
    @query(sql(f"SELECT id, {FLAGS_SQL[flag]} AS found FROM log_entries"), _KEYS.get(flag, f"flag_{flag}"))
    def run(spark, sf):
        return log_entries(spark, sf).select("id", dict(C.rules())[flag].alias("found"))


for _f in FLAGS_SQL:
    _flag(_f)


@query(sql("SELECT id, array_to_string(flags, ' ') AS flags FROM flagged"))
def classify(spark, sf):
    return C.classify(log_entries(spark, sf)).select("id", fields.flags_to_text().alias("flags"))


@query(sql(
    "SELECT id, concat_ws(' ', CASE WHEN lower(level) = 'error' AND id % 2 = 0 THEN 'even_error' END, CASE WHEN elapsed_ms > 5000 THEN 'level_' || lower(level) END, CASE WHEN elapsed_ms > 5000 THEN 'slow' END) AS flags FROM log_entries"))
def classify_custom(spark, sf):
    """User rules: a predicate, and a pandas UDF that gives any number of flags or none."""

    @F.pandas_udf("array<string>")
    def slow(elapsed: pd.Series, level: pd.Series) -> pd.Series:
        return pd.Series([["Slow", f"Level_{x}"] if e > 5000 else None for e, x in zip(elapsed, level, strict=True)])

    own = [("Even_Error", (F.lower("level") == "error") & (F.col("id") % 2 == 0)), (None, slow("elapsed_ms", "level"))]
    return C.classify(log_entries(spark, sf), own).select("id", fields.flags_to_text().alias("flags"))


# --- ids and dimensions ----------------------------------------------------------------------------------------------


@query(sql("SELECT 1000 + row_number() OVER (ORDER BY file_path, line_number) AS id, file_path, line_number FROM log_entries"))
def assign_ids(spark, sf):
    return D.assign_ids(log_entries(spark, sf).select("file_path", "line_number"), after=1000).select("id", "file_path", "line_number")


@query(sql("SELECT coalesce(max(id), 0) AS max_id, count(*) AS n FROM log_entries"))
def table_stats(spark, sf):
    return D.table_stats(log_entries(spark, sf))


def _dim(key: str, column: str) -> None:
    @query(sql(f"SELECT row_number() OVER (ORDER BY min(id)) AS id, {column} AS value FROM log_entries GROUP BY {column}"), key)
    def run(spark, sf):
        return D.dimension(log_entries(spark, sf), column)


for _k, _c in (("dim_file", "file_path"), ("dim_level", "level"), ("dim_source", "source"), ("dim_channel", "channel")):
    _dim(_k, _c)


_DIMS = [f"d_{c} AS (SELECT {c}, row_number() OVER (ORDER BY min(id)) AS {k} FROM log_entries GROUP BY {c})" for k, c in D.DIMENSIONS.items()]


@query(sql("SELECT id, line_number, file_id, ts_ms, channel_id, elapsed_ms, level_id, source_id, md5(content) AS content, array_to_string(flags, ' ') AS flags FROM flagged JOIN d_file_path USING (file_path) JOIN d_channel USING (channel) JOIN d_level USING (level) JOIN d_source USING (source)", *_DIMS))
def encode_fact(spark, sf):
    e = flagged(spark, sf)
    return D.encode_fact(e, D.dimensions(e)).withColumn("ts_ms", F.unix_millis("ts")).drop("ts").withColumn("content", F.md5(F.col("content").cast("binary")))


@query(sql("SELECT id, file_path, line_number, ts_ms, channel, elapsed_ms, level, source FROM log_entries"))
def star_join(spark, sf):
    e = flagged(spark, sf)
    dims = D.dimensions(e)
    return D.decode_fact(D.encode_fact(e, dims), dims).select("id", "file_path", "line_number", ms(), "channel", "elapsed_ms", "level", "source")


def _ranked(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*by)))


@query(sql("SELECT id, ts_ms, row_number() OVER (ORDER BY ts_ms, line_number, id) AS rank FROM log_entries WHERE id IN (3, 14, 15, 92, 65, 35)"))
def fetch_by_ids(spark, sf):
    return _ranked(D.fetch_by_ids(log_entries(spark, sf), [3, 14, 15, 92, 65, 35]), "ts", "line_number", "id").select("id", ms(), F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT id, row_number() OVER (ORDER BY ts_ms, line_number, id) AS rank FROM log_entries WHERE id IN (SELECT id FROM log_entries WHERE lower(level) = 'error')"))
def sort_id_set(spark, sf):
    e = log_entries(spark, sf)
    ids = e.filter(F.lower("level") == "error").select("id")
    return numbered(D.fetch_by_ids(e, ids).select("id", "ts", "line_number"), "ts", "line_number", "id").select("id", "rank")


# --- tokens ----------------------------------------------------------------------------------------------------------

_TOK = TOKEN.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens_sql(field: str) -> str:
    dotless = f"CASE WHEN regexp_matches(x, '{ACRONYM}') THEN replace(x, '.', '') ELSE substr(x, 1, length(x) - 1) END"
    words = f"list_transform(regexp_extract_all(regexp_replace(lower({field}), '({LONE})', ' \\1 ', 'g'), '{_TOK}'), lambda x: CASE WHEN ends_with(x, '.') THEN {dotless} WHEN ends_with(x, '''s') THEN substr(x, 1, length(x) - 2) ELSE x END)"
    return f"list_transform({words}, lambda x: CASE WHEN x IN ({_STOP}) THEN NULL ELSE x END)"


def _shown(tokens: Column) -> Column:
    return F.md5(F.array_join(tokens, " ", "_").cast("binary"))


def _counted_tokens(spark, sf: str, turned: Callable[[Column], Column]) -> DataFrame:
    """Each entry's number of tokens and their digest, which are made once for each document."""

    def shown(content: Column) -> Column:
        return fields.let(text.tokens(turned(content)), lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), _shown(t).alias("tokens_md5")))

    return log_entries(spark, sf, shown=shown).select("id", "shown.*")


@query(sql(f"SELECT id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(list_transform(t, lambda x: coalesce(x, '_')), ' ')) AS tokens_md5 FROM (SELECT id, {_tokens_sql('content')} AS t FROM log_entries)"))
def tokens_content(spark, sf):
    return _counted_tokens(spark, sf, lambda content: content)


@query(sql("SELECT id, " + ", ".join(f"array_to_string(list_transform({_tokens_sql(f)}, lambda x: coalesce(x, '_')), ' ') AS {f}" for f in ("channel", "level", "source")) + " FROM log_entries"))
def tokens_fields(spark, sf):
    return log_entries(spark, sf).select("id", *[F.array_join(text.tokens(f), " ", "_").alias(f) for f in ("channel", "level", "source")])


@query(sql("SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM flagged) GROUP BY flag"))
def tokens_flag(spark, sf):
    return flagged(spark, sf).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


_TERMS = "terms AS (SELECT field, id, term, pos FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT id, {_tokens_sql(f)} AS t FROM log_entries)" for f in text.TEXT_FIELDS) + " UNION ALL SELECT 'flag', id, unnest(flags), generate_subscripts(flags, 1) FROM flagged) WHERE term IS NOT NULL)"


@query(sql("SELECT field, term, count(DISTINCT id) AS df, count(*) AS n, min(pos) AS first_pos FROM terms GROUP BY field, term", _TERMS))
def postings(spark, sf):
    texts = T.apart(analysed(spark, sf, *text.TEXT_FIELDS))
    posted = T.weighed(T.postings_of(texts), texts)
    return posted.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum(F.size("positions") * F.col("n")).alias("n"), F.min(F.array_min("positions")).cast("long").alias("first_pos"))


@query(sql("SELECT field, term, count(DISTINCT id) AS df FROM terms GROUP BY field, term", _TERMS))
def document_frequency(spark, sf):
    texts = T.apart(analysed(spark, sf, *text.TEXT_FIELDS))
    return T.document_frequency(T.postings_of(texts), texts)


_CJK = "translate(content, 'aeo', '\u6f22\u30a2\u3072')"


@query(sql(f"SELECT id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(list_transform(t, lambda x: coalesce(x, '_')), ' ')) AS tokens_md5 FROM (SELECT id, {_tokens_sql(_CJK)} AS t FROM log_entries)"))
def tokens_lone_characters(spark, sf):
    """Contents with three letters turned into Chinese and Japanese characters, each of which is a token."""
    return _counted_tokens(spark, sf, lambda content: F.translate(content, "aeo", "\u6f22\u30a2\u3072"))


# --- search ----------------------------------------------------------------------------------------------------------


def search(key: str, predicate: Callable[[], Column], where: str, *needs: str) -> None:
    more = [f"found AS (SELECT *, {', '.join(f'{_tokens_sql(f)} AS {f}_tokens' for f in needs or ('content',))} FROM flagged)"]

    @query(sql(f"SELECT id FROM found WHERE {where}", *more), key)
    def run(spark, sf):
        return analysed(spark, sf, *needs).filter(predicate()).select("id")


def _at(words: dict[int, str]) -> str:
    first = min(words)
    return "len(list_filter(range(1, len(content_tokens) + 1), lambda i: " + " AND ".join(f"content_tokens[i + {o - first}] = '{w}'" for o, w in words.items()) + ")) > 0"


def _any(test: str) -> str:
    return f"len(list_filter(content_tokens, lambda x: x IS NOT NULL AND {test})) > 0"


_HAS = "coalesce(list_contains(content_tokens, '{}'), false)".format
_ERRORS = f"(lower(level) = 'error' OR {_HAS('error')} OR {_HAS('exception')})"

search("search_term", lambda: P.term("worker_log", "flag") & P.term("ERROR", "level"), "list_contains(flags, 'worker_log') AND list_contains(level_tokens, 'error')", "level")
search("search_default_field", lambda: P.term("exception"), _HAS("exception"))
search("search_phrase", lambda: P.phrase("state from Pending"), _at({0: "state", 2: "pending"}))
search("search_prefix", lambda: P.prefix("Excep"), _any("starts_with(x, 'excep')"))
search("search_wildcard", lambda: P.wildcard("ex?ep*n"), _any("regexp_matches(x, '^ex.ep.*n$')"))
search("search_fuzzy", lambda: P.fuzzy("exceptoin", least=0.7), _any("1 - levenshtein(x, 'exceptoin') / least(length(x), 9)::DOUBLE > 0.7"))
search("search_text_range", lambda: P.text_range("pro", "run"), _any("x >= 'pro' AND x <= 'run'"))
search("search_num_eq", lambda: P.num_eq("line", 1) | P.num_eq("id", 77), "line_number = 1 OR id = 77")
search("search_num_range", lambda: P.num_range("line", 100, 200) & P.num_range("id", 50, None, inclusive=False), "line_number BETWEEN 100 AND 200 AND id > 50")
search("search_and", lambda: P.term("exception") & P.num_range("id", None, 5000), f"{_HAS('exception')} AND id <= 5000")
search("search_or", lambda: P.any_term(["exception", "state"]), f"{_HAS('exception')} OR {_HAS('state')}")
search("search_not", lambda: P.term("worker_log", "flag") & ~P.term("error", "level"), "list_contains(flags, 'worker_log') AND NOT list_contains(level_tokens, 'error')", "level")
search("search_only_negated", lambda: ~P.term("exception") & ~P.term("vendor_package", "flag"), f"NOT {_HAS('exception')} AND NOT list_contains(flags, 'vendor_package')")
search("search_all", P.everything, "true")
search("search_term_analysed", lambda: P.term("State's") & P.term("the"), _HAS("state"))
search("search_term_of_two_words", lambda: P.term("Changing-State"), _at({0: "changing", 1: "state"}))


def _slop_sql(words: dict[str, int], slop: int) -> str:
    """Entries with a place such that every word's place, less its own in the phrase, is at most ``slop`` after it."""
    shift = "pos - CASE w " + " ".join(f"WHEN '{w}' THEN {o}" for w, o in words.items()) + " END"
    hits = f"SELECT id, w, {shift} AS s FROM (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM tok) WHERE w IN ({', '.join(map(repr, words))})"
    return f"WITH hits AS ({hits}) SELECT DISTINCT id FROM (SELECT a.id, a.s FROM hits a JOIN hits b ON a.id = b.id AND b.s BETWEEN a.s AND a.s + {slop} GROUP BY a.id, a.s HAVING count(DISTINCT b.w) = {len(words)})"


_TOK_CONTENT = f"tok AS (SELECT id, {_tokens_sql('content')} AS t FROM log_entries)"


@query(sql(f"SELECT id FROM ({_slop_sql({'pending': 0, 'state': 1}, 4)})", _TOK_CONTENT))
def search_phrase_slop(spark, sf):
    return analysed(spark, sf).filter(P.phrase("pending state", slop=4)).select("id")


@query(sql(f"SELECT id FROM ({_slop_sql({'running': 0, 'state': 1, 'changing': 2}, 6)})", _TOK_CONTENT))
def search_phrase_slop_of_three(spark, sf):
    return analysed(spark, sf).filter(P.phrase("running state changing", slop=6)).select("id")


@query(sql("SELECT DISTINCT a.id FROM hits a JOIN hits b ON a.id = b.id AND a.pos <> b.pos AND abs(a.pos - (b.pos - 1)) <= 2", _TOK_CONTENT, "hits AS (SELECT id, pos FROM (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM tok) WHERE w = 'de')"))
def search_phrase_slop_repeated(spark, sf):
    """A word twice needs two places."""
    return analysed(spark, sf).filter(P.phrase("de de", slop=2)).select("id")


@query(sql(f"SELECT id FROM tok WHERE list_contains(t, 'exception')", _TOK_CONTENT))
def search_postings(spark, sf):
    """A word looked up in the stored table of postings of texts, and their entries."""
    at, texts = workspace(spark, "postings"), T.apart(analysed(spark, sf), ("content",))
    T.postings_of(texts).write.parquet(at)
    entries = texts.numbers.select(F.col("content_text").alias("id"), F.col("id").alias("entry"))
    return text.with_term(entries, spark.read.parquet(at), "Exception").select(F.col("entry").alias("id"))


@query(sql(f"SELECT id FROM (SELECT * FROM found WHERE {_HAS('exception')} OR {_HAS('state')}) WHERE lower(level) = 'error'", f"found AS (SELECT *, {_tokens_sql('content')} AS content_tokens FROM flagged)"))
def search_group(spark, sf):
    """A search within the hits of another."""
    return analysed(spark, sf).filter(P.any_term(["exception", "state"])).filter(F.lower("level") == "error").select("id")


# --- orders and pages ------------------------------------------------------------------------------------------------


@query(sql("SELECT id, row_number() OVER (ORDER BY date_key, line_number, file_path, id) AS rank FROM flagged WHERE list_contains(flags, 'worker_log')"))
def order_hits(spark, sf):
    hits = flagged(spark, sf).filter(P.term("worker_log", "flag"))
    return numbered(hits.select("id", *R.BY_DAY), *R.BY_DAY, "id").select("id", "rank")


@query(sql("SELECT id, row_number() OVER (ORDER BY ts_ms, file_path, line_number) AS rank FROM log_entries"))
def order_chrono(spark, sf):
    return numbered(log_entries(spark, sf).select("id", *R.CHRONO), *R.CHRONO).select("id", "rank")


@query(sql("SELECT id, row_number() OVER (ORDER BY ts_ms, id) AS rank FROM log_entries"))
def ids_by_time(spark, sf):
    return numbered(log_entries(spark, sf).select("id", "ts"), "ts", "id").select("id", "rank")


@query(sql("SELECT id, k - 400 AS place FROM (SELECT id, row_number() OVER (ORDER BY ts_ms, file_path, line_number) AS k FROM log_entries) WHERE k BETWEEN 401 AND 600"))
def page(spark, sf):
    """Two pages, the second by the last row of the first."""
    e = log_entries(spark, sf)
    first = R.page(e, 400, 100).withColumn("part", F.lit(0))
    last = first.orderBy(*[F.col(c).desc() for c in R.CHRONO]).first()
    both = first.unionByName(R.page_after(e, last, 100).withColumn("part", F.lit(1)))
    return both.select("id", F.row_number().over(Window.orderBy("part", *R.CHRONO)).cast("long").alias("place"))


# --- counts ----------------------------------------------------------------------------------------------------------

_FOUND = f"found AS (SELECT *, {_tokens_sql('content')} AS content_tokens FROM flagged)"
_LEVELS_SQL = ", ".join("count(*) FILTER ({p} AND lower(level) = '" + x + "') AS " + x for x in ("info", "warn", "error", "debug", "trace"))


@query(sql(f"SELECT count(*) AS hits FROM found WHERE {_ERRORS}", _FOUND))
def count_hits(spark, sf):
    return R.count_hits(analysed(spark, sf), P.general_errors())


@query(sql("SELECT " + _LEVELS_SQL.replace("{p}", "list_contains(flags, 'worker_log')") + ", count(*) FILTER (list_contains(flags, 'worker_log')) AS hits, count(*) AS total FROM flagged"))
def level_counts(spark, sf):
    return R.level_counts(flagged(spark, sf), P.term("worker_log", "flag"))


@query(sql(f"SELECT count(*) FILTER ({_HAS('exception')}) AS hits, count(*) AS total FROM found", _FOUND))
def hits_of_total(spark, sf):
    return R.hits_of_total(analysed(spark, sf), P.term("exception"))


@query(sql("SELECT DISTINCT unnest(flags) AS flag FROM flagged"))
def distinct_flags(spark, sf):
    return R.distinct_flags(flagged(spark, sf))


# --- sinks -----------------------------------------------------------------------------------------------------------


@query(sql("SELECT ts_ms, channel, elapsed_ms, level, source, content FROM flagged WHERE list_contains(flags, 'worker_log') AND lower(level) = 'error'"))
def export_log(spark, sf):
    """Exported hits, scanned and parsed again: the same but for files, lines and ids."""
    at = workspace(spark, "export")
    sinks.export_log(flagged(spark, sf).filter(P.term("worker_log", "flag") & (F.lower("level") == "error")), at)
    back = E.parse(scan.number_lines(scan.scan_dir(spark, at, "part-*")))
    return E.quarantine(back)[0].select(ms(), "channel", "elapsed_ms", "level", "source", "content")


@query(sql("SELECT date_key, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM log_entries GROUP BY date_key"))
def write_entries(spark, sf):
    at = workspace(spark, "entries")
    e, whole = flagged_rows(spark, sf)
    sinks.write_entries(e, at, whole=whole)
    return scan.read_entries(spark, at).groupBy(F.col("date_key").cast("long").alias("date_key")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_BY_FILE = "SELECT file_path, line_number, {} + row_number() OVER (ORDER BY file_path, line_number) AS id FROM log_entries WHERE {}"


@query(sql(_BY_FILE.format(0, "true")))
def load_replace(spark, sf):
    """A load of one level, then a load of all entries in its place."""
    at, (e, whole) = workspace(spark, "store"), flagged_rows(spark, sf)
    e = e.drop("id")
    sinks.load_replace(e.filter("level = 'INFO'"), at, whole)
    sinks.load_replace(e, at, whole)
    return scan.read_entries(spark, at).select("file_path", "line_number", "id")


@query(sql(_BY_FILE.format(0, "level = 'INFO'") + " UNION ALL " + _BY_FILE.format("(SELECT count(*) FROM log_entries WHERE level = 'INFO')", "level <> 'INFO'")))
def load_append(spark, sf):
    """A load of one level, then a load of all other entries after it."""
    at, (e, whole) = workspace(spark, "store"), flagged_rows(spark, sf)
    e = e.drop("id")
    sinks.load_replace(e.filter("level = 'INFO'"), at, whole)
    sinks.load_append(spark, e.filter("level <> 'INFO'"), at, whole)
    return scan.read_entries(spark, at).select("file_path", "line_number", "id")


# --- saved filters ---------------------------------------------------------------------------------------------------

SAVED = [
    ("General Errors", "lower(level) = 'error' OR array_contains(content_tokens, 'error') OR array_contains(content_tokens, 'exception')"),
    ("Worker Errors", "array_contains(flags, 'worker_log') AND lower(level) = 'error'"),
    ("State Changes", "array_contains(flags, 'worker_state')"),
    ("Scripts (all)", "array_contains(flags, 'script')"),
]
_SAVED_SQL = [_ERRORS, "list_contains(flags, 'worker_log') AND lower(level) = 'error'", "list_contains(flags, 'worker_state')", "list_contains(flags, 'script')"]


@query(sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({w}) AS hits, {_LEVELS_SQL.replace('{p}', f'({w})')} FROM found" for (n, _), w in zip(SAVED, _SAVED_SQL, strict=True)), _FOUND))
def saved_counts(spark, sf):
    return R.saved_counts(analysed(spark, sf), R.saved_filters(spark, SAVED))


@query(sql(f"SELECT id FROM found WHERE list_contains(flags, 'worker_log') AND {_ERRORS}", _FOUND))
def saved_refine(spark, sf):
    return R.refine(analysed(spark, sf), P.term("worker_log", "flag"), SAVED[0][1]).select("id")


@query(sql(f"SELECT id FROM found WHERE {_ERRORS}", _FOUND))
def general_errors(spark, sf):
    return analysed(spark, sf).filter(P.general_errors()).select("id")


@query(sql("SELECT file_path, line_number, ts_ms, level, row_number() OVER (ORDER BY ts_ms, file_path, line_number) AS rank FROM flagged WHERE list_contains(flags, 'worker_log') AND lower(level) = 'error'"))
def worker_errors(spark, sf):
    """From log text on disk: worker-log entries of level error, in chronological order over all files."""
    hits = loaded(spark, sf, lambda rows: rows.filter(P.term("worker_log", "flag") & (F.lower("level") == "error")).select(*R.CHRONO, "level"))
    return numbered(hits, *R.CHRONO).select("file_path", "line_number", ms(), "level", "rank")
