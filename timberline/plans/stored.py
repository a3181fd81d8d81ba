"""Registered queries on tables that a load leaves: the search index, the star of several loads, stored orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import text
from timberline.operators import dims as D
from timberline.operators import index as I
from timberline.operators import review as R
from timberline.plans.log_entries import analysed, flagged_rows, log_entries, sql
from timberline.plans.queries import _DIMS, _ERRORS, _FOUND, _HAS, _LEVELS_SQL, _TERMS, _any, _at, _slop_sql, _tokens_sql
from timberline.plans.registry import query
from timberline.sources import scan, sinks
from timberline.sources.store import workspace

_BUILT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an index of all entries of ``sf_dir``, made anew."""
    at = workspace(spark, "index")
    I.build(analysed(spark, sf_dir, *text.TEXT_FIELDS), at, only=lambda ids: analysed(spark, sf_dir, *text.TEXT_FIELDS, among=ids))
    return at


def index(spark: SparkSession, sf_dir: str) -> I.Index:
    """That index, built at a session's first search of ``sf_dir``: entries are loaded once and searched often."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = built(spark, sf_dir)
    return I.opened(spark, _BUILT[key])


@query(sql("SELECT (SELECT count(*) FROM terms) AS places, (SELECT count(*) FROM (SELECT DISTINCT field, term FROM terms)) AS terms, (SELECT count(*) FROM (SELECT DISTINCT field, term, id FROM terms)) AS postings, (SELECT count(*) FROM log_entries) AS entries", _TERMS))
def index_build(spark, sf):
    """A new index each time: its places, terms, postings and entries, as its tables have them."""
    made = I.opened(spark, built(spark, sf))
    counted = made.dictionary.agg(F.sum("places").alias("places"), F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return counted.join(made.numbers.agg(F.count("*").alias("entries")))  # a row each


@query(sql("SELECT field, term, count(DISTINCT id) AS df, count(*) AS places FROM terms GROUP BY field, term", _TERMS))
def index_dictionary(spark, sf):
    return index(spark, sf).dictionary.select("field", "term", "df", "places")


def search(key: str, clause: Callable[[], I.Clause], where: str, *needs: str) -> None:
    """A search of the stored index, against the same on all entries' texts."""
    more = [f"found AS (SELECT *, {', '.join(f'{_tokens_sql(f)} AS {f}_tokens' for f in needs or ('content',))} FROM flagged)"]

    @query(sql(f"SELECT id FROM found WHERE {where}", *more), key)
    def run(spark, sf):
        return I.ids(index(spark, sf), clause())


_WORKER, _ERROR = "list_contains(flags, 'worker_log')", "lower(level) = 'error'"
search("search_bitmaps", lambda: (I.term("exception") | I.term("state")) & I.term("worker_log", "flag") & ~I.term("ERROR", "level"), f"({_HAS('exception')} OR {_HAS('state')}) AND {_WORKER} AND NOT {_ERROR}")
search("search_bitmaps_negated", lambda: ~(I.term("exception") | I.term("vendor_package", "flag")), f"NOT {_HAS('exception')} AND NOT list_contains(flags, 'vendor_package')")
search("search_bitmaps_all", I.everything, "true")
search("search_bitmaps_numbers", lambda: I.num_range("line", 100, 2000) & I.num_range("id", 50, None, inclusive=False) & I.term("state"), f"line_number BETWEEN 100 AND 2000 AND id > 50 AND {_HAS('state')}")
search("search_phrase_stored", lambda: I.phrase("state from Pending"), _at({0: "state", 2: "pending"}))
search("search_term_analysed_stored", lambda: I.term("Changing-State") & I.term("the"), _at({0: "changing", 1: "state"}))
search("search_prefix_stored", lambda: I.prefix("Excep"), _any("starts_with(x, 'excep')"))
search("search_wildcard_stored", lambda: I.wildcard("ex?ep*n"), _any("regexp_matches(x, '^ex.ep.*n$')"))
search("search_text_range_stored", lambda: I.text_range("pro", "run"), _any("x >= 'pro' AND x <= 'run'"))
_SIMILAR = "1 - levenshtein(x, '{0}') / least(length(x), {1})::DOUBLE > {2}".format
search("search_fuzzy_stored", lambda: I.fuzzy("exceptoin", least=0.7), _any(_SIMILAR("exceptoin", 9, 0.7)))
search("search_fuzzy_far_stored", lambda: I.fuzzy("exceptoin"), _any(_SIMILAR("exceptoin", 9, 0.5)))
search("general_errors_stored", I.general_errors, _ERRORS)

_TOK_CONTENT = f"tok AS (SELECT id, {_tokens_sql('content')} AS t FROM log_entries)"


@query(sql(f"SELECT id FROM ({_slop_sql({'running': 0, 'state': 1, 'changing': 2}, 8)})", _TOK_CONTENT))
def search_phrase_slop_stored(spark, sf):
    return I.ids(index(spark, sf), I.phrase("running state changing", slop=8))


@query(sql("SELECT id, level, md5(content) AS content FROM found WHERE " + _at({0: "changing", 1: "state"}), _FOUND))
def search_found_stored(spark, sf):
    """The entries that a stored search finds; only theirs are joined."""
    return I.found(index(spark, sf), log_entries(spark, sf), I.phrase("changing state")).select("id", "level", F.md5(F.col("content").cast("binary")).alias("content"))


@query(sql("SELECT " + _LEVELS_SQL.replace("{p}", _ERRORS) + f", count(*) FILTER ({_ERRORS}) AS hits, count(*) AS total FROM found", _FOUND))
def level_counts_bitmaps(spark, sf):
    return I.level_counts(index(spark, sf), I.general_errors())


@query(sql(f"SELECT count(*) FILTER ({_HAS('exception')} AND NOT {_WORKER}) AS hits, count(*) AS total FROM found", _FOUND))
def count_bitmaps(spark, sf):
    return I.count_hits(index(spark, sf), I.term("exception") & ~I.term("worker_log", "flag"))


_NAMED = {"General Errors": (I.general_errors, _ERRORS), "Worker Errors": (lambda: I.term("worker_log", "flag") & I.term("error", "level"), f"{_WORKER} AND {_ERROR}"), "State Changes": (lambda: I.term("worker_state", "flag"), "list_contains(flags, 'worker_state')")}


@query(sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({w}) AS hits FROM found" for n, (_, w) in _NAMED.items()), _FOUND))
def saved_counts_bitmaps(spark, sf):
    return I.saved_counts(index(spark, sf), {n: clause() for n, (clause, _) in _NAMED.items()})


# --- loads -----------------------------------------------------------------------------------------------------------

_ORDERED = "loads AS (SELECT *, CASE WHEN level = 'INFO' THEN 0 ELSE 1 END AS load, row_number() OVER (ORDER BY CASE WHEN level = 'INFO' THEN 0 ELSE 1 END, file_path, line_number) AS load_id FROM log_entries)"


def _star(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A load of one level, then a load of all other entries after it."""
    at, (e, whole) = workspace(spark, "star"), flagged_rows(spark, sf)
    e = e.drop("id")
    sinks.load_star(spark, e.filter("level = 'INFO'"), at, whole)
    sinks.load_star(spark, e.filter("level <> 'INFO'"), at, whole)
    return sinks.read_star(spark, at)


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS dim, row_number() OVER (ORDER BY min(load_id)) AS id, {c} AS value FROM loads GROUP BY {c}" for k, c in D.DIMENSIONS.items()), _ORDERED))
def dim_append(spark, sf):
    """Dimensions after two loads: what the first one numbered keeps its number."""
    _, dims = _star(spark, sf)
    found = [d.select(F.lit(k).alias("dim"), "id", "value") for k, d in dims.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(sql("SELECT load_id AS id, file_path, line_number, ts_ms, channel, elapsed_ms, level, source FROM loads", _ORDERED))
def star_join_append(spark, sf):
    """Facts of two loads, decoded with the dimensions of both."""
    fact, dims = _star(spark, sf)
    return D.decode_fact(fact, dims).select("id", "file_path", "line_number", F.unix_millis("ts").alias("ts_ms"), "channel", "elapsed_ms", "level", "source")


@query(sql("SELECT id, file_path, line_number, ts_ms, channel, elapsed_ms, level, source FROM log_entries"))
def star_join_shuffled(spark, sf):
    """The star join where no dimension may be broadcast whole: frequent values' part is, all other rows are shuffled."""
    e = log_entries(spark, sf).drop("content")
    dims = D.dimensions(e)
    return D.decode_fact(D.encoded(e, dims, 0).drop(*D.DIMENSIONS.values()), dims, 0).select("id", "file_path", "line_number", F.unix_millis("ts").alias("ts_ms"), "channel", "elapsed_ms", "level", "source")


@query(sql("SELECT id, ts_ms, md5(content) AS content FROM log_entries WHERE id % 50 = 7 AND id < 1000"))
def fetch_stored(spark, sf):
    """Entries of a stored table by a list of ids, which their row groups' Bloom filters are asked for."""
    at = workspace(spark, "entries")
    e, whole = flagged_rows(spark, sf)
    sinks.write_entries(e, at, whole=whole)
    ids = list(range(7, 1000, 50))
    return D.fetch_by_ids(scan.read_entries(spark, at, ids), ids).select("id", F.unix_millis("ts").alias("ts_ms"), F.md5(F.col("content").cast("binary")).alias("content"))


@query(sql("SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY ts_ms, file_path, line_number) - 1 AS place FROM log_entries) WHERE place BETWEEN 450 AND 649 OR place < 20"))
def page_stored(spark, sf):
    """A page within a stored order that crosses ranges, and the first one."""
    at = workspace(spark, "order")
    R.store_order(log_entries(spark, sf), at, rows=250)
    return R.stored_page(spark, at, 450, 200).unionByName(R.stored_page(spark, at, 0, 20)).select("id", "place")
