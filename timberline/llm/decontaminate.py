"""Benchmark decontamination with a positional inverted index of the training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import fits, fresh, saved, small, text_or_empty
from timberline.llm.textbytes import LETTERS, LOWER, Rolling, chunks, flat, words

#: Words in a window of a benchmark item.
WINDOW = 10
#: Bits, as a power of two, of the map that tells tasks which terms may be asked for: 8 MB for any benchmark. What it lets through for nothing is dropped by a join.
BITS = 26

_ROLL = Rolling(0x9E3779B97F4A7C15)


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    folded = LOWER[data]
    start, end, doc = words(folded, at, LETTERS)
    return folded, start, end, doc, _ROLL.spans(_ROLL.sums(folded), start, end).view(np.int64)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id, words, terms): every run of ``size`` words of an item; a shorter item is one window, one without words is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            folded, start, end, doc, term = _terms(data, at)
            own, texts, keys = [], [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, b = np.searchsorted(doc, [i, i + 1])
                for k in range(a, max(a + 1, b - size + 1) if b > a else a):
                    span = range(k, min(k + size, b))
                    own.append(item)
                    texts.append([folded[start[j] : end[j]].tobytes().decode("utf-8", "replace") for j in span])
                    keys.append(term[span.start : span.stop].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(own, batch.column(0).type), pa.array(texts, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], names=["item_id", "words", "terms"])

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"item_id {rows.schema['id'].dataType.simpleString()}, words array<string>, terms array<long>")


def _marks(terms: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of 2^``bits`` bits with one set for each of ``terms`` (term), built in parallel."""
    place = F.col("term").bitwiseAND(F.lit((1 << bits) - 1))
    parts = terms.select((place + 1).alias("h")).groupBy((F.bitmap_bucket_number("h") - 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, part in parts:
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(part, np.uint8)[: len(out)]
    return out


def _marked(term: np.ndarray, marks: np.ndarray) -> np.ndarray:
    place = term.view(np.uint64) & np.uint64(8 * len(marks) - 1)
    return (marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(term, n): how often each of ``terms`` occurs in all documents; terms that never occur have no row."""
    sent = docs.sparkSession.sparkContext.broadcast(_marks(terms, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in chunks(batches):
            term = _terms(data, at)[-1]
            found, n = np.unique(term[_marked(term, sent.value)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["term", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(terms, "term", "left_semi")


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, sig, n_words, postings): for every document, where each of ``terms`` (term) stands. A few other terms may be among them.

    ``sig`` is a hash of the text, to tell rows that share an id apart.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_marks(terms, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            *_, doc, term = _terms(data, at)
            first = np.searchsorted(doc, np.arange(len(at)))  # each document's first word
            hit = np.flatnonzero(_marked(term, sent.value))
            postings = pa.StructArray.from_arrays([pa.array(term[hit]), pa.array(hit - first[doc[hit]])], names=["term", "pos"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, first).astype(np.int32)), postings)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first).astype(np.int64)), lists], names=["id", "sig", "n_words", "postings"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, sig long, n_words long, postings array<struct<term:long,pos:long>>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("sig"), F.col(text_col).alias("text"))


def _same(left: str, right: str):
    return F.col(f"{left}id").eqNullSafe(F.col(f"{right}id")) & (F.col(f"{left}sig") == F.col(f"{right}sig"))


def _verified(docs: DataFrame, places: DataFrame, slack: int) -> DataFrame:
    """(id, sig, window, start, n_words, kind) of the ``places`` (id, sig, window, words, n, o, pos) at which the documents' words are the window's.

    A document's places are one row: its windows, each with a number for every place.

    ``pos`` is where a document has the window's word number ``o``. With ``slack``, a place that isn't the phrase is ``near`` if some ``n`` + ``slack``
    words around ``pos`` hold all words of the window.
    """
    keys = (F.col("id").alias("w_id"), F.col("sig").alias("w_sig"))
    lists = places.groupBy(*keys, "window", "words", "n", "o").agg(F.collect_set("pos").alias("at"))
    lists = lists.groupBy("w_id", "w_sig").agg(F.collect_list(F.struct("window", "words", "n", "o", "at")).alias("places"))
    lists = F.broadcast(lists) if fits(places) else lists
    kind = docs.schema["id"].dataType.simpleString()

    def judged(found: list[bytes], asked: dict) -> Iterator[tuple[str, int, int, str]]:
        wanted, n = asked["words"].encode().split(b" "), asked["n"]
        for pos in asked["at"]:
            start = pos - asked["o"]
            if start >= 0 and found[start : start + n] == wanted:
                yield asked["window"], start, n, "phrase"
            elif slack:
                for i in range(max(0, pos - n - slack + 1), pos + 1):
                    if set(wanted) <= set(part := found[i : i + n + slack]):
                        yield asked["window"], i, len(part), "near"
                        break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, at in chunks(iter([whole])):
                folded, start, end, doc, _ = _terms(data, at)
                edges, raw, out = np.searchsorted(doc, np.arange(len(at))), folded.tobytes(), []
                for i, (owner, sig, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                    found = [raw[a:b] for a, b in zip(start[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist(), strict=True)]
                    out += [(owner, sig, *hit) for windows in asked for hit in judged(found, windows)]
                kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["id", "sig", "window", "start", "n_words", "kind"])

    asked = docs.join(lists, _same("", "w_")).select("id", "sig", "text", "places")
    return asked.mapInArrow(run, f"id {kind}, sig long, window string, start long, n_words long, kind string").distinct()


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, hits, owners) of all windows of ``items`` in ``docs``.

    hits: (id, sig, window, start, n_words, kind), one row per place: ``phrase`` for the window's words in order;
    with ``slack`` over 0 also ``near``, all of its words within that many words more, in any order.
    owners: (window, item_id).

    Corpus counts pick each window's two rarest terms; a window with a term that no document has can't occur (as a phrase
    or near) and is dropped. Only those terms' postings are stored. Each place of the rarest term says where the other one has to stand if the
    window is there: the second list is asked for that very place of that document (for ``near``: for places within reach, by strips as long as the reach), so a place
    of either list is one row of the join, however many there are in a text, and rows that repeat an id and a text ask alike. There the window's words are
    compared with the text. The list of a frequent term isn't needed unless a window has no rarer ones; then it is as long as it is.
    """
    own = saved(windows(items, "item_id", "text", size).withColumn("window", F.sha2(F.array_join("words", " "), 256)), "windows")
    owners = own.select("window", "item_id").distinct()
    distinct = own.groupBy("window").agg(F.first("words").alias("words"), F.first("terms").alias("terms"))
    places = distinct.select("window", F.posexplode("terms").alias("o", "term"))
    terms = saved(places.select("term").distinct(), "terms")
    counts = small(saved(term_counts(docs, terms, text_col, bits), "counts"))
    ranked = places.join(counts, "term", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "term"))).alias("r")).filter("r[0].n > 0")
    sought = distinct.join(ranked, "window").select("window", F.array_join("words", " ").alias("words"), F.size("words").alias("n"), F.expr("r[0].term").alias("term"), F.expr("r[0].o").alias("o"), F.expr("get(r, 1).term").alias("term2"), F.expr("get(r, 1).o").alias("o2"))
    sought = saved(sought, "sought")
    rare = saved(sought.select(F.explode(F.array("term", "term2")).alias("term")).filter("term is not null").distinct(), "rare")
    index = saved(positional_index(docs, rare, id_col, text_col, bits), "postings")

    lists = index.select("id", "sig", F.inline("postings"))
    first = lists.join(small(sought), "term")
    reach = size + slack
    spot = F.col("pos") - F.col("o") + F.col("o2")  # where the second term stands in a phrase
    if slack:
        strips = F.floor(F.col("pos") / reach)
        first = first.withColumn("s_at", F.explode(F.array(strips - 1, strips, strips + 1)))
    else:
        first = first.withColumn("s_at", spot)
    second = lists.join(small(sought.select(F.col("term2").alias("term")).filter("term is not null").distinct()), "term", "left_semi")
    second = second.select(F.col("id").alias("s_id"), F.col("sig").alias("s_sig"), F.col("term").alias("s_term"), F.col("pos").alias("s_pos"), (F.floor(F.col("pos") / reach) if slack else F.col("pos")).alias("s_place"))
    meets = _same("", "s_") & (F.col("term2") == F.col("s_term")) & (F.col("s_at") == F.col("s_place"))
    if slack:
        meets &= F.abs(F.col("s_pos") - F.col("pos")) < F.col("n") + slack
    both = first.filter("term2 is not null").join(second, meets, "left_semi")
    columns = ("id", "sig", "window", "words", "n", "o", "pos")
    found = saved(first.filter("term2 is null").select(*columns).unionByName(both.select(*columns)).distinct(), "places")
    return index, _verified(_keyed(docs, id_col, text_col), found, slack), owners


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (sorted as strings), contaminated, and ``sig``.

    A document's word is hit if it is inside any occurrence of a window. Null and empty texts have no words.
    Rows that repeat an id are judged by their own texts. Items without an id hit words but are not listed.
    Null and empty items have no window; items with the same window are all listed. Other columns of either table are not read.
    Without items nothing is hit; an empty table of documents gives an empty result. Very long texts are read whole.
    """
    index, hits, owners = matches(docs, items, size, id_col=id_col, text_col=text_col)
    hits = saved(hits, "hits")
    places = hits.groupBy("id", "sig").agg(F.collect_set(F.struct("start", "n_words")).alias("w"))
    # spans in order of their starts: each adds what is behind the ends of those before it
    added = "named_struct('reached', greatest(s.reached, x.start + x.n_words), 'n', s.n + greatest(0L, x.start + x.n_words - greatest(s.reached, x.start)))"
    covered = places.select("id", "sig", F.expr(f"aggregate(array_sort(w), named_struct('reached', 0L, 'n', 0L), (s, x) -> {added}, s -> s.n)").alias("n_hit"))
    named = hits.select("id", "sig", "window").distinct().join(owners, "window").groupBy("id", "sig").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    keys = lambda x: F.col("id").eqNullSafe(F.col(f"{x}_id")) & (F.col("sig") == F.col(f"{x}_sig"))
    covered, named = (x.withColumnsRenamed({"id": f"{n}_id", "sig": f"{n}_sig"}) for n, x in (("c", covered), ("m", named)))
    joined = index.select("id", "sig", "n_words").join(covered, keys("c"), "left").join(named, keys("m"), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), "sig", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    own, sig = fresh(docs, "_hit_id"), fresh(docs, "_hit_sig")
    found = contamination(docs, items, size, id_col, text_col).filter("contaminated").select(F.col(id_col).alias(own), F.col("sig").alias(sig)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty(text_col)) == F.col(sig))
    return docs.join(small(saved(found, "contaminated")), same, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win ON spot.n = win.n AND spot.t = win.t),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""
