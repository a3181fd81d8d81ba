"""Audit of interacting filters: what each order of five filters removes, from one pass over the bytes of every text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import saved, small
from timberline.llm.textbytes import CHUNK, SPACE, Rolling, chunks, same_spans

FILTERS = "ABCDE"

# The transducer: what kind of byte it reads, and what it does then.
GAP, WORD = 0, 1  # states: outside a word, within one
_SPACE, _CAPITAL, _SYMBOL, _PLAIN, _MORE = range(5)  # kinds of bytes; _MORE continues a character
KIND = np.full(256, _PLAIN, np.uint8)
KIND[SPACE] = _SPACE
KIND[0x41:0x5B] = _CAPITAL
KIND[list(b"#$%&*|")] = _SYMBOL
KIND[0x80:0xC0] = _MORE
STARTS, CAPITAL, SYMBOL, POINT, ENDS = 1, 2, 4, 8, 16
#: State after a byte of each kind; the same from either state, so that a byte's state before is known from the byte before it.
NEXT = np.array([GAP, WORD, WORD, WORD, WORD], np.uint8)
#: Actions by state and kind.
ACTION = np.array(
    [
        [POINT, STARTS | CAPITAL | POINT, STARTS | SYMBOL | POINT, STARTS | POINT, STARTS],
        [ENDS | POINT, CAPITAL | POINT, SYMBOL | POINT, POINT, 0],
    ],
    np.uint8,
)

_ROLL = Rolling(0xD6E8FEB86659FD93)


def transduced(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The actions of every byte of the texts that lie end to end in ``data`` and start at ``at``. A text begins outside a word."""
    kind = KIND[data]
    before = np.zeros(len(data), np.uint8)
    before[1:] = NEXT[kind[:-1]]
    before[at[:-1][at[:-1] < len(data)]] = GAP
    return ACTION[before, kind]


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Which spans are the first of their bytes within their owner: all are put into one hash table, open to the next slot.

    A slot holds a span. One that finds a slot taken is compared with the span there, owner, length and bytes: it is either the same, or goes
    on to the next slot. So no two different words count as one, whatever their hashes. All spans go one step at a time.
    """
    n = len(start)
    if not n:
        return np.zeros(0, bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    raw, size = data.tobytes(), end - start
    if hashes is None:
        hashes = _ROLL.spans(_ROLL.sums(data), start, end)
    slots = np.uint64(1 << max(3, (2 * n).bit_length()))
    slot = ((hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & (slots - np.uint64(1))).astype(np.int64)
    table, new, open_ = np.full(int(slots), n, np.int64), np.zeros(n, bool), np.arange(n)
    while len(open_):
        free = open_[table[slot[open_]] == n]
        table[slot[free[::-1]]] = free[::-1]  # of those that want a free slot, the first span gets it
        held = table[slot[open_]]
        new[held[held == open_]] = True
        rest = held != open_
        open_, held = open_[rest], held[rest]
        match = (owner[open_] == owner[held]) & (size[open_] == size[held])
        match[match] = same_spans(padded, raw, start[open_[match]], start[held[match]], size[open_[match]])
        open_ = open_[~match]
        slot[open_] = (slot[open_] + 1) & (int(slots) - 1)
    return new


def _counted(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: words, different words, capitals, code points, symbols."""
    does = transduced(data, at)
    start = np.flatnonzero(does & STARTS)
    doc = np.searchsorted(at, start, side="right") - 1
    stop = np.zeros(len(data) + 1, bool)
    stop[:-1] = (does & ENDS) > 0
    stop[at[1:]] = True  # a text's end ends its last word
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, side="right")]
    new = distinct_spans(data, start, end, doc)
    sums = lambda bit: np.diff(np.concatenate([[0], np.cumsum((does & bit) > 0)])[at])
    per = lambda x: np.bincount(x, minlength=len(at) - 1)
    return np.stack([per(doc), per(doc[new]), sums(CAPITAL), sums(POINT), sums(SYMBOL)])


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text, cut at white space into pieces of about ``most`` bytes; a word is never cut."""
    i = 0
    while i < len(data):
        j = min(len(data), i + most)
        while j < len(data) and not SPACE[data[j]]:
            gap = np.flatnonzero(SPACE[data[j : j + most]])
            j = j + int(gap[0]) if len(gap) else min(len(data), j + most)
        yield data[i:j]
        i = j


def counted(data: np.ndarray, at: np.ndarray, most: int = CHUNK) -> np.ndarray:
    """:func:`_counted`; one text of over ``most`` bytes goes piece by piece, and its different words are kept between pieces."""
    if len(at) != 2 or len(data) <= most:
        return _counted(data, at)
    total, words = np.zeros(5, np.int64), set()
    for piece in _pieces(data, most):
        edges = np.array([0, len(piece)])
        total += _counted(piece, edges)[:, 0]
        words.update(piece.tobytes().split())  # the same white space
    total[1] = len(words)
    return total.reshape(5, 1)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, words, distinct_words, capitals, code_points, symbols, digest): one row per row of ``docs``.

    Null texts count as empty, null parts as the empty string. ``digest`` is the text's SHA-256. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    names = ["words", "distinct_words", "capitals", "code_points", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            found, raw = counted(data, at), memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x.astype(np.int64)) for x in found], pa.array(digests, pa.binary())], names=["id", "part", *names, "digest"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part string, {', '.join(f'{x} long' for x in names)}, digest binary")


def failures(measured: DataFrame) -> DataFrame:
    """(id, part, fails): ``fails`` has bit k set if a document fails the filter number k of ABCDE.

    A: under 100 words. B: under 80 different words of 100. C: over 10 capitals of 100 characters. D: a symbol. E: the text of a smaller id, in all of the table.
    A null id is no smaller one, and has none. Of texts that occur once nothing but their digests is shuffled; a text's ids are reduced to the smallest
    before the shuffle, so a text that a third of all rows have costs one row per task, and adaptive execution may split the join that follows.
    """
    first = measured.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = measured.join(small(saved(first, "repeated")), "digest", "left")
    fails = [
        F.col("words") < 100, F.col("distinct_words") * 100 < F.col("words") * 80, F.col("capitals") * 100 > F.col("code_points") * 10,
        F.col("symbols") > 0, F.col("id") > F.col("first"),
    ]
    bits = sum((F.when(p, 1 << k).otherwise(0) for k, p in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", bits.cast("int").alias("fails"))


def patterns(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): documents by part and by the set of filters that they fail, and how many of them are labelled good or toxic.

    A document has what any label of its id says; labels without an id belong to none. Counts are summed before the shuffle.
    """
    yes = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).filter("good + toxic > 0")
    plain = failed.groupBy("part", "fails").agg(F.count("*").alias("n"))
    told = failed.filter("id is not null").join(known, F.col("id") == F.col("l_id")).groupBy("part", "fails").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return plain.join(told, ["part", "fails"], "left").fillna(0, ["good", "toxic"])


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of ``filters``, of :func:`patterns`.

    A part is one row of at most 2^5 patterns; its orders and steps are made from that row.
    ``shapley`` needs no orders: of 120, a document that fails m filters is removed by each of them in 120 / m.
    """
    k = len(filters)
    orders = math.factorial(k)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = [("".join(order), at + 1, sum(bit[f] for f in order[:at]), bit[order[at]]) for order in permutations(filters) for at in range(k)]
    step = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(x).alias("own")) for o, s, b, x in steps]))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("p"))
    rows = parts.select("part", "p", step.alias("s")).select("part", "p", "s.*")

    def total(what, where):
        return F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["fails"]), what(x)).otherwise(0))

    before, own, n = F.col("before"), F.col("own"), lambda x: x["n"]
    fails = lambda x: x.bitwiseAND(own) != 0
    earlier = lambda x: x.bitwiseAND(before) != 0
    removed = lambda x: fails(x) & ~earlier(x)
    return rows.select(
        "part", "filter_order", "step", total(n, lambda x: ~fails(x) & ~earlier(x)).alias("kept"), total(n, removed).alias("removed"), total(n, lambda x: fails(x) & earlier(x)).alias("redundant"),
        total(n, lambda x: x == own).alias("unique_fails"), total(lambda x: x["good"], removed).alias("good_lost"), total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(lambda x: x["n"] * (F.lit(orders) / F.bit_count(x["fails"])).cast("long"), fails).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    failed = saved(failures(saved(measures(docs), "measures")), "failures")
    return audit(saved(patterns(failed, labels), "patterns"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
q AS (SELECT doc_id, max(coalesce(CAST(quality = 1 AS INT), 0)) AS good, max(coalesce(CAST(toxic = 1 AS INT), 0)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 100 AS INT) AS a, CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) AS b,
  CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d,
  coalesce(CAST(d.doc_id > min(d.doc_id) OVER (PARTITION BY text) AS INT), 0) AS e
  FROM d LEFT JOIN q ON q.doc_id = d.doc_id),
pats AS (SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [k1.k, k2.k, k3.k, k4.k, k5.k] AS o FROM k k1, k k2, k k3, k k4, k k5 WHERE len(list_distinct([k1.k, k2.k, k3.k, k4.k, k5.k])) = 5),
s AS (SELECT o, step.k AS step, o[step.k] AS own, o[1:step.k - 1] AS earlier FROM o, k step),
x AS (SELECT part, o, step, own, n, good, toxic, f[own] = 1 AS fails, list_sum(list_transform(earlier, lambda i: f[i])) > 0 AS gone, list_sum(f) = 1 AS single FROM pats, s),
r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT coalesce(gone, false)), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false)), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND single), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT coalesce(gone, false)), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT coalesce(gone, false)), 0) AS toxic_lost
  FROM x GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
