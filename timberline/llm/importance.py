"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import fresh, saved, text_or_empty
from timberline.llm.textbytes import LETTERS, SPACE, Rolling, chunks, mixed

#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 14
#: Labelled rows that the target model and the size of the sample are fitted on at most, taken by a hash of the id.
LABEL_ROWS = 200_000
#: Times that the target model sees the raw model's average bucket besides its own counts.
PRIOR = 20.0
#: Share of the labelled target documents whose weights may lie under the sample's edge.
MISSED = 0.002

_ROLL = Rolling(0xD1342543DE82EF95)
_CAPITALS = np.zeros(256, bool)
_CAPITALS[0x41:0x5B] = True
_KIND = np.where(SPACE, 0, np.where(LETTERS | _CAPITALS, 1, 2)).astype(np.uint8)


def ngrams(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every token, every pair of neighbouring tokens, and every token that repeats one of the two before it.

    Tokens are runs of letters and digits, or of other signs; the case is kept.
    """
    kind = _KIND[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[at] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    doc = np.searchsorted(at, start, side="right") - 1
    token = _ROLL.spans(_ROLL.sums(data), start, end)
    pair = mixed(token[:-1] * np.uint64(3) + token[1:])[doc[:-1] == doc[1:]]
    docs, found = [doc, doc[:-1][doc[:-1] == doc[1:]]], [token, pair]
    for back in (1, 2):
        same = (token[back:] == token[:-back]) & (doc[back:] == doc[:-back])
        docs.append(doc[back:][same])
        found.append(np.full(int(same.sum()), mixed(np.array([back], np.uint64))[0]))
    return np.concatenate(docs), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)


def bounded_labels(labels: DataFrame, flags: dict[str, Column], rows: int = LABEL_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(id, and each of ``flags``): at most ``rows`` labelled ids, the same ones each time: those that have the least hashes. A flag holds if it does for any of the id's rows; null is false."""
    own = labels.select(F.col(id_col).alias("id"), *[F.coalesce(p, F.lit(False)).alias(n) for n, p in flags.items()]).filter("id is not null")
    return own.groupBy("id").agg(*[F.max(n).alias(n) for n in flags]).orderBy(F.xxhash64("id"), "id").limit(rows)


def models(docs: DataFrame, target: Column, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw probability for every bucket. Raw counts cover all rows, target counts those where ``target`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets), np.int64)
        for batch, data, at in chunks(batches):
            doc, found = ngrams(data, at, buckets)
            own = np.array(batch.column(1).to_pylist(), bool)
            seen[0] += np.bincount(found, minlength=buckets)
            seen[1] += np.bincount(found[own[doc]], minlength=buckets)
        k = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[0][k]), pa.array(seen[1][k])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("own"))
    counts = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    seen = np.zeros((2, buckets))
    for bucket, raw, own in counts:
        seen[:, bucket] = raw, own
    return log_ratio(*seen)


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Of the smoothed probabilities: raw counts get one more each, target counts ``prior`` for an average bucket, shared out as the raw ones are."""
    p = (raw + 1) / (raw + 1).sum()
    weight = prior * len(raw)
    return np.log((target + weight * p) / (target.sum() + weight)) - np.log(p)


def with_weights(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", name: str = "log_weight", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns in ``keep``) and the log importance weight: the sum of its n-grams' log ratios."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    names = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches, own):
            doc, found = ngrams(data, at, len(sent.value))
            weight = np.bincount(doc, weights=sent.value[found], minlength=batch.num_rows).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight)], names=[*batch.schema.names[:-1], name])

    own = fresh(docs, "_text")
    rows = docs.select(*[F.col(c) for c in names], F.col(text_col).alias(own))
    kept = docs.select(*names).schema
    return rows.mapInArrow(run, kept.add(name, "double"))


def gumbel(key: Column, seed: int, text: Column) -> Column:
    """A standard Gumbel number that depends on the key and the seed alone; where the key is null, on the text and the seed."""
    h = F.when(key.isNull(), F.xxhash64(text_or_empty(text), F.lit(seed))).otherwise(F.xxhash64(key, F.lit(seed)))
    u = (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int, cells: int = 4096) -> float | None:
    """The k-th largest of a column of numbers, exactly, by counting in ever narrower cells. None if there are fewer than k."""
    (name,) = values.columns
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if k > n or k < 1:
        return None
    above = 0  # numbers over the present range
    while low < high:
        step = (high - low) / cells
        if low + step <= low or high - step >= high:
            break
        cell = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(step)), F.lit(cells - 1))
        inside = values.filter(F.col(name).between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(name).alias("a"), F.max(name).alias("b"))
        for _, n, a, b in sorted(inside.collect(), reverse=True):
            if above + n >= k:
                low, high = a, b
                break
            above += n
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17, missed: float = MISSED, label_rows: int = LABEL_ROWS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "quality") -> tuple[np.ndarray, float, DataFrame]:
    """(log ratios, edge, scores): the documents whose ``key`` is at least ``edge`` are the sample.

    ``scores`` has (id, log_weight, key); key is the log importance weight plus Gumbel noise, so the k largest
    keys are a sample without replacement in proportion to the weights. Without ``k``, the sample has as many
    documents as have a weight of at least the ``missed`` quantile of labelled target documents, so that about all clean text is in it.

    Only every other labelled document (by a hash of the id) is counted for the target model: the others, which the model
    hasn't seen, tell where the weights of good documents end.

    Null and empty texts weigh nothing (log weight 0). Rows that repeat an id get the same noise, those without one the noise of their text. Keys equal to
    the edge are all in the sample. Labels of unknown documents, and null labels, count for nothing; an
    id that is labelled twice is a target if one of its labels says so. Without any target label every document weighs about alike, and all stay.
    An empty table of documents gives an empty sample. Very long texts are weighed whole, in pieces of memory that a text fills. Other columns are not read.
    """
    bounded = saved(bounded_labels(labels, {"_target": F.col(target_col) == 1}, label_rows, id_col).select(F.col("id").alias("_label_id"), "_target", (F.xxhash64("id", F.lit(seed)) % 2 == 0).alias("_fit")), "labels")
    # bounded: at most label_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ratio = models(rows.join(F.broadcast(bounded), F.col("id") == F.col("_label_id"), "left"), F.col("_target") & F.col("_fit"))
    weighed = with_weights(rows.withColumn("_noise", gumbel(F.col("id"), seed, F.col("text"))), ratio, keep=["id", "_noise"])
    scores = saved(weighed.withColumn("key", F.col("log_weight") + F.col("_noise")).drop("_noise"), "weights")
    if k is None:
        own = scores.join(F.broadcast(bounded.filter("_target and not _fit")), F.col("id") == F.col("_label_id")).select("log_weight")
        n = own.count()
        edge = kth_largest(own, n - int(missed * n)) if n else None
        k = scores.count() if edge is None else scores.filter(F.col("log_weight") >= edge).count()
    edge = kth_largest(scores.select("key"), k)
    return ratio, float("-inf") if edge is None else edge, scores


def sampled(docs: DataFrame, labels: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are in the sample, with all their columns."""
    ratio, edge, _ = resample(docs, labels, seed=seed, id_col=id_col, text_col=text_col, **how)
    name = fresh(docs, "_weight")
    return with_weights(docs, ratio, text_col, name).filter(F.col(name) + gumbel(F.col(id_col), seed, F.col(text_col)) >= F.lit(edge)).select(*docs.columns)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    _, edge, scores = resample(docs, labels)
    return scores.filter(F.col("key") >= F.lit(edge)).select(F.col("id").alias("doc_id"), "log_weight", "key")
