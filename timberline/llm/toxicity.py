"""Toxicity by a classifier chain: linear models in a row, each of which also sees the earlier categories' probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import saved
from timberline.llm.importance import bounded_labels
from timberline.llm.textbytes import LETTERS, LOWER, Rolling, chunks, words

#: Buckets that words are hashed to.
BUCKETS = 1 << 18
#: Labelled rows that the chain is fitted on at most, taken by a hash of the id.
LABEL_ROWS = 20_000
#: Different words that those rows have together at most; rows are taken in the order of the hashes while they fit. Bounds what reaches the driver to 64 MB.
LABEL_WORDS = 16_000_000
FOLDS = 4
#: Standard deviations by which a word's count in a category must differ from chance to be used.
APART = 5.0

_ROLL = Rolling(0xA24BAED4963EE407)

#: Toxicity categories as a chain, in this order: toxic at all, as labelled; then two kinds of it, which the labels don't tell apart: a toxic document is of a kind if its
#: text has one of the kind's words. Words for persons, words of contempt. The models learn what else goes with them.
CATEGORIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "toxic": ("toxic = 1", ()),
    "insult": ("toxic = 1", ("clown", "idiot", "loser", "moron", "scum")),
    "contempt": ("toxic = 1", ("disgusting", "pathetic", "stupid", "trash", "worthless")),
}


def _named(words_of_kind: tuple[str, ...], text: Column) -> Column:
    """Whether a text has one of the words, in any case; without words, every text has."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)\b(?:" + "|".join(words_of_kind) + r")\b") if words_of_kind else F.lit(True)


def word_buckets(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each document's different words, upper and lower case alike."""
    folded = LOWER[data]
    start, end, doc = words(folded, at, LETTERS)
    hashed = _ROLL.spans(_ROLL.sums(folded), start, end) % np.uint64(buckets)
    both = np.unique(doc * buckets + hashed.astype(np.int64))
    return both // buckets, both % buckets


def _expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression on presence of words, scaled by their log-count ratio, and on a few dense columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, use: np.ndarray, buckets: int, rounds: int = 60, penalty: float = 4.0):
        n = max(1, int(use.sum()))
        entry = use[row]
        row, col = row[entry], col[entry]
        positive = np.bincount(col, weights=y[row], minlength=buckets)
        total = np.bincount(col, minlength=buckets)
        base = np.log((y[use].sum() + 1) / (n - y[use].sum() + 1))
        scale = np.log((positive + 0.5) / (total - positive + 0.5)) - base
        rate = y[use].sum() / n
        apart = np.abs(positive - total * rate) / np.sqrt(total * rate * (1 - rate) + 1e-9)
        scale[(total < 3) | (apart < APART)] = 0  # words that tell nothing only add noise
        keep = scale[col] != 0
        row, col = row[keep], col[keep]
        width = dense.shape[1]
        theta, m, v = np.zeros(buckets + width + 1), 0.0, 0.0
        for t in range(1, rounds + 1):
            z = np.bincount(row, weights=(theta[:buckets] * scale)[col], minlength=len(y)) + dense @ theta[buckets:-1] + theta[-1] + base
            miss = np.where(use, _expit(z) - y, 0) / n
            g = np.concatenate([np.bincount(col, weights=miss[row], minlength=buckets) * scale, miss @ dense, [miss.sum()]]) + penalty * theta / n
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= 0.3 / (1 + 0.02 * t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.dense, self.bias = theta[:buckets] * scale, theta[buckets:-1], theta[-1] + base

    def logits(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.weights[col], minlength=len(dense)) + dense @ self.dense + self.bias


class Chain:
    """One linear model per category; ``edges`` are the probabilities with the best F1 on out-of-fold predictions."""

    def __init__(self, row: np.ndarray, col: np.ndarray, labels: np.ndarray, folds: int = FOLDS, buckets: int = BUCKETS):
        n, self.models, self.edges, self.held_out = len(labels), [], [], np.zeros(labels.shape)
        fold, everything, seen = np.arange(n) % folds, np.ones(n, bool), np.zeros((n, 0))
        for c in range(labels.shape[1]):
            y, out = labels[:, c].astype(float), np.zeros(n)
            for f in range(folds):
                part = Linear(row, col, seen, y, fold != f, buckets)
                out = np.where(fold == f, part.logits(row, col, seen), out)
            self.models.append(Linear(row, col, seen, y, everything, buckets))
            self.held_out[:, c] = _expit(out)
            order = np.argsort(-self.held_out[:, c], kind="stable")
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, n + 1) + y.sum())
            if y.any():  # half way, in logits, from the last that is flagged to the first that isn't
                k = int(f1.argmax())
                self.edges.append(float(_expit((out[order[k]] + out[order[min(k + 1, n - 1)]]) / 2)))
            else:
                self.edges.append(2.0)
            seen = np.column_stack([seen, _expit(out)])  # later models learn from predictions for rows that their maker hadn't seen

    def predict(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        seen = np.zeros((n, 0))
        for model in self.models:
            seen = np.column_stack([seen, _expit(model.logits(row, col, seen))])
        return seen


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, tuple[str, ...]]] = CATEGORIES, label_rows: int = LABEL_ROWS, label_words: int = LABEL_WORDS, folds: int = FOLDS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain for the categories (name -> condition on a labelled row, and words of which its text has one, if any), from at most ``label_rows`` labelled rows with ``label_words`` words.

    What reaches the driver is bounded by that: for each such row the buckets of its different words.
    """
    bounded = saved(bounded_labels(labels, {n: F.expr(rule) for n, (rule, _) in categories.items()}, label_rows, id_col).select(F.col("id").alias("_label_id"), F.array(*categories).alias("flags")), "labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(bounded), F.col("id") == F.col("_label_id"))
    flags = F.array(*[F.get("flags", F.lit(i)) & _named(kind, F.col("text")) for i, (_, kind) in enumerate(categories.values())])
    rows = rows.select("id", flags.alias("flags"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            doc, found = word_buckets(data, at, buckets)
            cut = np.searchsorted(doc, np.arange(1, batch.num_rows))
            packed = [x.astype("<i4").tobytes() for x in np.split(found, cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "flags", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, flags array<boolean>, words binary").groupBy("id").agg(F.min(F.struct("words", "flags")).alias("one")).select("id", "one.*")  # of an id with several texts always the same
    order = Window.orderBy(F.xxhash64("id"), "id")  # of at most label_rows rows
    found = found.withColumn("total", F.sum(F.octet_length("words") / 4).over(order)).filter(F.col("total") <= label_words).orderBy(F.xxhash64("id"), "id").toArrow()
    lists = [np.frombuffer(x, "<i4") for x in found.column("words").to_pylist()]
    flat = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return Chain(row, flat, np.array(found.column("flags").to_pylist(), bool).reshape(len(lists), len(categories)), folds, buckets)


def scored(docs: DataFrame, chain: Chain, names: list[str], id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: id, a probability ``p_<name>`` and a flag ``is_<name>`` for each category."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            p = sent.value.predict(*word_buckets(data, at, buckets), batch.num_rows)
            columns = [pa.array(x) for c in range(len(names)) for x in (p[:, c], p[:, c] >= sent.value.edges[c])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(f"{k}_{n}" for n in names for k in ("p", "is"))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {rows.schema['id'].dataType.simpleString()}", *(f"`p_{n}` double, `is_{n}` boolean" for n in names)]))


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, tuple[str, ...]]] = CATEGORIES, **how) -> DataFrame:
    """Chain fitted and applied to every whole text of ``docs``.

    Null and empty texts have no words and get the base rates. Rows that repeat an id are scored each; one of them, always the same, is
    learned from. Null labels count as not in the category, labels of unknown documents for nothing, and an id that
    is labelled twice is in a category if one of its labels says so. Without labels, or with an empty table of them, nothing is flagged; an empty
    table of documents gives an empty result. Other columns are not read.
    """
    return scored(docs, fit(docs, labels, categories, **how), list(categories))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
