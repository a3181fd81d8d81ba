"""The chain's fit against a plain version in Python floats, its kinds on held-out documents, and noise of rows without an id."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import importance, toxicity


def expit(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def plain_linear(docs, dense, y, use, rounds=60, penalty=4.0):
    """Weights by word, weights of the dense columns, and the bias: gradient steps over documents one by one."""
    rows = [i for i in range(len(docs)) if use[i]]
    n, good = max(1, len(rows)), sum(y[i] for i in rows)
    base, rate = math.log((good + 1) / (n - good + 1)), good / n
    scale = {}
    for w in {w for i in rows for w in docs[i]}:
        total, positive = sum(w in docs[i] for i in rows), sum(y[i] for i in rows if w in docs[i])
        apart = abs(positive - total * rate) / math.sqrt(total * rate * (1 - rate) + 1e-9)
        if total >= 3 and apart >= toxicity.APART:
            scale[w] = math.log((positive + 0.5) / (total - positive + 0.5)) - base
    width = len(dense[0])
    names = [*scale, *range(width), "bias"]
    theta, m, v = (dict.fromkeys(names, 0.0) for _ in range(3))
    for t in range(1, rounds + 1):
        g = {k: penalty * theta[k] / n for k in names}
        for i in rows:
            z = sum(theta[w] * scale[w] for w in docs[i] if w in scale) + sum(theta[k] * dense[i][k] for k in range(width)) + theta["bias"] + base
            miss = (expit(z) - y[i]) / n
            for w in docs[i]:
                if w in scale:
                    g[w] += miss * scale[w]
            for k in range(width):
                g[k] += miss * dense[i][k]
            g["bias"] += miss
        for k in names:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            theta[k] -= 0.3 / (1 + 0.02 * t) * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return {w: theta[w] * scale[w] for w in scale}, [theta[k] for k in range(width)], theta["bias"] + base


def test_fit_against_plain():
    rng = random.Random(11)
    docs, labels = [], []
    for _ in range(160):
        a, b = rng.random() < 0.4, rng.random() < 0.5
        docs.append(sorted({*rng.sample(range(20, 60), 6), *([1, 2] if a and rng.random() < 0.9 else []), *([3] if a and b else []), *([4] if not a else [])}))
        labels.append([a, a and b])
    row, col = np.array([(i, w) for i, d in enumerate(docs) for w in d]).T
    folds = 4
    chain = toxicity.Chain(row, col, np.array(labels), folds=folds, buckets=64)
    dense = [[] for _ in docs]
    for c in range(2):
        y, out = [float(x[c]) for x in labels], [0.0] * len(docs)
        for f in range(folds):
            w, d, bias = plain_linear(docs, dense, y, [i % folds != f for i in range(len(docs))])
            for i in range(f, len(docs), folds):
                out[i] = expit(sum(w.get(x, 0.0) for x in docs[i]) + sum(a * b for a, b in zip(d, dense[i])) + bias)
        w, d, bias = plain_linear(docs, dense, y, [True] * len(docs))
        model = chain.models[c]
        assert model.bias == pytest.approx(bias, abs=1e-9) and model.dense.tolist() == pytest.approx(d, abs=1e-9)
        assert {k: x for k, x in enumerate(model.weights.tolist()) if x} == pytest.approx({k: x for k, x in w.items() if x}, abs=1e-9)
        assert chain.held_out[:, c].tolist() == pytest.approx(out, abs=1e-9)
        for i, x in enumerate(out):  # later models see predictions of models that the row wasn't in
            dense[i] = [*dense[i], x]


def test_kinds_on_held_out(spark):
    own, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = own.join(known.select("doc_id", "toxic"), "doc_id")
    held = {r.doc_id: r for r in rows.filter("doc_id % 5 >= 3").select("doc_id", "text", "toxic").collect()}
    got = {r.doc_id: r for r in toxicity.toxicity(rows.select("doc_id", "text"), known.filter("doc_id % 5 < 3")).collect()}
    for kind in ("insult", "contempt"):
        form = re.compile(r"\b(?:" + "|".join(toxicity.CATEGORIES[kind][1]) + r")\b", re.I)
        true = {i for i, r in held.items() if r.toxic == 1 and form.search(r.text)}
        said = {i for i in held if got[i][f"is_{kind}"]}
        assert len(true & said) > 0.85 * len(true) and len(true & said) > 0.8 * len(said)


def test_rows_without_an_id_have_noise_of_their_own(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (None, None), (None, ""), (1, "a"), (1, "b")], "doc_id long, text string")
    noise = [r.g for r in df.select(importance.gumbel(F.col("doc_id"), 17, F.col("text")).alias("g")).collect()]
    assert noise[0] == noise[1] != noise[2] and noise[3] == noise[4] != noise[0] and noise[5] == noise[6]
