"""The pipeline against plain versions of its stages, and its stages on odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_near_duplicates import plain as unlike
from tests.llm.test_operators import CLASHES, odd_rows, token_rows
from timberline.llm import importance

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def good_ids(spark, docs):
    """The importance sample, from n-grams, labels and the hashes of the ids."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    fit, held = ({r.doc_id for r in known.filter(f"xxhash64(doc_id, 17) % 2 {x} 0").collect()} for x in ("=", "<>"))

    def grams(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return importance.ngrams(data, np.array([0, len(data)]))[1]

    weights = plain.log_weights({i: grams(t or "") for i, t in texts.items()}, fit, importance.BUCKETS)
    hashed = {r.doc_id: (r.h % (1 << 64)) >> 11 for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    keys = {i: w - np.log(-np.log((hashed[i] + 0.5) / 2**53)) for i, w in weights.items()}
    return plain.sample(list(texts), keys, weights, held)


def test_stages(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    first = stages["quality"](spark, docs, SF)
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == good_ids(spark, docs) and first.columns == docs.columns

    second = stages["near_duplicates"](spark, first, SF)
    unique = {r.doc_id: r for r in second.collect()}
    assert sorted(unique) == unlike([(i, r.text) for i, r in rows.items()]) and second.columns == docs.columns

    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(item.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def hit(t):
        w = words(t)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    third = stages["decontamination"](spark, second, SF)
    kept = {r.doc_id: r for r in third.collect()}
    assert set(kept) == {i for i, r in unique.items() if not hit(r.text)} and third.columns == docs.columns

    fourth = stages["mixture"](spark, third, SF)
    copies = plain.mix([(r.doc_id, r.source, r.text) for r in kept.values()])
    mixed = sorted(r.doc_id for r in fourth.collect())
    assert mixed == sorted(i for i, n in copies.items() for _ in range(n)) and fourth.columns == docs.columns

    last = sorted(map(tuple, stages["token_files"](spark, fourth, SF).collect()), key=lambda r: r[1])
    assert last == token_rows([(i, kept[i].text) for i in mixed])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == last
    assert last[0][3] == zlib.crc32(np.array([*token_ids(kept[last[0][0]].text), 2], "<u4").tobytes())


def token_ids(text):
    from timberline.llm.token_output import Encoder

    return next(iter(Encoder()([text]))).tolist()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names, and an empty table."""
    odd, stage = odd_rows(spark).unionByName(odd_rows(spark).limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd_rows(spark).schema])), dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SF)
    rows = got.collect()
    if name == "token_files":
        assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows if r.doc_id is not None) == sorted((i, n, c) for i, _, n, c in token_rows([(r.doc_id, r.text) for r in odd.collect()]) if i is not None) and len(rows) == odd.count()
    else:
        assert got.columns == odd.columns and {c for r in rows if r.doc_id is not None for c in (r[CLASHES[0]],)} <= {f"clash {CLASHES[0]}"}
        have = {tuple(r)[:2] for r in odd.collect()}
        assert {tuple(r)[:2] for r in rows} <= have
    if name == "near_duplicates":  # one of each text
        assert len(rows) == len({r.text for r in rows}) and {r.doc_id for r in rows} == {1, 4, 5, 6, 8, 10} | ({11} & {r.doc_id for r in rows})
    if name == "decontamination":  # nothing of it is in the benchmark
        assert len(rows) == odd.count()
    assert stage(spark, odd.filter("false"), SF).count() == 0
