"""Near duplicates are compared word by word, and rows are told apart by id and text."""

import random

import corpus_pipeline
from timberline.llm import exact_dedup, simhash

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return not (a | b) or len(a & b) >= 0.8 * len(a | b)


def plain(rows):
    """The rows (id, text) that stay: those without a row like them that stays and has a smaller id."""
    stay = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = shingles(t)
        if not any(alike(own, other) for *_, other in stay):
            stay.append((i, t, own))
    return sorted(i for i, *_ in stay)


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert {80, 141} <= set(got)  # 4 bits apart, similarity 0.64


def test_rounds_of_leaders(spark, monkeypatch):
    """Chains of ever more edits, one word at a time, with few leaders and small parts."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = f"n{i}"
    monkeypatch.setattr(simhash, "PART", 7)
    _, gone = simhash.unlike(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, radius=6, leaders=2)
    gone = {r.sig for r in gone.collect()}
    sigs = {r.id: r.sig for r in simhash._marks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2, 5).collect()}
    assert sorted(i for i in sigs if sigs[i] not in gone) == plain(rows)

def test_missing_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, a), (2, d), (3, d), (3, e), (3, e)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, size int")
    got = simhash.keep_one(df).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (None, b), (None, c), (2, d), (3, e)], key=str)
    exact = exact_dedup.keep_first(df).select("doc_id", "text").collect()
    assert sorted(map(tuple, exact), key=str) == sorted([(1, a), (None, b), (None, c), (2, d), (3, e)], key=str)


def test_recall_on_ten_thousand_documents(spark):
    """Against all pairs of a larger table, which rare shingles find in plain Python."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: {hash(x) for x in shingles(r.text)} for r in docs.select("doc_id", "text").collect()}
    counts = {}
    for own in sets.values():
        for x in own:
            counts[x] = counts.get(x, 0) + 1
    gone, stay = set(), {}
    for i in sorted(sets):
        own = sets[i]
        rare = sorted(own, key=lambda x: (counts[x], x))[: len(own) - -(-len(own) * 8 // 10) + 1]
        near = {j for x in rare for j in stay.get(x, ())}
        if any(alike(own, sets[j]) for j in near):
            gone.add(i)
        else:
            for x in rare:
                stay.setdefault(x, []).append(i)
    got = set(sets) - {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id").collect()}
    assert len(gone) > 300 and len(got & gone) >= 0.98 * len(gone) and len(got & gone) >= 0.98 * len(got)
