"""Benchmark passages in very long texts and in rows that are repeated very often."""

import time

from timberline.llm import decontaminate


def test_a_text_of_a_million_words_and_ten_thousand_repeated_rows(spark):
    two = "red blue " * 500_000
    repeated = "green grass and red blue red blue red blue red blue red blue here"
    rows = [(1, two)] + [(2, repeated)] * 5000 + [(None, repeated)] * 5000 + [(3, "red blue " * 4), (4, "nothing at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    items = spark.createDataFrame([(7, "red blue red blue red blue red blue red blue"), (8, "grass and")], "item_id long, text string")
    began = time.time()
    found = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])): r["count"] for r in decontaminate.contamination(docs, items).groupBy("doc_id", "n_words", "n_hit", "items").count().collect()}
    assert found == {(1, 1_000_000, 1_000_000, ("7",)): 1, (2, 14, 12, ("7", "8")): 5000, (None, 14, 12, ("7", "8")): 5000, (3, 8, 0, ()): 1, (4, 3, 0, ()): 1}
    assert time.time() - began < 120
    assert decontaminate.clean(docs, items).count() == 2
