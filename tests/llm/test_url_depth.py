"""Templates of urls of any depth, against recursive SQL and in few rounds."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from tests.compare import check, connect
from timberline.llm import url_filter


def test_deep_and_odd_urls(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    deep = "/".join("s" + "abcdefghij"[k % 10] for k in range(200))
    urls = [(i, f"http://deep.net2/{deep}/{i}") for i in range(40)]
    urls += [(i, f"http://x.net2/{i}/" + "/".join("a" * rng.randint(1, 3) + rng.choice("bcdefgh") for _ in range(60))) for i in range(40, 90)]
    labels = []
    for i in range(90, 1500):
        a, b, c = rng.choice(["good", "bad", "mid"]), rng.choice("pqr"), rng.choice("uv")
        urls.append((i, f"http://h{i % 3}.com2/{a}/{b}/{i}/{c}" + rng.choice(["", "/z", "/", "//"])))
        labels.append((i, int(rng.random() < (0.9 if a == "good" else 0.1 if (a, b) == ("bad", "p") else 0.6 if c == "u" else 0.3)), 0))
    urls += [(9000, None), (9001, "no scheme"), (9001, "http://"), (None, f"http://deep.net2/{deep}"), *[(10_000 + i, f"http://deep.net2/{deep}") for i in range(30)]]
    pq.write_table(pa.table({"page_id": [i for i, _ in urls], "url": [u for _, u in urls]}), tmp_path / "pages.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, _, _ in labels], "quality": [q for _, q, _ in labels], "toxic": [t for _, _, t in labels]}), tmp_path / "labels.parquet")
    rounds, saved = [], url_filter.saved
    monkeypatch.setattr(url_filter, "saved", lambda df, name: rounds.append(name) or saved(df, name))
    found = url_filter.op7_url_templates(spark, str(tmp_path)).cache()
    assert rounds.count("level") <= 6
    check(found, connect(tmp_path), url_filter.OP7_SQL)
    assert found.filter("host = 'deep.net2' and template like '/sa/%' or template like '/*/%'").count() > 0
