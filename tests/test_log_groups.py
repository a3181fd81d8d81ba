"""Logs whose text is too much at once are rendered, scanned and removed group by group."""

import pytest

from tests.compare import check, connect
from timberline.plans import log_entries as L
from timberline.plans import queries, stored  # noqa: F401  they register what they have
from timberline.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, fits", [("stitch_entries", False), ("parse_fields", False), ("stitch_preamble", True), ("number_lines", True), ("detect_headers", True), ("worker_errors", False)])
def test_groups_of_logs(spark, monkeypatch, name, fits):
    sizes, gone = [], []
    rendered, remove = L._rendered, L.remove

    def seen(rows, spark, sf, n):
        assert len(gone) == len(sizes)  # the text before has gone
        sizes.append(rows.agg({"size": "sum"}).first()[0])
        return rendered(rows, spark, sf, n)

    monkeypatch.setattr(L, "RENDERED_BYTES", 1_200_000)
    monkeypatch.setattr(L, "_fits", lambda d: fits)
    monkeypatch.setattr(L, "_rendered", seen)
    monkeypatch.setattr(L, "remove", lambda spark, path: gone.append(path) or remove(spark, path))
    check(QUERIES[name](spark, SF), connect(SF), SQL[name])
    assert len(sizes) >= 2 and max(sizes) < 0.8 * sum(sizes)


def test_parsed_fields_have_contents(spark):
    """All fields of an entry are read from its text, the content among them."""
    got = QUERIES["parse_fields"](spark, SF)
    assert sorted(got.columns) == sorted(queries.FIELDS)
    assert got.agg({"content": "count"}).first()[0] == connect(SF).sql("SELECT count(*) FROM events").fetchall()[0][0]
