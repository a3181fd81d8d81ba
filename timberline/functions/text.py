"""Tokens of text fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.schema import ACRONYM, LONE, STOP_WORDS, TOKEN

TEXT_FIELDS = ("content", "channel", "level", "source")


def tokens(text: Column | str) -> Column:
    """Lower-case words in order, without a possessive 's and without the dots of acronyms; stop words are null slots, so that positions stay.

    Each Chinese or Japanese character is a word.
    """
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.regexp_replace(F.lower(text), LONE, " $0 "), F.lit(TOKEN), F.lit(0))
    cut = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    dotless = lambda x: F.when(x.rlike(ACRONYM), F.translate(x, ".", "")).otherwise(cut(x, 1))
    found = F.transform(found, lambda x: F.when(x.endswith("."), dotless(x)).when(x.endswith("'s"), cut(x, 2)).otherwise(x))
    return F.transform(found, lambda x: F.when(~x.isin(*STOP_WORDS), x))


def words_of(text: str) -> list[str | None]:
    """The same of a search text, on the driver: ``None`` for stop words."""
    import regex

    words = [(x.replace(".", "") if regex.match(ACRONYM, x) else x[:-1]) if x.endswith(".") else x.removesuffix("'s") for x in regex.findall(TOKEN, regex.sub(LONE, r" \g<0> ", text.lower()))]
    return [None if x in STOP_WORDS else x for x in words]


def analyse(entries: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Adds ``<field>_tokens`` for each field. Flags are tokens already."""
    return entries.withColumns({f"{f}_tokens": tokens(f) for f in fields})


def text_key(tokens: Column) -> Column:
    """16 bytes that tell lists of tokens apart, null slots included; null for null. Tokens have no control characters."""
    return F.unhex(F.md5(F.array_join(tokens, "\x01", "\x00").cast("binary")))


def _grouped(tokens: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """(row, term, positions) of a column of token lists, one entry for each row and different token; null slots have no term."""
    slots = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    flat, row = tokens.flatten(), np.repeat(np.arange(len(tokens)), slots)
    at = np.arange(len(row)) - np.repeat(np.cumsum(slots) - slots, slots) + 1
    coded = flat.dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, at, code = row[code >= 0], at[code >= 0], code[code >= 0]
    key = row * max(1, len(coded.dictionary)) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(at[order], pa.int32()))
    return row[order[first]], coded.dictionary.take(pa.array(code[order[first]])), lists


def postings(analysed: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """(field, term, id, positions): where each term stands, from 1; ``id`` names one entry.

    One pass over the entries, whose tokens are grouped where they are: nothing is shuffled. Grouping by (id, field, term) in SQL sorts every single token and takes several times as long.
    """
    names = [*fields, "flag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(names):
                row, term, lists = _grouped(batch.column(k + 1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(row), pa.string()), term, batch.column(0).take(pa.array(row)), lists], names=["field", "term", "id", "positions"])

    rows = analysed.select("id", *["flags" if f == "flag" else f"{f}_tokens" for f in names])
    return rows.mapInArrow(run, f"field string, term string, id {rows.schema['id'].dataType.simpleString()}, positions array<int>")


def with_term(entries: DataFrame, posted: DataFrame, word: str, field: str = "content") -> DataFrame:
    """The entries that a table of postings names for a word; their texts aren't looked at. A table that is stored by field and term reads that term's rows only.

    The word is analysed as texts are; a stop word is looked up as it is, and has no postings. A word that is analysed to several is a phrase, for
    which :mod:`timberline.operators.index` has a search.
    """
    wanted = [word] if field == "flag" else [w for w in words_of(word) if w is not None] or [word.lower()]
    if len(wanted) > 1:
        raise ValueError(f"{word!r} is a phrase of {len(wanted)} words")
    return entries.join(posted.filter((F.col("field") == field) & (F.col("term") == wanted[0])).select("id"), "id", "left_semi")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))
