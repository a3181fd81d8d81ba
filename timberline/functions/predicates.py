"""Search predicates: Columns over analysed entries, composed with ``&``, ``|`` and ``~``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.text import words_of


def _tokens(field: str) -> Column:
    return F.col("flags" if field == "flag" else f"{field}_tokens")


def _sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def bound(value: Column, test) -> Column:
    """``test`` of a value that is computed once per row, however often the test names it."""
    return F.exists(F.array(value), test)


def _wanted(text: str) -> list[tuple[int, str]]:
    """(place, word) of a search text's words, analysed as texts are; stop words have a place and no word."""
    return [(i, w) for i, w in enumerate(words_of(text)) if w is not None]


def term(word: str, field: str = "content") -> Column:
    """The word is in the field. Text fields are searched for what the word is analysed to, whatever its case; flags as they are.

    A word that is analysed to several is a phrase. One that is only stop words is no clause: like a blank search, it holds for every entry.
    """
    if field == "flag":
        return _sure(F.array_contains(_tokens(field), word))
    wanted = _wanted(word)
    if len(wanted) > 1:
        return phrase(word, field)
    return _sure(F.array_contains(_tokens(field), wanted[0][1])) if wanted else F.lit(True)


def any_term(words: list[str], field: str = "content") -> Column:
    """One of the words is in the field, each as in :func:`term`; the field's tokens are computed once for all single words. Stop words are no clauses."""
    found = [(w, [w] if field == "flag" else [x for _, x in _wanted(w)]) for w in words]
    single, several = [x[0] for _, x in found if len(x) == 1], [w for w, x in found if len(x) > 1]
    tests = [_sure(F.arrays_overlap(_tokens(field), F.array(*map(F.lit, single))))] if single else []
    tests += [phrase(w, field) for w in several]
    return reduce(Column.__or__, tests) if tests else F.lit(True)


def shifted(places: Column, offset: int) -> Column:
    return F.transform(places, lambda i: i - offset)


def shifts_meet(places: list[Column], offsets: list[int]) -> Column:
    """Whether some start has each word at its offset; ``places`` has the words' places as arrays."""
    return F.size(reduce(F.array_intersect, map(shifted, places, offsets))) > 0


def near(spots: Column, wanted: list[tuple[int, str]], slop: int) -> Column:
    """Whether the words stand near each other in a sorted array of (place, word), the places of all wanted words.

    Each word of the phrase gets a place of its own, even where two are the same word; the places, each less the word's place in the
    phrase, lie within ``slop`` of each other. All places of one such match lie within the phrase's length and ``slop``, and no two words
    share one, so from each place on only so many are looked at: the work grows with the number of places.
    """
    offsets = {w: [o for o, x in wanted if x == w] for _, w in wanted}
    reach = max(o for o, _ in wanted) - min(o for o, _ in wanted) + slop + 1

    def placed(part: Column, x: Column) -> Column:
        """Each word's places take its offsets in ascending order; an offset that is passed by stays open, and so do all after it."""

        def all_of(w: str, own: list[int]) -> Column:
            at = F.array(*map(F.lit, own))
            taken = lambda k, s: F.get(at, k) + x
            step = lambda k, s: k + F.when((s["word"] == w) & (s["place"] >= taken(k, s)) & (s["place"] <= taken(k, s) + slop), 1).otherwise(0)
            return F.aggregate(part, F.lit(0), step) == len(own)

        return _all([all_of(w, own) for w, own in offsets.items()])

    def from_here(i: Column) -> Column:
        part = F.slice(spots, i, F.lit(reach))
        starts = F.flatten(F.transform(part, lambda s: F.array(*[F.when(s["word"] == w, s["place"] - o) for o, w in wanted])))
        return bound(part, lambda p: F.exists(F.array_distinct(F.array_compact(starts)), lambda x: placed(p, x)))

    return F.when(F.size(spots) >= len(wanted), F.exists(F.sequence(F.lit(1), F.size(spots)), from_here)).otherwise(False)


def phrase(text: str, field: str = "content", slop: int = 0) -> Column:
    """The words stand in a row, with any word where the text has a stop word; with ``slop``, they stand :func:`near` each other.

    A phrase of stop words alone is found nowhere.
    """
    wanted = _wanted(text)
    if not wanted:
        return F.lit(False)
    words = sorted({w for _, w in wanted})

    def places(t: Column, w: str) -> Column:
        return F.filter(F.transform(t, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())

    def found(t: Column) -> Column:
        if slop:
            spots = F.filter(F.transform(t, lambda x, i: F.when(x.isin(*words), F.struct(i.alias("place"), x.alias("word")))), lambda s: s.isNotNull())
            meets = bound(spots, lambda s: near(s, wanted, slop))
        else:
            meets = shifts_meet([places(t, w) for _, w in wanted], [o for o, _ in wanted])
        return _all([F.array_contains(t, w) for w in words]) & meets

    return _sure(bound(_tokens(field), found))


def prefix(start: str, field: str = "content") -> Column:
    return _sure(F.exists(_tokens(field), lambda x: _sure(x.startswith(start.lower()))))


def wildcard_form(pattern: str) -> str:
    """A wildcard pattern as a regular expression of whole tokens."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.lower()) + "$"


def wildcard(pattern: str, field: str = "content") -> Column:
    """``*`` is any run of characters, ``?`` one character; neither may stand first."""
    if pattern[:1] in ("*", "?"):
        raise ValueError("a wildcard may not stand first")
    return _sure(F.exists(_tokens(field), lambda x: _sure(x.rlike(wildcard_form(pattern)))))


def fuzzy(word: str, field: str = "content", least: float = 0.5) -> Column:
    """A token whose similarity, 1 - edits / the shorter length, is over ``least``."""
    word = word.lower()
    return _sure(F.exists(_tokens(field), lambda x: _sure(1 - F.levenshtein(x, F.lit(word)) / F.least(F.length(x), F.lit(len(word))) > least)))


def text_range(low: str, high: str, field: str = "content", inclusive: bool = True) -> Column:
    """A token between two texts, by code points."""
    inside = (lambda x: (x >= low) & (x <= high)) if inclusive else (lambda x: (x > low) & (x < high))
    return _sure(F.exists(_tokens(field), lambda x: _sure(inside(x))))


#: Number fields by their search names.
NUMBERS = {"line": "line_number", "id": "id", "date": "date_key"}


def num_eq(field: str, n: int) -> Column:
    return _sure(F.col(NUMBERS[field]) == n)


def num_range(field: str, low: int | None = None, high: int | None = None, inclusive: bool = True) -> Column:
    """Both ends count, or neither; ``None`` is an open end."""
    c, parts = F.col(NUMBERS[field]), []
    if low is not None:
        parts.append(c >= low if inclusive else c > low)
    if high is not None:
        parts.append(c <= high if inclusive else c < high)
    return _sure(reduce(lambda a, b: a & b, parts)) if parts else F.lit(True)


def everything() -> Column:
    return F.lit(True)


def general_errors() -> Column:
    """Level error, or the word error or exception in the content."""
    return _sure(F.lower("level") == "error") | any_term(["error", "exception"])
