"""Field functions of entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.schema import LEVELS


def trimmed(col: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


#: White space within a line, and as many plain spaces.
_BLANKS, _SPACES = "\t\x0b\f\r", "    "
_DIGITS, _ZEROS = "0123456789", "0000000000"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once per row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _is_time(text: Column) -> Column:
    """Whether a text has the shape 0000-00-00 00:00:00.0 +0000, with any number of digits after the dot and a sign or none."""

    def shaped(shape: Column) -> Column:
        rest = shape.substr(21, 1 << 20)
        fraction, zone = F.substring_index(rest, " ", 1), F.substring_index(rest, " ", -1)
        only = (fraction != "") & (F.replace(fraction, F.lit("0"), F.lit("")) == "") & zone.isin("0000", "+0000", "-0000")
        return (shape.substr(1, 20) == "0000-00-00 00:00:00.") & only & rest.contains(" ") & (F.replace(rest, F.lit(" "), F.lit("")) == F.concat(fraction, zone))

    return let(F.translate(text, _DIGITS, _ZEROS), shaped)


def _rest_of_header(flat: Column, opened: Column) -> Column:
    """Where the fields after the channel's bracket lie, as a struct; null where they don't follow any closing bracket.

    The line is cut at its closing brackets. Behind each of them a number, a level and a source may start; of those where they do, the last one ends the channel.
    """
    size = F.length(flat)

    def at(pieces: Column, k: Column) -> Column:
        piece = F.get(pieces, k)
        elapsed = F.substring_index(piece, " ", 1)
        after = piece.substr(F.length(elapsed) + 2, F.length(piece))
        level = F.substring_index(after, " ", 1)
        looks = (elapsed != "") & (F.translate(elapsed, _DIGITS, "") == "") & F.lower(level).isin(*[x.lower() for x in LEVELS]) & (F.length(after) > F.length(level))
        channel = F.array_join(F.slice(pieces, F.lit(1), k), "] ")
        start = opened + 3 + F.length(channel)
        spot = F.struct(channel.alias("channel"), start.alias("start"), F.length(elapsed).alias("elapsed"), F.length(level).alias("level"))
        return F.when(looks, spot)

    def with_source(spot: Column) -> Column:
        source = flat.substr(spot["start"] + spot["elapsed"] + spot["level"] + 2, size)
        dash = F.instr(source, "-")
        fits = (dash >= 3) & (source.substr(dash - 1, F.lit(3)) == " - ") & (spot["channel"] != "") & ~spot["channel"].contains("\\")
        return F.when(fits, F.struct(F.length(spot["channel"]).alias("channel"), spot["start"].alias("start"), spot["elapsed"].alias("elapsed"), spot["level"].alias("level"), dash.alias("dash")))

    def last(pieces: Column) -> Column:
        spots = F.array_compact(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: at(pieces, k)))
        fitting = F.array_compact(F.transform(spots, with_source))
        return F.when(F.size(pieces) > 1, F.try_element_at(fitting, F.lit(-1)))

    return let(F.split(flat.substr(opened + 1, size), r"\] ", -1), last)


def header(line: Column | str = "value") -> Column:
    """The fields of a header line as a struct of texts (time, channel, elapsed, level, source, content); null for any other line.

    A header is ``<time with offset> [<channel>] <milliseconds> <level> <source> - <content>``. The time has its places for digits; the level is one of the five, in any case.
    The channel may hold brackets, but no backslash: it reaches to the last bracket after which the rest fits. The source reaches to the first hyphen after the level, which has to
    stand between blanks.
    """
    line = F.col(line) if isinstance(line, str) else line

    def fields(flat: Column) -> Column:
        opened, size = F.instr(flat, "["), F.length(flat)
        before = flat.substr(F.lit(1), opened - 1)

        def cut(s: Column) -> Column:
            level = s["start"] + s["elapsed"] + 1
            source = level + s["level"] + 1
            return F.struct(
                F.rtrim(before).alias("time"), line.substr(opened + 1, s["channel"]).alias("channel"), line.substr(s["start"], s["elapsed"]).alias("elapsed"),
                line.substr(level, s["level"]).alias("level"), line.substr(source, s["dash"] - 2).alias("source"), line.substr(source + s["dash"] + 1, size).alias("content"),
            )

        timed = (opened > 1) & before.endswith(" ") & _is_time(F.rtrim(before))
        return F.when(timed, let(_rest_of_header(flat, opened), lambda s: F.when(s.isNotNull(), cut(s))))

    return F.when(line.startswith("20"), let(F.translate(line, _BLANKS, _SPACES), fields))  # the cheap test first


def parse_timestamp(text: Column | str) -> Column:
    """Instant of ``yyyy-MM-dd HH:mm:ss.SSS ±hhmm``; null unless it has three digits and an offset with a sign."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"\.\d{3} [+-]\d{4}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS Z")))


def parse_elapsed(text: Column | str) -> Column:
    """Milliseconds; null if they don't fit."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("bigint")


def date_key(ts: Column | str = "ts") -> Column:
    """The day as yyyymmdd, in the session's time zone."""
    return F.date_format(ts, "yyyyMMdd").cast("long")


def content_key(content: Column | str = "content") -> Column:
    """16 bytes that tell contents apart; null for null."""
    return F.substring(F.unhex(F.sha2(F.col(content) if isinstance(content, str) else content, 256)), 1, 16)


def content_brief(content: Column | str = "content", most: int = 500) -> Column:
    """One line of at most ``most`` characters; of more, one character less and four dots."""
    line = F.translate(content, "\n\r", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("...."))).otherwise(line)


def to_log_line() -> Column:
    """The entry as log text."""
    elapsed, level = F.col("elapsed_ms").cast("string"), F.rpad("level", F.greatest(F.length("level"), F.lit(5)), F.lit(" "))
    return F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS Z"), F.lit(" ["), "channel", F.lit("] "), elapsed, F.lit(" "), level, F.lit(" "), "source", F.lit(" - "), "content")


def file_label(file_name: Column | str, file_id: Column | str) -> Column:
    return F.concat(file_name, F.lit("("), F.col(file_id) if isinstance(file_id, str) else file_id, F.lit(")"))


def flags_to_text(flags: Column | str = "flags") -> Column:
    return F.array_join(flags, " ")


def flags_from_text(text: Column | str) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


#: Microseconds from 1601-01-01 to 1970-01-01, UTC.
_EPOCH = 11_644_473_600_000_000


def to_filetime(ts: Column | str = "ts") -> Column:
    """Ticks of 100 ns since 1601-01-01 UTC."""
    return (F.unix_micros(ts) + _EPOCH) * 10


def from_filetime(ticks: str) -> Column:
    return F.expr(f"timestamp_micros(`{ticks}` div 10 - {_EPOCH})")
