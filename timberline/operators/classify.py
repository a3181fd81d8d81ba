"""Flags of entries, by a list of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.fields import trimmed

# The phrases that the rules look for.
DISK_SPACE = "Disk space message received"
WORKER_STATE = "Changing state"
PROCESS_KILLED = "Killing current process..."
PROBLEM_ITEM = "Problem processing item"
SESSION_CLOSED = "The Session is closed"


def content_rules(content: Column) -> dict[str, Column]:
    """The standard rules that look at the content alone."""
    starts = lambda text: F.lower(content).startswith(text.lower())
    return {
        "worker_state": content.contains(WORKER_STATE), "multi_line": content.contains("\n") | content.contains("\r"), "process_killed": starts(PROCESS_KILLED),
        "problem_processing_item": starts(PROBLEM_ITEM), "session_is_closed": content.contains(SESSION_CLOSED),
    }


def rules(vendor: str = "com.acme", memory: str = "monitoring.memory", script_by_channel: bool = False, known: dict[str, Column] | None = None) -> list[tuple[str, Column]]:
    """(flag, predicate) of the standard rules.

    ``vendor`` is the package that ``vendor_package`` looks for, ``memory`` what the memory monitor's source contains.
    ``script_by_channel``: scripts are told by the channel instead of the source. ``known``: what :func:`content_rules` found, where contents that many entries share were looked at once.
    """
    source, path = F.col("source"), F.col("file_path")
    return [
        ("disk_space", F.lower(source).contains(DISK_SPACE.lower())),
        ("memory", source.contains(memory)),
        ("vendor_package", F.lower(source).startswith(vendor.lower())),
        ("script", F.col("channel") == "SCRIPT" if script_by_channel else trimmed(source).startswith("SCRIPT")),
        ("worker_log", path.contains("job-") & path.rlike("(?i)job-[a-f0-9]{32}")),
        *(content_rules(F.col("content")) if known is None else known).items(),
    ]


def flags_of(found: list[tuple[str | None, Column]]) -> Column:
    """Different flags, lower case and in order. A rule without a name is an array of flags, null for none; null predicates don't hold."""
    named = [F.when(p, F.lit(flag.lower())) for flag, p in found if flag is not None]
    flags = F.array(*named) if named else F.array().cast("array<string>")
    lists = [F.coalesce(p, F.array().cast("array<string>")) for flag, p in found if flag is None]
    flags = reduce(lambda a, b: F.concat(a, F.transform(b, F.lower)), lists, flags)
    return F.array_sort(F.array_distinct(F.array_compact(flags)))


def classify(entries: DataFrame, found: list[tuple[str | None, Column]] | None = None) -> DataFrame:
    """Adds ``flags``. User rules are pairs (flag, boolean Column), or (None, array Column) for any number of flags, pandas UDFs among them."""
    return entries.withColumn("flags", flags_of(rules() if found is None else found))
