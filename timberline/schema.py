"""Shapes and patterns of log entries."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampType

LEVELS = ("INFO", "WARN", "ERROR", "DEBUG", "TRACE")

#: Words with apostrophes, hosts and addresses, numbers with signs inside; and a dot that follows, by which acronyms are told.
TOKEN = r"[\p{L}\p{N}]+(?:'\p{L}+|[.@][\p{L}\p{N}]+|[-_/,][\p{L}]*\p{N}[\p{L}\p{N}]*)*\.?"
ACRONYM = r"^(?:\p{L}\.)+$"
#: Characters that are words of their own: kana, and Chinese characters with their extension and compatibility blocks.
LONE = "[\u3040-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"

# The English stop words of the published analyser.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

ENTRY = StructType(
    [
        StructField("id", LongType()),
        StructField("file_path", StringType()),
        StructField("file_name", StringType()),
        StructField("line_number", LongType()),
        StructField("ts", TimestampType()),
        StructField("channel", StringType()),
        StructField("elapsed_ms", LongType()),
        StructField("level", StringType()),
        StructField("source", StringType()),
        StructField("content", StringType()),
        StructField("flags", ArrayType(StringType())),
        StructField("date_key", LongType()),
    ]
)
