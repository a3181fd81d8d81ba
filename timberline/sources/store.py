"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows, with so many bytes of text in them, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: The same for rows of a few numbers, some 24 bytes each.
BROADCAST_NUMBERS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where both are unset, a local session gets a new temporary folder. Any other session fails: a folder of the driver's machine
    is none of the executors'.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    held = tempfile.mkdtemp(prefix="timberline-")
    spark.sparkContext.setCheckpointDir(held)
    return held


def workspace(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, and a lost executor costs no more than what follows."""
    at = workspace(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """What is written within leaves no shuffle files: they go once it is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def contents_path(path: str) -> str:
    """Where the different contents of the entry table at ``path`` are; scans of the table don't see the folder."""
    return f"{path}/_contents"


#: Values in one condition that a scan can hold against a Parquet filter.
_AT_ONCE = 10


def any_of(column: str, values: list) -> Column:
    """Whether a column has one of few values, in conditions that a scan can hold against a Parquet filter."""
    some = [F.col(column).isin(*values[i : i + _AT_ONCE]) for i in range(0, len(values), _AT_ONCE)]
    return reduce(Column.__or__, some) if some else F.lit(False)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def removed(table: DataFrame) -> None:
    """Removes the files of a :func:`written` table that nothing needs any more: what was made from it has been written too."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes of text (both are measured), else as it is: a shuffled join follows."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    held = F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count("*"), held).first()
    return F.broadcast(df) if n <= rows and held <= size else df
