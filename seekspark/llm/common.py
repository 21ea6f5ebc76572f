"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, with the types that missing ones get.
DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}

_local_dir: str | None = None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` cut to `columns`; a column that it lacks is added as null, extra ones go.

    This is how operators stay clear of clashing names: what they add internally never
    meets a column that they don't know.
    """
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(DOCUMENT_COLUMNS.get(c, "string")).alias(c) for c in columns])


def spare_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores before it until no column of `df` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset, if the session is a local one, as in tests."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="seekspark-")
    return _local_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/seekspark-{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """`df` as a table in the shared folder, reread: the lineage ends there and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Rows that Spark sends to a Python worker at once; its default of 10,000 is meant for numbers, not for texts.
BATCH_ROWS = 2000


def lean(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def trim() -> None:
    """Gives the memory that a Python worker has freed back to the system; workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def least_hashes(df: DataFrame, n: int) -> DataFrame:
    """The n distinct rows of least hash of all columns, in that order: a sample that doesn't depend on partitioning.

    All of them where there are fewer. Nulls are values like others, and repeated rows count once. Only hashes
    are compared for the n-th least one; a first bound on them, which about 2 n rows pass, spares most of the shuffle,
    and where repeated rows leave fewer than n below it all hashes take part.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in columns]  # the hash skips nulls
    h = F.xxhash64(*columns, *nulls)
    hashes, total = df.select(h.alias("h")), df.count()
    least = lambda found: [r["h"] for r in found.distinct().orderBy("h").limit(n).collect()]
    found = least(hashes.filter(F.col("h") < int(-(2**63) + 2**64 * (2 * n / total)))) if total > 4 * n else []
    if len(found) < n:
        found = least(hashes)
    return df.filter(h <= F.lit(found[-1] if found else 0)).dropDuplicates().orderBy(h, *columns).limit(n)


def pieces(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover all rows in order, each of about `most` bytes at most (a larger row is a range of its own)."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
