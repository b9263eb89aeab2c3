"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.session import ship

#: Words are runs of anything but these (Java and Python regex alike).
SPACE = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; on a single machine, one of our own where none is named."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_apportion_dir", None) or tempfile.mkdtemp(prefix="apportion-")
        spark._apportion_dir = found
    return found


#: Tables written in the innermost ``passing``: path and, in the catalog, name.
_WRITTEN: ContextVar[dict[str, str] | None] = ContextVar("written", default=None)


def _written(table: DataFrame, path: str, name: str = "") -> DataFrame:
    table._apportion_path = path
    if (own := _WRITTEN.get()) is not None:
        own[path] = name
    return table


def part_of(table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a written table, which ``passing`` keeps with them."""
    out = table.select(*columns)
    out._apportion_path = table._apportion_path
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written in the block are deleted at its end, but for those that it puts into the list, which pass to the block around it.

    Nothing that is used later may read the deleted ones.
    """
    own: dict[str, str] = {}
    kept: list[DataFrame] = []
    around = _WRITTEN.set(own)
    try:
        yield kept
    finally:
        _WRITTEN.reset(around)
        for table in kept:
            path = table._apportion_path
            _written(table, path, own.pop(path, ""))
        for path, name in own.items():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return _written(spark.read.schema(df.schema).parquet(path), path)


def homes(spark: SparkSession) -> int:
    """Buckets of a table written by ``write_bucketed``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, label: str, n: int) -> DataFrame:
    """As ``write_table``, in n buckets by ``chunk``: what is joined or grouped by chunk later need not move these rows again.

    Chunks are numbered so that those of a task share a bucket (``exchange.numbered``): a task writes one file.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark).rstrip('/')}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, "chunk").saveAsTable(name)
    return _written(spark.table(name), path, name)


def tidy(results: Iterator) -> Iterator:
    """The results; afterwards the worker gives memory that it no longer needs back."""
    try:
        yield from results
    finally:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch on its way to Python, unless the session has a limit of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Long texts make batches of a fixed number of rows large; workers and executors need memory for several of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty. Extra columns go, so no name can clash."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")
