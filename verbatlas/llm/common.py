"""What the operators share: words, written tables, connected components, blobs."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import signature

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts the same.
WORD = r"[^\x20\x09-\x0D]+"

#: Edges that one task of a round of ``components`` takes.
EDGES_A_TASK = 1 << 18


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column, as Python functions get it."""
    return to_arrow_type(df.schema[column].dataType)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only in one process, as in tests, a temporary one will do."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="verbatlas-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through ``checkpoint()``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written to the shared folder and read back, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def written_cleanly(df: DataFrame, name: str) -> DataFrame:
    """``written``, after which the shuffle files that led to the table go at once, not when the driver collects garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the edges of a round
    number no more than the nodes and edges before it, minima are combined before they are
    shuffled, and the rounds grow with the logarithm of the longest path. Each round is a table,
    which goes when the next is there; its tasks are as many as its edges need, as there are
    often few edges and many shuffle partitions. Nulls are no nodes.
    """
    spark = edges.sparkSession
    e, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, before = (e.count(), None), None
    while state != before:
        tasks = max(spark.sparkContext.defaultParallelism, -(-state[0] // EDGES_A_TASK))
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        old = path
        e, path = stored(small.coalesce(tasks).distinct().coalesce(tasks), "links")
        state, before = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()), state
        removed(spark, old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpacked(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts may be long: keep few rows in an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy() -> None:
    """Give free memory back to the system: a Python worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(work: Callable) -> Callable:
    """``work``, with a ``tidy()`` when it is done: after its last batch, or after the table of a group."""

    @wraps(work)
    def batches(own: Iterator) -> Iterator:
        yield from work(own)
        tidy()

    @wraps(work)
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        tidy()
        return out

    return group if len(signature(work).parameters) == 2 else batches


def folded(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns ``apart``, and the others as one struct ``_row``, out of reach of an operator's own names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(*apart, F.struct(*others, F.lit(True).alias("_folded_row")).alias("_row"))


def unfolded(rows: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in apart else F.col("_row").getField(c).alias(c) for c in columns])
