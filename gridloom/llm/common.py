"""Pieces that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound, in bytes, of one Arrow batch handed to a Python worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``. Only a session on one
    machine may go without; it gets a temporary folder.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage; the result outlives lost executors.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches by bytes, so that long texts fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def returning(kernel):
    """A kernel for mapInArrow that hands freed memory back when its task ends.

    Workers are used again: what their allocators keep would add up over the
    stages of a job.
    """

    @functools.wraps(kernel)
    def run(batches):
        yield from kernel(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of ``df``, or those named, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sample_of(df: DataFrame, key: Column, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if fewer), picked by a seeded hash of ``key``.

    The count of rows is the only thing that this learns from the data; the
    same rows are picked whatever the partitioning.
    """
    total = df.count()
    if total <= rows:
        return df
    scale = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(scale)) < F.lit(int(scale * rows / total)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two columns of type long, in either direction, repeats and
    loops allowed. Returns ``node`` and ``root`` (the smallest node reachable)
    for each node that has an edge to another. A node with very many
    neighbours is only aggregated and joined on, never gathered; each round
    ends as a table in the shared folder.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct()
    pairs = materialise(pairs)
    seen = None
    for _ in range(max_rounds):
        both = pairs.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(pairs.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("x")).select("u", F.least("u", "x").alias("x"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("x").alias("m")).where("v <> m").distinct()
        lower = large.groupBy("v").agg(F.min("m").alias("x"))
        small = large.join(lower, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("x").alias("m")), F.struct(F.col("v"), F.col("x").alias("m")))).alias("e")).select("e.v", "e.m").where("v <> m").distinct()
        pairs = materialise(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("v").alias("node"), F.col("m").alias("root")).unionAll(pairs.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
