"""Products of sparse matrices as equi-joins and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.elementwise import drop_zeros


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a x b: join on the inner index, multiply, sum by cell.

    The sum is combined before its shuffle. A hot inner index makes one large
    join partition, which adaptive execution splits.
    """
    met = a.select("i", F.col("j").alias("k"), F.col("v").alias("p")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("q")), "k")
    return drop_zeros(met.groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v")))


def multiply_complex(a: DataFrame, b: DataFrame) -> DataFrame:
    met = a.select("i", F.col("j").alias("k"), F.col("v").alias("p"), F.col("iv").alias("ip")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("q"), F.col("iv").alias("iq")), "k")
    return drop_zeros(met.groupBy("i", "j").agg(F.sum(F.expr("p * q - ip * iq")).alias("v"), F.sum(F.expr("p * iq + ip * q")).alias("iv")))


def gram(m: DataFrame) -> DataFrame:
    """m x m', each unordered pair of rows met once: the upper triangle is mirrored after the sum, which halves the join's rows."""
    a = m.select("i", F.col("j").alias("k"), F.col("v").alias("p"))
    b = m.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("q"))
    upper = drop_zeros(a.join(b, "k").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v")))
    mirrored = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return upper.select(F.explode(mirrored).alias("c"), "v").select("c.i", "c.j", "v")


def block_multiply(a: DataFrame, b: DataFrame, block: int = 64) -> DataFrame:
    """a x b over square blocks: each pair of blocks is multiplied as two small dense matrices, and the results are summed by cell.

    The same product as :func:`multiply`; the shuffle key is the block, so
    that a block is fetched once for all of the cells that it serves, and a
    pair of blocks gives block x block cells at most.
    """
    cut = lambda c: F.floor(F.col(c) / block).cast("bigint")
    inner = lambda c: (F.col(c) % block).cast("int")
    cells = F.collect_list(F.struct(inner("i").alias("i"), inner("j").alias("j"), F.col("v").cast("double").alias("v")))
    left = a.groupBy(cut("i").alias("bi"), cut("j").alias("bk")).agg(cells.alias("p"))
    right = b.groupBy(cut("i").alias("bk"), cut("j").alias("bj")).agg(cells.alias("q"))

    def dense(s: pa.StructScalar) -> np.ndarray:
        out, own = np.zeros((block, block)), s.values
        i, j, v = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        np.add.at(out, (i, j), v)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, p, q in zip(*batch.columns, strict=True):
                c = dense(p) @ dense(q)
                i, j = np.nonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(i + bi.as_py() * block), pa.array(j + bj.as_py() * block), pa.array(c[i, j])], names=["i", "j", "v"])

    made = left.join(right, "bk").select("bi", "bj", "p", "q").mapInArrow(run, "i long, j long, v double")
    return drop_zeros(made.groupBy("i", "j").agg(F.sum("v").alias("v")))


def row_dot(m: DataFrame, a: int, b: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The inner product of two rows over columns [start, stop)."""
    inside = m
    if start is not None:
        inside = inside.where(F.col("j") >= start)
    if stop is not None:
        inside = inside.where(F.col("j") < stop)
    met = inside.where(F.col("i") == a).select("j", F.col("v").alias("p")).join(inside.where(F.col("i") == b).select("j", F.col("v").alias("q")), "j")
    return met.agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("dot"))


def column_lengths(m: DataFrame) -> DataFrame:
    """Euclidean length of each column."""
    return m.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))


def qr_upper(q: DataFrame, a: DataFrame) -> DataFrame:
    """R of A = QR: the upper triangle of Q'A."""
    t = q.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return multiply(t, a).where("i <= j")
