"""Canonical relations: sparse matrices, points and tetrahedra as rows.

A matrix is ``(i, j, v)`` or, if complex, ``(i, j, v, iv)``, zero-based, with no
row for a cell that is nearly zero; its shape is kept apart as ``(m, n)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: magnitudes up to this, inclusive, count as zero.
NEAR_ZERO = 1e-8


def near_zero(v: Column, iv: Column | None = None) -> Column:
    """Whether a value (both parts of a complex one) counts as zero."""
    flat = F.abs(v) <= NEAR_ZERO
    return flat if iv is None else flat & (F.abs(iv) <= NEAR_ZERO)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x part, the quantity sold."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("v"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x event type (in the order of names, from 0), the number of events."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("v"))
    kinds = events.groupBy("event_type").agg(F.lit(1)).select("event_type", (F.expr("row_number() over (order by event_type)") - 1).cast("bigint").alias("j"))
    return events.join(F.broadcast(kinds), "event_type").select(F.col("user_id").alias("i"), "j", "v")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector x component of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).select("i", F.col("j").cast("bigint").alias("j"), F.col("x").cast("double").alias("v"))


def lattice(spark: SparkSession, sf_dir: str, scale: int = 16) -> DataFrame:
    """The embeddings' components as integers, floor(scale * x): sums of products are exact."""
    return dense(spark, sf_dir).select("i", "j", F.floor(F.col("v") * scale).cast("double").alias("v"))


def points(spark: SparkSession, sf_dir: str, scale: int = 1000) -> DataFrame:
    """Nodes with integer coordinates: the first three components, floor(scale * x)."""
    at = lambda k: F.floor(F.col("embedding")[k].cast("double") * scale).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def tetrahedra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nodes for each run of four vector ids."""
    ids = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("e"), F.col("vec_id").alias("n"))
    return ids.groupBy("e").agg(F.sort_array(F.collect_list("n")).alias("ns")).where(F.size("ns") == 4).select("e", *[F.get("ns", F.lit(k)).alias(f"n{k}") for k in range(4)])


def tetra_points(spark: SparkSession, sf_dir: str, scale: int = 1000) -> DataFrame:
    """Tetrahedra with their corners: e, x0..z3."""
    p = points(spark, sf_dir, scale).select(F.floor(F.col("n") / 4).cast("bigint").alias("e"), F.struct("n", "x", "y", "z").alias("p"))
    ps = p.groupBy("e").agg(F.sort_array(F.collect_list("p")).alias("ps")).where(F.size("ps") == 4)
    return ps.select("e", *[F.get("ps", F.lit(k))[c].alias(f"{c}{k}") for k in range(4) for c in ("x", "y", "z")])


#: The same relations as SQL, for common table expressions.
SQL = {
    "S": "S AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)",
    "U": "U AS (SELECT user_id AS i, k.j, CAST(count(*) AS DOUBLE) AS v FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS j FROM (SELECT DISTINCT event_type FROM events)) k USING (event_type) GROUP BY 1, 2)",
    "E": "E AS (SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(k) WHERE k <= len(embedding))",
    "L": "L AS (SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, floor(CAST(embedding[k] AS DOUBLE) * 16) AS v FROM embeddings, range(1, 65) r(k) WHERE k <= len(embedding))",
    "P": "P AS (SELECT vec_id AS n, floor(CAST(embedding[1] AS DOUBLE) * 1000) AS x, floor(CAST(embedding[2] AS DOUBLE) * 1000) AS y, floor(CAST(embedding[3] AS DOUBLE) * 1000) AS z FROM embeddings)",
    "T": "T AS (SELECT a.n // 4 AS e, a.n AS n0, b.n AS n1, c.n AS n2, d.n AS n3, " + ", ".join(f"{t}.{c} AS {c}{k}" for k, t in enumerate("abcd") for c in "xyz") + " FROM P a JOIN P b ON b.n = a.n + 1 JOIN P c ON c.n = a.n + 2 JOIN P d ON d.n = a.n + 3 WHERE a.n % 4 = 0)",
}


def with_(*names: str) -> str:
    """``WITH`` of the named relations."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
