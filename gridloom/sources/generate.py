"""Generated matrices, samples and constant tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cells(spark: SparkSession, m: int, n: int) -> DataFrame:
    return spark.range(m * n).select(F.floor(F.col("id") / n).cast("bigint").alias("i"), (F.col("id") % n).alias("j"))


def identity(spark: SparkSession, n: int, v: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(v).alias("v"))


def unit(spark: SparkSession, m: int, n: int) -> DataFrame:
    return _cells(spark, m, n).withColumn("v", F.lit(1.0))


def centering(spark: SparkSession, n: int) -> DataFrame:
    """I - 1/n."""
    return _cells(spark, n, n).withColumn("v", (F.col("i") == F.col("j")).cast("double") - 1.0 / n)


def hessenberg(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Random numbers in [0, 1) on and above the first subdiagonal."""
    return random(spark, n, n, seed).where("i <= j + 1")


def random(spark: SparkSession, m: int, n: int, seed: int, complex_: bool = False) -> DataFrame:
    """Numbers in [0, 1) hashed from seed and cell: the same whatever the partitioning."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed * 2 + k), "i", "j"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    out = _cells(spark, m, n).withColumn("v", u(0))
    return out.withColumn("iv", u(1)) if complex_ else out


def sample(spark: SparkSession, start: int, stop: int, k: int, seed: int) -> DataFrame:
    """``k`` distinct numbers of [start, stop) in a seeded order; all, if there are fewer."""
    return spark.range(start, stop).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)


def materials(spark: SparkSession) -> DataFrame:
    """Rim materials: tensile strength and modulus (Pa), density (kg/m^3), elongation (%)."""
    # Fixed values
    rows = [
        ("carbon T300", 3530e6, 230e9, 1760.0, 101.5),
        ("carbon T400HB", 4410e6, 250e9, 1800.0, 101.8),
        ("carbon T700SC", 4900e6, 230e9, 1800.0, 102.1),
        ("carbon T800HB", 5490e6, 294e9, 1810.0, 101.9),
        ("carbon T1000GB", 6370e6, 294e9, 1800.0, 102.2),
        ("carbon M35JB", 4700e6, 343e9, 1750.0, 101.4),
        ("carbon M40JB", 4400e6, 377e9, 1750.0, 101.2),
        ("carbon M46JB", 4020e6, 436e9, 1840.0, 100.9),
        ("carbon M60JB", 3820e6, 588e9, 1930.0, 100.7),
    ]
    return spark.createDataFrame(rows, "name string, strength double, modulus double, density double, elongation double")


def material(spark: SparkSession, name: str) -> DataFrame:
    """One material; an unknown name is an error."""
    found = materials(spark).where(F.col("name") == name)
    if found.isEmpty():
        raise ValueError(f"no material {name!r}")
    return found


#: A tetrahedron's stencils as signs of its corners (0 outside, 1 inside, 2 on the surface) and the edges that are cut.
#: The first three hold in any position, the others only as the long edges of the lattice lie.
STENCILS = (
    ((1, 2, 0, 2), ((0, 2),)),
    ((1, 0, 0, 2), ((0, 1), (0, 2))),
    ((1, 0, 0, 0), ((0, 1), (0, 2), (0, 3))),
    ((0, 2, 1, 1), ((0, 2), (0, 3))),
    ((0, 1, 2, 1), ((0, 1), (0, 3))),
    ((1, 0, 1, 0), ((0, 1), (0, 3), (1, 2), (2, 3))),
    ((1, 1, 0, 0), ((0, 2), (0, 3), (1, 2), (1, 3))),
    ((0, 1, 1, 2), ((0, 1), (0, 2))),
    ((0, 1, 1, 1), ((0, 1), (0, 2), (0, 3))),
    ((0, 1, 1, 0), ((0, 1), (0, 2), (1, 3), (2, 3))),
)
ANY_POSITION = 3
TETRA_EDGES = tuple(itertools.combinations(range(4), 2))


def rotations(any_position: bool) -> list[tuple[int, ...]]:
    """The even orders of four corners, or those of them that swap corners in two pairs."""
    even = [p for p in itertools.permutations(range(4)) if sum(p[a] > p[b] for a, b in TETRA_EDGES) % 2 == 0]
    return even if any_position else [p for p in even if all(p[p[k]] == k for k in range(4))]


def stencil_code(signs: tuple[int, ...], cuts: set[tuple[int, int]]) -> int:
    """Five bits for each edge: the first corner's sign, whether the edge is cut, and the second corner's sign."""
    return sum((signs[a] | ((a, b) in cuts) << 2 | signs[b] << 3) << 5 * k for k, (a, b) in enumerate(TETRA_EDGES))


def stencils(spark: SparkSession) -> DataFrame:
    """Every stencil in every order that it holds in, by code, then stencil and order: pos, code, stencil, corners (which corner of the stencil lies at each place)."""
    rows = []
    for n, (signs, cuts) in enumerate(STENCILS):
        for p in rotations(n < ANY_POSITION):
            rows.append((stencil_code(tuple(signs[c] for c in p), {(a, b) for a, b in TETRA_EDGES if tuple(sorted((p[a], p[b]))) in cuts}), n, list(p)))
    return spark.createDataFrame([(k, *r) for k, r in enumerate(sorted(rows))], "pos long, code long, stencil int, corners array<int>")
