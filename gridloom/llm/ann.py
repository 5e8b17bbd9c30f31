"""Approximate nearest neighbours along shifted Hilbert curves."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, materialise, returning, sample_of
from gridloom.llm.vectors import component_type, matrix, valid

#: Curves; projected dimensions of a curve, and bits of each.
CURVES, DIMS, BITS = 8, 4, 10
#: Rows that the projections' ranges and the window are fitted on, about; queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 8_192, 200
#: Recall that the window must reach on the sample, and windows that are tried (shares of all rows on either side).
RECALL = 0.95
WINDOWS = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.1, 0.125, 0.15, 0.2, 0.3, 0.5, 1.0)
#: Least and most rows of a block, blocks that a window has on either side where these allow, and most rows whose queries travel together.
BLOCK, WIDE_BLOCK, SIDE, SPAN = 128, 8_192, 8, 32_768
#: Queries that are scored against a block at once.
CHUNK = 512
RESULT = "query_id long, rank int, vec_id long, score double"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (a row each) of ``bits`` bits a coordinate.

    Turns coordinates into the curve's transposed index by exchanging or
    inverting low bits from the top bit down, then by a Gray decoding.
    """
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    d = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(d):
            turned = (x[i] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & (1 << b)) != 0, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Index:
    """Projections (curve x d x DIMS), the sample's sorted projected values, shifts, and the share of rows on either side of a query that are reranked."""

    axes: np.ndarray
    values: np.ndarray
    shifts: np.ndarray
    window: float

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Keys of vectors on one curve: projected, made even by the sample's quantiles, shifted, ordered."""
        y = x.astype(np.float64) @ self.axes[curve]
        u = np.stack([np.interp(y[:, k], self.values[curve, k], np.linspace(0, 1, self.values.shape[2])) for k in range(DIMS)], axis=1)
        cells = ((0.75 * u + 0.25 * self.shifts[curve]) * (1 << BITS)).astype(np.int64)
        return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def fit(x: np.ndarray, k: int, recall: float = RECALL, seed: int = 29) -> Index:
    """Fit on sampled vectors: random orthonormal axes, quantiles, and the least window that finds ``recall`` of the k nearest within the sample."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    x = x.astype(np.float64)
    axes = np.zeros((CURVES, d, DIMS))
    for c in range(CURVES):
        m = min(d, DIMS)
        axes[c, :, :m] = np.linalg.qr(rng.normal(size=(d, m)))[0]
    y = np.einsum("nd,cdk->ckn", x, axes)
    values = np.quantile(y, np.linspace(0, 1, 257), axis=2).transpose(1, 2, 0) + np.arange(257) * 1e-12
    index = Index(axes, values, rng.random((CURVES, DIMS)), 1.0)
    n = len(x)
    picked = rng.permutation(n)[:SAMPLE_QUERIES]
    if n < 20:
        return index
    k = min(k, n - 1)
    gaps = np.full((len(picked), k), n)
    near = np.empty((len(picked), k), np.int64)
    for i, q in enumerate(picked):
        dist = ((x - x[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        near[i] = np.lexsort((np.arange(n), dist))[:k]
    for c in range(CURVES):
        rank = np.empty(n, np.int64)
        rank[np.argsort(index.keys(x, c), kind="stable")] = np.arange(n)
        gaps = np.minimum(gaps, np.abs(rank[near] - rank[picked][:, None]))
    index.window = next(w for w in WINDOWS if (gaps <= w * n).mean() >= recall or w == 1.0)
    return index


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows (Euclidean) found for the rows of ``vectors`` (vec_id, embedding) where ``is_query`` holds.

    Every row gets a key on each of CURVES shifted Hilbert curves over random
    projections. Each curve is range-partitioned, sorted and cut into blocks;
    a query meets the blocks within the fitted window around its own on every
    curve, its candidates are scored exactly on the original vectors in
    double precision, and the curves' results are merged. Queries of
    neighbouring blocks, a quarter of a window at most, travel together, so a
    block is met a number of times that doesn't grow with the table. The
    window is a share of the rows: 0.05 per cent a side where the data have
    structure that the curves follow, up to all rows where they have none.

    Defined cases: vectors that are null, zero, or hold a null or non-finite
    component take no part, nor do rows whose vec_id is null; each length of
    vector is a table of its own, with its own index, as lengths cannot be
    held against each other; ties go to the smaller vec_id;
    rows of the query's vec_id are its own and no candidates; rows that
    repeat a vec_id count once, at the nearest; fewer candidates than ``k``
    give fewer rows; an empty table gives an empty table; further columns are
    not looked at.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = valid(vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("query")), zero=False, keep=("query",))
    # a row for each length that has a query
    lengths = sorted(r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.max("query").alias("asked")).where("asked").collect())
    found = [_of_length(rows.where(F.size("v") == d), d, k, recall) for d in lengths]
    return functools.reduce(DataFrame.unionAll, found, spark.createDataFrame([], RESULT)) if len(found) != 1 else found[0]


def _of_length(rows: DataFrame, d: int, k: int, recall: float) -> DataFrame:
    """As :func:`nearest`, for the valid rows (vec_id, v, query) whose vectors are of length ``d``."""
    spark = rows.sparkSession
    kind = component_type(rows)
    count = rows.count()
    # rows that repeat whole are drawn together, and come once
    sample = sample_of(rows.select("vec_id", "v"), F.xxhash64("vec_id", "v"), SAMPLE_ROWS, 31).distinct().collect()
    # few different rows can all be missed; a sample of one row has the window at all rows
    sample = sample or rows.agg(F.min(F.struct("vec_id", "v")).alias("r")).select("r.*").collect()
    sample.sort(key=lambda r: (r["vec_id"], list(r["v"])))
    index = fit(np.array([r["v"] for r in sample]), k, recall)
    held = spark.sparkContext.broadcast(index)
    block = min(WIDE_BLOCK, max(BLOCK, int(index.window * count / SIDE)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = matrix(b.column(1), d)
                raw = pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary())
                salt = pa.array(np.arange(done, done + len(x)))
                done += len(x)
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(held.value.keys(x, c)), b.column(0), salt, b.column(2), raw], names=["curve", "key", "vec_id", "salt", "query", "raw"])

    ordered = ["curve", "key", "vec_id", "salt"]
    keys = rows.mapInArrow(returning(keyed), "curve int, key long, vec_id long, salt long, query boolean, raw binary")
    parts = max(CURVES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_keys = keys.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered).select("curve", "vec_id", "query", "raw", F.spark_partition_id().alias("part"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of up to ``block`` rows of one curve, in order."""
        state = {"curve": None, "part": 0, "seq": 0}
        own: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(own)
            asks = t.filter(t.column("query"))
            cells = [b"".join(x.column(c).to_pylist()) if c == "raw" else x.column(c).to_numpy().astype(np.int64).tobytes() for x in (t, asks) for c in ("vec_id", "raw")]
            row = [state["curve"], state["part"], state["seq"], *cells]
            state["seq"] += 1
            own.clear()
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["curve", "part", "seq", "ids", "raw", "qids", "qraw"])

        for b in batches:
            curves = b.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(curves, prepend=-1)).tolist()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if own and state["curve"] != curves[lo]:
                    yield out()
                state["curve"], state["part"] = int(curves[lo]), b.column(4)[lo].as_py()
                while lo < hi:
                    n = min(hi - lo, block - sum(x.num_rows for x in own))
                    own.append(b.slice(lo, n))
                    lo += n
                    if sum(x.num_rows for x in own) >= block:
                        yield out()
        if own:
            yield out()

    blocks = materialise(sorted_keys.mapInArrow(returning(packed), "curve int, part int, seq int, ids binary, raw binary, qids binary, qraw binary"))
    # a row for each curve and partition comes to the driver: how many blocks lie before
    counts = sorted((r["curve"], r["part"], r["n"]) for r in blocks.groupBy("curve", "part").agg(F.count("*").alias("n")).collect())
    before, total = [], {}
    for c, p, n in counts:
        before.append((c, p, total.get(c, 0)))
        total[c] = total.get(c, 0) + n
    offset = F.broadcast(spark.createDataFrame(before, "curve int, part int, before int"))
    placed = blocks.join(offset, ["curve", "part"]).withColumn("at", F.col("before") + F.col("seq"))
    most = max(total.values())
    reach = int(np.ceil(index.window * most)) + 1
    span = max(1, min(reach // 4, SPAN // block))
    packs = placed.where(F.length("qids") > 0).groupBy("curve", F.floor(F.col("at") / span).cast("long").alias("g")).agg(F.collect_list(F.struct("qids", "qraw")).alias("asks"))
    asked = packs.select("curve", "asks", F.explode(F.sequence(F.greatest(F.col("g") * span - reach, F.lit(0)), F.least((F.col("g") + 1) * span - 1 + reach, F.lit(most - 1)))).alias("at"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbers of partitions are given, so that few bytes for much work are not put in few tasks
    met = asked.repartition(tasks, "curve", "at").join(placed.select("curve", "at", "ids", "raw").repartition(tasks, "curve", "at"), ["curve", "at"]).select("asks", "ids", "raw")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            r = [list(best), [v[1].tolist() for v in best.values()], [v[0].tolist() for v in best.values()]]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(r[0], pa.int64()), pa.array(r[1], pa.list_(pa.int64())), pa.array(r[2], pa.list_(pa.float64()))], names=["query_id", "ids", "far"])

        for b in batches:
            for asks, ids, raw in zip(*b.columns, strict=True):
                own = np.frombuffer(ids.as_buffer(), np.int64)
                x = np.frombuffer(raw.as_buffer(), kind).reshape(len(own), d).astype(np.float64)
                xx = (x**2).sum(axis=1)
                q = np.concatenate([np.frombuffer(a["qids"].as_buffer(), np.int64) for a in asks])
                v = np.concatenate([np.frombuffer(a["qraw"].as_buffer(), kind) for a in asks]).reshape(len(q), d).astype(np.float64)
                for at in range(0, len(q), CHUNK):
                    some = v[at : at + CHUNK]
                    vv = (some**2).sum(axis=1)[:, None]
                    # squared distances by products, less what rounding may have added to them
                    near = (xx + vv) * (1 - 1e-9) - 2 * (some @ x.T)
                    for n, (i, y) in enumerate(zip(q[at : at + CHUNK].tolist(), some, strict=True)):
                        had = best.get(i)
                        full = had is not None and len(had[0]) >= k
                        pick = np.flatnonzero(~(near[n] > had[0][-1])) if full else np.arange(len(own))
                        pick = pick[own[pick] != i]
                        if len(pick) == 0:
                            continue
                        e, j = ((x[pick] - y) ** 2).sum(axis=1), own[pick]
                        if had is not None:
                            e, j = np.concatenate([had[0], e]), np.concatenate([had[1], j])
                        order = np.lexsort((j, e))
                        _, firsts = np.unique(j[order], return_index=True)
                        order = order[np.sort(firsts)][:k]
                        best[i] = (e[order], j[order])
                if len(best) >= 50_000:
                    yield out()
        if best:
            yield out()

    found = met.mapInArrow(returning(scored), "query_id long, ids array<long>, far array<double>")
    pairs = found.select("query_id", F.zip_with("far", "ids", lambda a, b: F.struct(a.alias("far"), b.alias("id"))).alias("near"))
    # k for each query and task
    ranked = pairs.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    # rows that repeat a vec_id, with other vectors, count at the nearest
    once = ranked.select("query_id", F.aggregate("near", F.expr("cast(array() as array<struct<far:double,id:bigint>>)"), lambda a, x: F.when(F.size(a) < k, F.when(F.exists(a, lambda y: y["id"] == x["id"]), a).otherwise(F.concat(a, F.array(x)))).otherwise(a)).alias("near"))
    return once.select("query_id", F.posexplode("near").alias("rank", "r")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.id").alias("vec_id"), F.sqrt("r.far").alias("score"))

