"""Exact top-k inner products by ball trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, materialise, returning
from gridloom.llm.vectors import matrix, valid

#: Rows of a shard and of a leaf, queries that travel together, and queries whose bounds are taken at once.
SHARD, LEAF, PACK, CHUNK = 8_192, 128, 4_096, 512
#: Roots that travel together; shards that a pack looks into first, of each such group of roots, and leaves there.
ROOTS, PROBES, PROBE_LEAVES = 1_024, 3, 6
SCALE = 256


@dataclass
class Tree:
    """Vectors in the order of leaves; nodes with centre, radius, rows (start, stop) and children (0: none)."""

    ids: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray

    _PARTS = (("ids", np.int64), ("rows", np.int64), ("centre", np.float64), ("radius", np.float64), ("start", np.int32), ("stop", np.int32), ("left", np.int32), ("right", np.int32))

    def pack(self) -> list[bytes]:
        return [narrow(self.rows) if k == "rows" else np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in self._PARTS]

    @classmethod
    def unpack(cls, parts: list[bytes], d: int) -> Tree:
        ids = np.frombuffer(parts[0], np.int64)
        own = [np.frombuffer(p, t) for p, (_, t) in zip(parts[2:], cls._PARTS[2:], strict=True)]
        return cls(ids, widen(parts[1], len(ids), d), own[0].reshape(-1, d), *own[1:])


def narrow(rows: np.ndarray) -> bytes:
    """Integer rows in the fewest bytes a component that hold them all."""
    most = np.abs(rows).max(initial=0)
    return rows.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)).tobytes()


def widen(raw: bytes, n: int, d: int) -> np.ndarray:
    """The ``n`` rows of length ``d`` that :func:`narrow` packed."""
    return np.frombuffer(raw, f"i{len(raw) // (n * d)}").astype(np.int64).reshape(n, d)


def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halve the rows along the line between two far points until ``leaf`` are left."""
    x = rows.astype(np.float64)
    order = np.arange(len(ids))
    nodes: list[list] = []
    stack = [(0, len(ids), -1, 0)]
    while stack:
        a, b, parent, side = stack.pop()
        at = len(nodes)
        own = x[order[a:b]]
        c = own.mean(axis=0)
        far = ((own - c) ** 2).sum(axis=1)
        nodes.append([c, np.sqrt(far.max()), a, b, 0, 0])
        if parent >= 0:
            nodes[parent][4 + side] = at
        if b - a > leaf:
            p = own[far.argmax()]
            q = own[((own - p) ** 2).sum(axis=1).argmax()]
            along = own @ (q - p)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]  # equal rows are halved too
            stack += [(a, a + half, at, 0), (a + half, b, at, 1)]
    cols = list(zip(*nodes, strict=True))
    return Tree(ids[order], rows[order], np.array(cols[0]), np.array(cols[1]), *(np.array(c, np.int32) for c in cols[2:]))


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products: by long integers where these are exact, else by Python's."""
    if float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * rows.shape[1] < 2**63:
        return rows @ q
    whole = (rows.astype(object) @ q.astype(object)).tolist()
    if any(abs(v) >= 2**63 for v in whole):
        raise OverflowError("a score does not fit in a long")
    return np.array(whole, np.int64)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query (a row) and ball the greatest inner product that the ball allows."""
    q = q.astype(np.float64)
    # the slack covers the rounding of centres, radii and products at any size of components
    reach = radius + 1e-9 * (radius + np.sqrt((centre**2).sum(axis=1)))
    return q @ centre.T + np.sqrt((q**2).sum(axis=1))[:, None] * reach + 1e-6


class Searcher:
    """A tree and a pack of queries (rows of integers)."""

    def __init__(self, tree: Tree, queries: np.ndarray) -> None:
        self.tree, self.queries = tree, queries
        most = float(np.abs(tree.rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        self.doubles = (tree.rows.astype(np.float64), queries.astype(np.float64)) if most < 2**53 else None  # doubles are exact
        self.left, self.right, self.start, self.stop = (x.tolist() for x in (tree.left, tree.right, tree.start, tree.stop))

    def bounds(self, first: int) -> list[list[float]]:
        """The nodes' bounds for CHUNK queries from ``first`` on."""
        return bounds(self.queries[first : first + CHUNK], self.tree.centre, self.tree.radius).tolist()

    def scores(self, n: int, a: int, b: int) -> np.ndarray:
        if self.doubles:
            return (self.doubles[0][a:b] @ self.doubles[1][n]).astype(np.int64)
        return products(self.tree.rows[a:b], self.queries[n])

    def search(self, n: int, bound: list[float], query_id: int, k: int, best: list[tuple[int, int]], floor: int | None, leaves: int | None = None) -> list[tuple[int, int]]:
        """Branch and bound for query ``n``: the nodes of greatest bound first, until none reaches the k-th score.

        ``best``: the query's (score, -vec_id) so far, greatest first; ``floor``:
        a score that its k-th reaches elsewhere. ``leaves``: stop after so many.
        """
        heap, seen = [(-bound[0], 0)], 0
        while heap and (leaves is None or seen < leaves):
            top, node = heapq.heappop(heap)
            least = best[k - 1][0] if len(best) >= k else None
            if floor is not None and (least is None or floor > least):
                least = floor
            if least is not None and -top < least:
                break
            if self.left[node]:
                for c in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-bound[c], c))
                continue
            seen += 1
            a, b = self.start[node], self.stop[node]
            score = self.scores(n, a, b)
            at = np.flatnonzero(score >= least) if least is not None else np.arange(b - a)
            if not len(at):
                continue
            ids = self.tree.ids[a:b][at]
            merged, taken, out = sorted(best + [(s, -i) for s, i in zip(score[at].tolist(), ids.tolist(), strict=True) if i != query_id], reverse=True), set(), []
            for s, i in merged:
                if i not in taken:
                    taken.add(i)
                    out.append((s, i))
                    if len(out) == k:
                        break
            best = out
        return best


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """The ``k`` greatest inner products of quantised vectors for the rows where ``is_query`` holds, exactly.

    Each component x becomes floor(scale * x). Rows are cut into shards where
    they are read, without a shuffle, each with a ball tree. Queries travel in
    packs. A pack first meets the roots of the trees alone, some hundred bytes
    for each shard. A first round looks into the best leaves of a few shards,
    those that most of the pack's queries have the greatest bound in; the k-th
    score found is each query's floor. The second round searches the shards
    whose root's bound reaches the floor of one of the pack's queries, a task
    sharing a query's k-th score between the shards that it holds.

    Defined cases: vectors that are null, empty, or hold a null or non-finite
    component take no part, nor do rows whose vec_id is null; a vector is
    only compared with those of its length; ties go to the smaller vec_id;
    rows of the query's vec_id are its own; rows that repeat a vec_id count
    once, at the greatest score; fewer candidates give fewer rows; an empty
    table gives an empty table; a component beyond long after scaling, or a
    score beyond long, is an error; further columns are not looked at.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = valid(vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("query")), zero=True, keep=("query",))

    def whole(column: pa.Array, d: int) -> np.ndarray:
        x = np.floor(scale * matrix(column, d).astype(np.float64))
        if np.abs(x).max(initial=0) >= 2.0**63:
            raise OverflowError("a component does not fit in a long")
        return x.astype(np.int64)

    def by_length(batches: Iterator[pa.RecordBatch], size: int, queries: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Chunks of ``size`` rows of equal length: length, ids, rows."""
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            if queries:
                b = b.filter(b.column(2))
            lengths = np.diff(b.column(1).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for d in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == d))
                ids, xs = held.setdefault(d, ([], []))
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                xs.append(whole(part.column(1), d))
                while sum(map(len, ids)) >= size:
                    i, x = np.concatenate(ids), np.concatenate(xs)
                    yield d, i[:size], x[:size]
                    ids[:], xs[:] = [i[size:]], [x[size:]]
        for d, (ids, xs) in held.items():
            if sum(map(len, ids)):
                yield d, np.concatenate(ids), np.concatenate(xs)

    parts = [f"t{i}" for i in range(len(Tree._PARTS))]

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for d, ids, x in by_length(batches, SHARD, False):
            done[d] = done.get(d, -1) + 1
            tree = build(ids, x)
            root = np.append(tree.centre[0], tree.radius[0]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([done[d]], pa.int32()), pa.array([root], pa.binary()), *[pa.array([p], pa.binary()) for p in tree.pack()]], names=["d", "seq", "root", *parts])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, ids, x in by_length(batches, PACK, True):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([narrow(x)], pa.binary())], names=["d", "qids", "qrows"])

    shards = materialise(rows.mapInArrow(returning(sharded), "d int, seq int, root binary, " + ", ".join(f"{p} binary" for p in parts)).withColumn("part", F.spark_partition_id()))
    packs = materialise(rows.where("query").mapInArrow(returning(asking), "d int, qids binary, qrows binary").withColumn("pack", F.monotonically_increasing_id()))
    # a row for each length and input partition comes to the driver: how many shards lie before
    before, total = [], {}
    for c in sorted(shards.groupBy("d", "part").agg(F.count("*").alias("n")).collect()):
        before.append((c["d"], c["part"], total.get(c["d"], 0)))
        total[c["d"]] = total.get(c["d"], 0) + c["n"]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = shards.join(F.broadcast(spark.createDataFrame(before, "d int, part int, before int")), ["d", "part"]).withColumn("shard", F.col("before") + F.col("seq")).drop("part", "seq", "before")
    # the queries against all rows, in blocks: a pack meets the roots, ROOTS of them at once
    roots = shards.groupBy("d", F.floor(F.col("shard") / ROOTS).alias("g")).agg(F.collect_list(F.struct("shard", "root")).alias("roots")).drop("g")

    def chosen(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    d, n = row["d"], len(row["qids"]) // 8
                    q = widen(row["qrows"], n, d)
                    balls = np.stack([np.frombuffer(r["root"]) for r in row["roots"]])
                    votes, open_ = np.zeros(len(balls), np.int64), np.zeros(len(balls), bool)
                    for k in range(0, n, CHUNK):
                        most = bounds(q[k : k + CHUNK], balls[:, :d], balls[:, d])
                        if first:
                            votes += np.bincount(most.argmax(axis=1), minlength=len(balls))
                        else:
                            floors = np.array([-np.inf if f is None else float(f) for f in row["floors"][k : k + CHUNK]])
                            open_ |= (most >= floors[:, None] - 1e-9 * np.abs(floors[:, None])).any(axis=0) if len(floors) else True
                    at = np.argsort(-votes, kind="stable")[:PROBES] if first else np.flatnonzero(open_)
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array([row["pack"]] * len(at), pa.int64()), pa.array([row["roots"][i]["shard"] for i in at.tolist()], pa.int32())], names=["d", "pack", "shard"])

        return run

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(packs: DataFrame, first: bool) -> DataFrame:
        """Packs beside the shards that they have to look into."""
        fields = ["d", "pack", "qids", "qrows", "roots"] + ([] if first else ["floors"])
        pairs = materialise(packs.join(roots, "d").select(*fields).mapInArrow(returning(chosen(first)), "d int, pack long, shard int"))
        # numbers of partitions are given, so that few bytes for much work are not put in few tasks
        return pairs.join(packs.drop("d"), "pack").repartition(tasks, "d", "shard").join(shards.repartition(tasks, "d", "shard"), ["d", "shard"])

    def kernel(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], list[tuple[int, int]]] = {}

            def out() -> pa.RecordBatch:
                r = [[q for _, q in best], [[-i for _, i in v] for v in best.values()], [[s for s, _ in v] for v in best.values()], [d for d, _ in best]]
                best.clear()
                return pa.RecordBatch.from_arrays([pa.array(r[0], pa.int64()), pa.array(r[1], pa.list_(pa.int64())), pa.array(r[2], pa.list_(pa.int64())), pa.array(r[3], pa.int32())], names=["query_id", "ids", "scores", "d"])

            for b in batches:
                for at in range(b.num_rows):
                    row = b.slice(at, 1).to_pylist()[0]
                    d, qids = row["d"], np.frombuffer(row["qids"], np.int64).tolist()
                    one = Searcher(Tree.unpack([row[p] for p in parts], d), widen(row["qrows"], len(qids), d))
                    floors = row.get("floors") or [None] * len(qids)
                    for k0 in range(0, len(qids), CHUNK):
                        for n, bound in enumerate(one.bounds(k0), k0):
                            key = (d, qids[n])
                            best[key] = one.search(n, bound, qids[n], k, best.get(key, []), floors[n], PROBE_LEAVES if first else None)
                        if len(best) >= 50_000:
                            yield out()
            if best:
                yield out()

        return run

    fields = ["shard", "pack", "qids", "qrows", "d", *parts]
    schema = "query_id long, ids array<long>, scores array<long>, d int"

    def merged(found: DataFrame) -> DataFrame:
        near = found.select("query_id", "d", F.zip_with("scores", "ids", lambda a, b: F.struct((-a).alias("s"), b.alias("id"))).alias("near"))
        all_ = near.groupBy("query_id", "d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
        once = F.aggregate("near", F.expr("cast(array() as array<struct<s:bigint,id:bigint>>)"), lambda a, x: F.when(F.size(a) < k, F.when(F.exists(a, lambda y: y["id"] == x["id"]), a).otherwise(F.concat(a, F.array(x)))).otherwise(a))
        return all_.select("query_id", "d", once.alias("near"))

    probe = merged(met(packs, True).select(*fields).mapInArrow(returning(kernel(True)), schema))
    floors = materialise(probe.where(F.size("near") >= k).select("query_id", "d", (-F.element_at("near", k)["s"]).alias("floor")))

    def floored(packs: DataFrame) -> DataFrame:
        """Packs with the floor of each of their queries (null: none)."""

        def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, pack, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own = np.frombuffer(q, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([pack] * len(own), pa.int64()), pa.array([d] * len(own), pa.int32()), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["pack", "d", "n", "query_id"])

        each = packs.select("d", "pack", "qids").mapInArrow(returning(ids), "pack long, d int, n int, query_id long").join(floors, ["query_id", "d"], "left")
        got = each.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "floor"))), lambda x: x["floor"]).alias("floors"))
        return packs.join(got, "pack")

    final = merged(met(materialise(floored(packs)), False).select(*fields, "floors").mapInArrow(returning(kernel(False)), schema))
    return final.select("query_id", F.posexplode("near").alias("rank", "r")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.id").alias("vec_id"), (-F.col("r.s")).alias("score"))
