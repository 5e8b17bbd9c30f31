"""Mixing sources to target weights by a min-cost flow."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import columns, materialise
from gridloom.operators.reduce import numbered

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Membership patterns that the driver takes at most; more go the distributed way, which needs sources that do not overlap.
MAX_PATTERNS = 50_000
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the seeded hash that one narrowing pass looks at, and passes.
_STEP, _PASSES, _BITS = 10, 3, 60


def targets(sizes: Sequence[int], weights: Sequence[int], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, each at most ``max_repeats`` times its own size.

    What a stopped target leaves is reshared by weight until none is above.
    """
    total, order = sum(sizes), sorted(range(len(sizes)), key=lambda i: max_repeats * sizes[i] / weights[i])
    out, used, left = [0.0] * len(sizes), 0, sum(weights)
    for k, i in enumerate(order):
        if max_repeats * sizes[i] * left < weights[i] * (total - used):
            out[i] = float(max_repeats * sizes[i])
            used, left = used + max_repeats * sizes[i], left - weights[i]
        else:
            for j in order[k:]:
                out[j] = weights[j] * (total - used) / left
            break
    return out


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], max_repeats: int = MAX_REPEATS) -> list[list[int]]:
    """Words that each membership pattern gives to each of its sources.

    A min-cost flow from patterns to source quotas. A pattern's k-th pass
    over its words has a cost of k for each word, so repetition is spread
    where sources overlap. Patterns that share no source, not even by way of
    others, are networks of their own.
    """
    root = list(range(len(quota)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for own in members:
        for s in own[1:]:
            root[top(s)] = top(own[0])
    parts: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        if own:
            parts.setdefault(top(own[0]), []).append(p)
    out: list[list[int]] = [[0] * len(own) for own in members]
    for ps in parts.values():
        sources = sorted({s for p in ps for s in members[p]})
        at = {s: i for i, s in enumerate(sources)}
        for p, f in zip(ps, _flow([capacity[p] for p in ps], [[at[s] for s in members[p]] for p in ps], [quota[s] for s in sources], max_repeats), strict=True):
            out[p] = f
    return out


def _flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], max_repeats: int) -> list[list[int]]:
    """The min-cost flow of one network, by rising distance: potentials, then all that can flow along paths of the least cost at once."""
    n, m = len(capacity), len(quota)
    start, end, first = 0, 1, 2
    graph: list[list[int]] = [[] for _ in range(first + n + m)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, r, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(v)
        return len(to) - 2

    for p, c in enumerate(capacity):
        for k in range(max_repeats):
            edge(start, first + p, c, k + 1)
    lanes = [[edge(first + p, first + n + s, capacity[p] * max_repeats, 0) for s in own] for p, own in enumerate(members)]
    for s, q in enumerate(quota):
        edge(first + n + s, end, q, 0)
    height = [0] * len(graph)
    while True:
        far: list[int | None] = [None] * len(graph)
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e]:
                    v = d + cost[e] + height[x] - height[to[e]]
                    if far[to[e]] is None or v < far[to[e]]:
                        far[to[e]] = v
                        heapq.heappush(heap, (v, to[e]))
        if far[end] is None:
            return [[room[e ^ 1] for e in own] for own in lanes]
        for x, d in enumerate(far):
            height[x] += d if d is not None and d < far[end] else far[end]
        free = lambda e, x: room[e] > 0 and cost[e] + height[x] == height[to[e]]
        while True:  # rounds of shortest paths over the edges without reduced cost
            level, queue = {start: 0}, deque([start])
            while queue and end not in level:
                x = queue.popleft()
                for e in graph[x]:
                    if to[e] not in level and free(e, x):
                        level[to[e]] = level[x] + 1
                        queue.append(to[e])
            if end not in level:
                break
            turn, path, x = [0] * len(graph), [], start
            while True:
                if x == end:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    path, x = [], start
                while turn[x] < len(graph[x]):
                    e = graph[x][turn[x]]
                    if level.get(to[e]) == level[x] + 1 and free(e, x):
                        break
                    turn[x] += 1
                if turn[x] < len(graph[x]):
                    path.append(graph[x][turn[x]])
                    x = to[path[-1]]
                elif path:
                    x = to[path.pop() ^ 1]
                    turn[x] += 1
                else:
                    break


def _direct(patterns: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """The plan of ``patterns`` (pattern, size) of one source each, without a row on the driver: every pattern fills its own source's quota.

    The targets are those of :func:`targets`. Whoever the share at hand would
    take above its limit is stopped, all at once, until none is: the same
    sources as one by one in order, as a share only grows.
    """
    one = patterns.select("pattern", "size", F.element_at("pattern", 1).alias("s")).withColumn("last", F.col("s").isNull())
    place = F.pmod(F.col("gl_n"), F.lit(len(weights))).cast("int")
    own = numbered(one, ["last", "s"]).select("pattern", "size", (F.lit(max_repeats) * F.col("size")).alias("cap"), F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long").alias("w"))
    own = materialise(own)
    whole = own.agg(F.sum("size").alias("size"), F.sum("w").alias("w")).first()
    total, used, left, stopped = whole["size"], 0, whole["w"], 0
    while True:
        over = F.expr(f"cast(cap as decimal(19,0)) * cast({left} as decimal(19,0)) < cast(w as decimal(19,0)) * cast({total - used} as decimal(19,0))")
        now = own.where(over).agg(F.count("*").alias("n"), F.sum("cap").alias("cap"), F.sum("w").alias("w")).first()
        if now["n"] == stopped:
            break
        used, left, stopped = now["cap"], whole["w"] - now["w"], now["n"]
    share = F.when(over, F.col("cap").cast("double")).otherwise((F.col("w") * F.lit(total - used)).cast("double") / F.lit(float(left)))
    words = F.least(F.floor(F.col("target") + 0.5), F.col("cap"))
    return materialise(
        own.withColumn("target", share).withColumn("q", words)
        .selectExpr("pattern", "size as source_size", "target", "if(size > 0, q div size, 0L) as passes", "if(size > 0, q % size, 0L) as rest")
    )


def _ranked(df: DataFrame, few: bool) -> DataFrame:
    """Bits left of what is to be found in each pattern, narrowed to the cell that holds the boundary. ``few``: patterns fit in a broadcast."""
    for k in range(_PASSES):
        shift = _BITS - _STEP * (k + 1)
        cell = F.shiftright("h", shift)
        by = df.groupBy("pattern", "rest", cell.alias("cell")).agg(F.sum("size").alias("size"))
        # at most 2^10 cells a pattern meet here
        runs = by.withColumn("to", F.expr("sum(size) over (partition by pattern order by cell)"))
        edge = runs.where("to > rest and to - size <= rest").select("pattern", "cell", (F.col("rest") - F.col("to") + F.col("size")).alias("rest"))
        edge = materialise(edge.groupBy("pattern").agg(F.min(F.struct("cell", "rest")).alias("e")).select("pattern", "e.*"))
        df = df.drop("rest").join(F.broadcast(edge) if few else edge, "pattern").where(cell == F.col("cell")).drop("cell")
    return df


def _planned(spark: SparkSession, found: Sequence[Row], many: bool, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """The plan of at most MAX_PATTERNS patterns, by the flow."""
    names = sorted({s for r in found for s in r["pattern"]}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["pattern"]:
            sizes[at[s]] += r["size"]
    # words of overlapping documents count for each of their sources; what is shared out is each word once
    w = [weights[i % len(weights)] for i in range(len(names))]
    goal = targets(sizes, w, max_repeats) if not many else _overlapping(sizes, w, sum(r["size"] for r in found), max_repeats)
    flow = route([r["size"] for r in found], [[at[s] for s in r["pattern"]] for r in found], [int(g + 0.5) for g in goal], max_repeats)
    plan = [(r["pattern"], sum(sizes[at[s]] for s in r["pattern"]), float(sum(goal[at[s]] for s in r["pattern"])), *(divmod(min(sum(f), max_repeats * r["size"]), r["size"]) if r["size"] else (0, 0))) for r, f in zip(found, flow, strict=True)]
    return spark.createDataFrame(plan, "pattern array<string>, source_size long, target double, passes long, rest long")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes.

    ``source`` is a string, or an array of strings where sources overlap; a
    document's pattern is its set of sources. Sources in the order of code
    points, null last, have ``weights``, repeating, and share the sum of all
    sizes; see :func:`targets`. :func:`route` gives each pattern its words:
    whole passes over all of its documents, and for the rest the documents of
    smallest seeded hash (MD5 of the seed and doc_id), to the document whose
    end is nearest. The hash value of that end is found by narrowing
    histograms, so no source is sorted or gathered.

    Defined cases: a null or empty text has size 0 and takes 0; a null source
    (or an empty array) is a source of its own; rows of one doc_id in a
    source are taken or left together; a null doc_id hashes as its own
    value; an empty table gives an empty table; other columns are not looked
    at. More than MAX_PATTERNS patterns go without the driver where none has
    several sources, and raise an error where some have.

    Returns doc_id, size, source_size, target, taken; for overlapping sources
    source_size and target are sums over the pattern.
    """
    many = isinstance(docs.schema["source"].dataType, T.ArrayType)
    own = F.array_sort(F.array_distinct("source")) if many else F.array(F.col("source").cast("string"))
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string"))) if many else own
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 15)
    base = materialise(docs.select("doc_id", own.alias("pattern"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.conv(digits, 16, 10).cast("long").alias("h")))
    patterns = base.groupBy("pattern").agg(F.sum("size").alias("size"))
    found = patterns.limit(MAX_PATTERNS + 1).collect()
    few = len(found) <= MAX_PATTERNS
    if few:
        table = F.broadcast(_planned(docs.sparkSession, found, many, weights, max_repeats))
    elif many and not patterns.where(F.size("pattern") > 1).isEmpty():
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns, some of several sources")
    else:
        table = _direct(patterns, weights, max_repeats)
    same = base.join(table, base["pattern"].eqNullSafe(table["pattern"])).select(base["pattern"].alias("pattern"), "h", "size", "rest").where("rest > 0 and size > 0")
    text = F.to_json(F.col("pattern"))
    last = _ranked(same.select(text.alias("pattern"), "h", "size", "rest"), few).groupBy("pattern", "rest", "h").agg(F.sum("size").alias("size"))
    # the document at the boundary is taken if that ends nearer
    last = last.withColumn("to", F.expr("sum(size) over (partition by pattern order by h)")).where("to - size <= rest and to > rest")
    ends = materialise(last.groupBy("pattern").agg(F.min(F.struct("h", (F.col("to") - F.col("rest") < F.col("rest") - F.col("to") + F.col("size")).alias("over"))).alias("e")).select("pattern", F.col("e.h").alias("end"), "e.over"))
    ends = ends.withColumnRenamed("pattern", "p")
    ends = F.broadcast(docs.sparkSession.createDataFrame(ends.collect(), ends.schema)) if few else ends  # a row for each pattern
    full = F.col("passes") + F.when((F.col("rest") > 0) & ((F.col("h") < F.col("end")) | (F.col("over") & (F.col("h") == F.col("end")))), 1).otherwise(0)
    return (
        base.join(table, base["pattern"].eqNullSafe(table["pattern"])).select("doc_id", "size", "source_size", "target", "passes", "rest", "h", F.to_json(base["pattern"]).alias("p"))
        .join(ends, "p", "left")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * full).alias("taken"))
    )


def _overlapping(sizes: Sequence[int], weights: Sequence[int], total: int, max_repeats: int) -> list[float]:
    """As :func:`targets`, where ``total`` words are shared out and sources count the words that they share."""
    scale = sum(sizes)
    return [g * total / scale if scale else 0.0 for g in targets(sizes, weights, max_repeats)]


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it.

    Rows of size 0 (no word) are no part of a mix and go. Rows that repeat a
    doc_id are taken as often as any of them is.

    Defined cases: as :func:`mix_sources`; a null, empty or blank text goes; a
    null doc_id is a doc_id of its own; an empty table gives an empty table;
    further columns pass through, whatever their names.
    """
    taken = mix_sources(docs, weights, max_repeats, seed).where("taken > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("times"))
    has = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # a row is one column, so that no name of docs meets a working one
    whole = docs.where(has).select(F.struct(*columns(docs)).alias("row"))
    met = whole.join(taken, F.col("row.doc_id").eqNullSafe(F.col("id"))).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return met.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
