"""SimHash near-duplicates, found through tables of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, connected_components, materialise, returning, unused

SEED = 42
#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 2
#: Reference fingerprints of the table that every pair is held against, and of each band.
PIVOTS, BAND_PIVOTS = 24, 20
#: A bucket of more fingerprints goes another way, as exact: over shared neighbours (two bits) or in pairs of parts.
BUCKET, WIDE_BUCKET = 256, 4096
#: Shared part of two texts' shingle sets (Jaccard) from which they count as near copies where no contract says otherwise.
SIMILARITY = 0.8
#: Keys of a shingle set, and minima that make a key: sets at a similarity of 0.8 share no key once in 1.7 million times.
KEYS, KEY_MINIMA = 20, 3
#: Slices of the hash range in which two sets' members are counted, to bound what they share.
SLICES = 256
#: Sets of a group that meet in one task; WORDS shingles count as one set more. Larger groups go in parts.
GROUP, WORDS = 512, 8192
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 20


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of ``raw``, some MB at a time."""
    at = 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
                end += 1
        yield raw[at:end].split()
        at = end


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's word shingles, repeats included, in runs.

    Only A-Z is lower-cased; ASCII white space parts words. A text of fewer
    words than ``size`` has its whole sequence of words as its one shingle.
    """
    any_yet, last = False, []
    digest = xxhash.xxh64_intdigest
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        words = last + words
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(size)), strict=False)]
        if grams:
            any_yet = True
            h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
            for k in range(0, len(h), 1 << 16):
                yield h[k : k + (1 << 16)]
        last = words[-(size - 1) :] if size > 1 else []
    if not any_yet and last:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, size: int) -> int:
    """The 64-bit majority of a text's shingle hashes; no word (or null) gives zero. A tied bit is zero."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        ones += _ones(h)
        n += len(h)
    return _majority(ones, n)


def sketch(text: str | None, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A text's fingerprint, the keys of its shingle set (none without words), and the set as sorted 32-bit hashes."""
    ones, n, sets = np.zeros(64, np.int64), 0, []
    turns = np.random.default_rng(3).integers(0, 1 << 64, (2, KEYS * KEY_MINIMA), dtype=np.uint64)
    least = np.full(KEYS * KEY_MINIMA, np.iinfo(np.uint64).max)
    for h in shingle_hashes(text, size):
        ones += _ones(h)
        n += len(h)
        h = np.unique(h)
        for k in range(0, len(h), 4096):
            least = np.minimum(least, ((h[k : k + 4096, None] ^ turns[0]) * (turns[1] | np.uint64(1))).min(axis=0))
        sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    if not n:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int32)
    powers = np.cumprod(np.full(KEY_MINIMA, 0x9E3779B97F4A7C15, np.uint64))
    keys = ((least >> np.uint64(7)).reshape(KEYS, KEY_MINIMA) * powers).sum(axis=1, dtype=np.uint64) + np.arange(KEYS, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _majority(ones, n), keys.view(np.int64), sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))


def fingerprints(docs: DataFrame, size: int, column: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("t")).mapInArrow(returning(run), "doc_id long, fp long")


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def bands(max_bits: int) -> list[tuple[int, int]]:
    """Pairs of masks. Two fingerprints within ``max_bits`` bits agree on both masks of one pair at least.

    The 64 bits fall into ``max_bits`` + 1 bands, one of which no difference
    touches; the bits outside it fall into ``max_bits`` + 1 bands again. Beyond
    two bits, ``max_bits`` + 2 bands leave two untouched: every pair of bands.
    """
    if max_bits > 2:
        cut = [64 * i // (max_bits + 2) for i in range(max_bits + 3)]
        whole = [_mask(lo, hi) for lo, hi in zip(cut, cut[1:], strict=False)]
        return [(a, b) for i, a in enumerate(whole) for b in whole[i + 1 :]]
    k = max_bits + 1
    edges = [64 * i // k for i in range(k + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        rest = [b for b in range(64) if not lo <= b < hi]
        for j in range(k):
            own = rest[len(rest) * j // k : len(rest) * (j + 1) // k]
            out.append((_mask(lo, hi), sum(1 << b for b in own)))
    return out


def _pivots(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def distances(fps: np.ndarray, pivots: np.ndarray, mask: int = (1 << 64) - 1) -> np.ndarray:
    """The table of Hamming distances of fingerprints to pivots within a mask."""
    return np.bitwise_count((fps[:, None] ^ pivots[None, :]) & np.uint64(mask)).astype(np.int8)


def bucket_keys(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint one key for each pair of masks: the hash of its distances to the pivots within the masks."""
    pivots, out = _pivots(BAND_PIVOTS, 2), []
    for n, (first, second) in enumerate(bands(max_bits)):
        rows = np.ascontiguousarray(np.concatenate([distances(fps, pivots, first), distances(fps, pivots, second)], axis=1))
        # a polynomial in two odd multipliers, modulo 2^64
        powers = np.cumprod(np.full(rows.shape[1], 0x9E3779B97F4A7C15, np.uint64))
        key = (rows.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64) + np.uint64(n)
        out.append((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    return np.stack(out, axis=1)


def bucket_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that hold a bucket's fingerprints together as all pairs within ``max_bits`` bits would.

    Pairs whose distances to some pivot differ by more than ``max_bits`` are
    discarded; the others are verified. No link is given twice, nor one that
    others make needless.
    """
    table, root, links = distances(fps, _pivots(PIVOTS, 1)), list(range(len(fps))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(axis=1) <= max_bits) + i + 1
        for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= max_bits].tolist():
            a, b = top(i), top(j)
            if a != b:
                root[b] = a
                links.append((i, j))
    return links


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (``a``, ``b``) that join distinct fingerprints ``fp`` as all pairs within ``max_bits`` bits would.

    Defined cases: an empty table gives no link; further columns are not
    looked at; a fingerprint that comes twice may be linked to itself.
    """
    bounded_batches(fps.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(v), 4096):
                keys = bucket_keys(v[k : k + 4096].view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v[k : k + 4096], keys.shape[1])), pa.array(keys.reshape(-1).view(np.int64))], names=["fp", "key"])

    keys = materialise(fps.select("fp").mapInArrow(returning(keyed), "fp long, key long"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    full = materialise(keys.join(sizes, "key"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            flat, ends = b.column(0).flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(b.column(0).offsets.to_numpy()))
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                part = flat[lo:hi]
                out += [(int(part[i]), int(part[j])) for i, j in bucket_links(part.view(np.uint64), max_bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    most = BUCKET if max_bits == 2 else WIDE_BUCKET
    small = full.where(F.col("n") <= most).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(returning(linked), "a long, b long")
    # Within two bits: the same fingerprint once one bit, or none, of each is turned. Everyone who reaches a value links to the least.
    big = full.where(F.col("n") > most).select("fp").distinct()
    turned = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    if max_bits == 2:
        around = big.select("fp", F.explode(turned).alias("at"))
        hubs = around.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("at", "b")
        more = around.join(hubs, "at").select(F.col("fp").alias("a"), "b").where("a <> b")
    else:
        # parts of a bucket, each pair of parts a group of its own
        parts = F.ceil(F.col("n") / (most // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        dealt = full.where(F.col("n") > most).select("key", "fp", own.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q"))
        more = dealt.groupBy("key", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(returning(linked), "a long, b long")
    return small.unionAll(more)


def sketches(docs: DataFrame, size: int, column: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``cid`` (one for texts of equal fingerprint, keys and set) of every row; ``keys`` and ``shingles`` where a task meets a cid first."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            fps, cids, keys, sets = [], [], [], []
            for t in b.column(1):
                fp, key, found = sketch(t.as_py(), size)
                cid = xxhash.xxh64_intdigest(key.tobytes() + found.tobytes(), fp) - (1 << 63)
                new = cid not in seen and len(key) > 0
                seen.add(cid)
                fps.append(fp)
                cids.append(cid)
                keys.append(key if new else None)
                sets.append(found if new else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(cids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))],
                names=["doc_id", "fp", "cid", "keys", "shingles"],
            )

    kind = "doc_id long, fp long, cid long, keys array<long>, shingles array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("t")).mapInArrow(returning(run), kind)


def slice_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members of each sorted set of 32-bit hashes fall into each slice of their range."""
    cuts = (np.arange(1, SLICES) * (1 << 32) // SLICES - (1 << 31)).astype(np.int32)
    return np.stack([np.diff(np.searchsorted(s, cuts), prepend=0, append=len(s)) for s in sets]).astype(np.int32)


def group_links(fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that hold a group's fingerprints together as all pairs of sets at ``similarity`` or more would.

    Two sets share no more members of a slice than either has there. Pairs
    that sizes, or these bounds summed over the slices, keep below
    ``similarity`` are discarded; the sets of the others are compared.
    Fingerprints tell nothing here, as they count repeats; equal ones hold
    together without a link.
    """
    table, sizes, links = slice_counts(sets), np.array([len(s) for s in sets]), []
    root = np.unique(fps, return_inverse=True)[1]
    for i in range(len(fps) - 1):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9]
        most = np.minimum(table[j], table[i]).sum(axis=1)
        j = j[most >= similarity * (sizes[j] + sizes[i] - most) - 1e-9]
        for k in j.tolist():
            if root[k] != root[i]:
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[k] - both) - 1e-9:
                    links.append((i, k))
                    root[root == root[k]] = root[i]
    return links


def similar_links(store: DataFrame, similarity: float, known: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between fingerprints of ``sketches`` that, with ``known`` ones, join texts as all pairs at ``similarity`` would.

    Sets that share a key form a group; ``group_links`` tells its pairs. A large
    group meets in parts first. What is then apart from the group's largest
    component meets all of the group, again in parts, so no pair is left out
    that could still join something.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members in b.column(0):
                fps = members.values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = members.values.field(1).offsets.to_numpy()
                flat = members.values.field(1).values.to_numpy(zero_copy_only=False)
                found = group_links(fps.view(np.uint64), [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)], similarity)
                yield pa.RecordBatch.from_arrays([pa.array([int(fps[x[i]]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def meet(members: DataFrame, *by: str) -> DataFrame:
        lists = members.join(sets, "cid").groupBy(*by).agg(F.collect_list(F.struct("fp", "shingles")).alias("m"))
        return lists.select("m").mapInArrow(returning(linked), "a long, b long")

    def part(of: str, salt: int):
        return F.pmod(F.xxhash64(F.lit(salt), "key", "cid"), F.col(of)).cast("int")

    classes = store.where("keys is not null").dropDuplicates(["cid"]).select("cid", "fp", F.size("shingles").alias("w"), "keys")
    keyed = materialise(classes.select("cid", "fp", "w", F.explode("keys").alias("key")))
    weights = keyed.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.sum(1 + F.col("w") / WORDS) / GROUP).cast("int").alias("parts")).where("n > 1")
    met = materialise(keyed.join(weights, "key"))
    sets = materialise(store.where("keys is not null").select("cid", "shingles").join(met.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"]))
    first = materialise(meet(met.withColumn("p", part("parts", 0)), "key", "p"))
    large = met.where("parts > 1")
    if large.isEmpty():
        return first
    found = connected_components(first.unionAll(known)).withColumnRenamed("node", "fp")
    told = materialise(large.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    roots = told.groupBy("key", "root").agg(F.sum(1 + F.col("w") / WORDS).alias("m"))
    apart = roots.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.count("*").alias("roots"), F.ceil((F.sum("m") - F.max("m")) / (GROUP // 2)).cast("int").alias("others"))
    # halves of a group: everyone in one of ``halves`` parts, those apart in one of ``others`` parts as well
    dealt = materialise(told.join(apart.where("roots > 1"), "key").withColumn("halves", 2 * F.col("parts")))
    everyone = dealt.select("key", "cid", "fp", part("halves", 1).alias("p"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("q"))
    others = dealt.where("root <> most").select("key", "cid", "fp", F.explode(F.sequence(F.lit(0), F.col("halves") - 1)).alias("p"), part("others", 2).alias("q"))
    return first.unionAll(meet(everyone.unionAll(others).distinct(), "key", "p", "q"))


def near_duplicates(docs: DataFrame, size: int = 5, max_bits: int = MAX_BITS, column: str = "text", similarity: float | None = None) -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents link when their fingerprints differ in ``max_bits`` bits or
    fewer and, given a ``similarity``, also when their sets of shingles share
    so large a part of their union; component_id is the smallest doc_id
    reachable, the own included. Equal fingerprints are met once, so copies
    cost no pair.

    Defined cases: null, empty and blank texts have fingerprint zero, which
    links like any other; a null doc_id never is a component_id unless all of
    its component are null; repeated rows each give a row; an empty table
    gives an empty table; further columns are not looked at.
    """
    fps = materialise(fingerprints(docs, size, column) if similarity is None else sketches(docs, size, column))
    groups = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = materialise(links(groups, max_bits))
    if similarity is not None:
        edges = edges.unionAll(materialise(similar_links(fps, similarity, edges)))
    found = connected_components(edges)
    named = found.join(groups.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("component"))
    joined = found.join(named, "root").select(F.col("node").alias("fp"), "component")
    # a table of its own, so that Spark can split the task of a fingerprint that very many documents have
    ids = materialise(groups.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = 5, max_bits: int = MAX_BITS, similarity: float | None = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Of rows that repeat this doc_id one stays, any of them. A component of
    null doc_ids alone keeps one row too, as do all rows of a null doc_id
    together. Defined cases: as :func:`near_duplicates`; an empty table gives
    an empty table; further columns pass through, whatever their names.
    """
    key = unused(docs, "gl_id")
    parts = materialise(near_duplicates(docs, size, max_bits, similarity=similarity).select("component_id", "doc_id", "fingerprint"))
    once = parts.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(once, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    repeated = parts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(key))
    same = F.col("doc_id").eqNullSafe(F.col(key))
    single = kept.join(repeated, same, "left_anti")
    twice = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id"])
    return single.unionAll(twice)
