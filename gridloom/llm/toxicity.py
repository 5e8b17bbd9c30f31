"""A toxicity classifier whose scores don't hang on identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bounded_batches, columns, crc_mod, materialise, returning, sample_of, unused

#: Labelled rows to fit on, about; features of the model, at most; documents that a feature must be in.
SAMPLE_ROWS, VOCABULARY, LEAST_DOCS = 12_000, 4_000, 4
#: Standard errors by which a feature's share of toxic documents must be off the usual one.
LEAST_Z = 3.0
#: Lengths of the beginnings and endings of words that are features beside whole words.
HEADS, TAILS = (4, 5, 6, 7, 8), (4, 5)
#: Swapped sentences that the penalty is taken over, about; longer lists are sampled by hash.
SWAPS = 50_000
#: Features that a task counts before it passes the counts on.
FLUSH = 200_000
#: Numbers of distinct words with one beginning that count.
SEVERAL = (2, 3, 5)
#: Weight of squared score changes under swaps, and of squared weights.
SWAP_PENALTY, RIDGE = 4.0, 0.02
THRESHOLD = 0.7
#: Groups of identity terms; a term is swapped for the others of its group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"),
    ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("disabled", "blind", "deaf"), ("old", "young"),
)
WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_PIECE = 1 << 20


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words (runs of letters, and of numerals that are no digits) of a text, some MB at a time."""
    out: set[str] = set()
    for piece in pieces(text or ""):
        out.update(WORD.findall(piece.lower()))
    return out


def marks(words: set[str]) -> set[str]:
    """Features of a set of words: the words, their beginnings (``ab-``) and endings (``-ab``).

    A beginning of SEVERAL distinct words or more also counts as one that is
    frequent in the text, with the number reached.
    """
    out = set(words)
    for n in HEADS:
        heads = Counter([w[:n] for w in words if len(w) > n])
        out.update([h + "-" for h in heads])
        out.update([f"{h}-{k}" for h, c in heads.items() if c >= SEVERAL[0] for k in SEVERAL if c >= k])
    for n in TAILS:
        out.update(["-" + w[-n:] for w in words if len(w) > n])
    return out


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def swaps(sentence: str) -> list[tuple[str, ...]]:
    """Word sets of the sentence with each identity term swapped for the others of its group, one at a time."""
    words, out = WORD.findall(sentence.lower()), []
    for group in IDENTITY:
        for term in group:
            if term in words:
                out += [tuple(sorted({other if w == term else w for w in words})) for other in group if other != term]
    return out


@dataclass
class ToxicityModel:
    """A bias, and a weight for each feature that a text has or has not."""

    bias: float
    weights: dict[str, float]

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & marks(words)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[list[str], int]], pairs: list[tuple[list[str], list[str]]], penalty: float = SWAP_PENALTY, ridge: float = RIDGE, steps: int = 400) -> ToxicityModel:
    """Logistic regression on word presence, with a penalty on score changes.

    ``rows``: the words of each document (of the vocabulary) and its label;
    ``pairs``: the words of labelled sentences before and after a swap. The
    penalty is the mean squared difference of the two scores, before the
    logistic function. Accelerated gradient steps on a convex loss.
    """
    vocab = sorted({w for ws, _ in rows for w in ws} | {w for p in pairs for ws in p for w in ws})
    at = {w: i for i, w in enumerate(vocab)}
    if not rows:
        return ToxicityModel(-2.0, {})
    y = np.array([label for _, label in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(ws) for ws, _ in rows])
    idx = np.array([at[w] for ws, _ in rows for w in ws], np.int64)
    sides = [(np.repeat(np.arange(len(pairs)), [len(p[k]) for p in pairs]), np.array([at[w] for p in pairs for w in p[k]], np.int64)) for k in (0, 1)]
    n, d, m = len(rows), len(vocab), max(1, len(pairs))
    rate = min(max((y.sum() + 0.5) / (n + 1), 1e-4), 1 - 1e-4)
    w, b = np.zeros(d), float(np.log(rate / (1 - rate)))
    seen = np.bincount(idx, minlength=d) + 1.0
    moment, second, mb, sb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[idx], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(idx, (p - y)[owner], d) + ridge * w
        if pairs:
            delta = np.bincount(sides[0][0], w[sides[0][1]], m) - np.bincount(sides[1][0], w[sides[1][1]], m)
            r = 2 * penalty * n / m * delta
            g += np.bincount(sides[0][1], r[sides[0][0]], d) - np.bincount(sides[1][1], r[sides[1][0]], d)
        g, gb = g / np.sqrt(seen), (p - y).sum() / np.sqrt(n)
        moment, second = 0.9 * moment + 0.1 * g, 0.99 * second + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate_t = 0.15 if t < steps * 0.6 else 0.02
        w -= rate_t * (moment / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        b -= rate_t * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-6)
    return ToxicityModel(b, {x: float(v) for x, v in zip(vocab, w, strict=True) if abs(v) > 1e-6})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on about ``sample_rows`` rows of ``labels`` (doc_id, toxic) and their texts.

    The vocabulary: features of LEAST_DOCS sampled documents or more whose
    share of toxic documents is off by LEAST_Z standard errors or more, the
    furthest first, VOCABULARY at most, and the identity terms. The penalty is
    taken over about SWAPS swaps of the sampled documents' sentences.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = sample_of(labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")), F.col("doc_id"), sample_rows, 11)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"))  # sample_rows rows, about

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for m in marks(words_of(text.as_py())):
                    c = seen.setdefault(m, [0, 0])
                    c[0] += 1
                    c[1] += toxic
                if len(seen) > FLUSH:
                    yield _counts(seen)
                    seen = {}
        yield _counts(seen)

    sums = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = sums["n"] or 0, sums["t"] or 0
    counts = sample.select("text", "toxic").mapInArrow(returning(count), "m string, d long, k long").groupBy("m").agg(F.sum("d").alias("d"), F.sum("k").alias("k")).where(F.col("d") >= LEAST_DOCS)
    share = t / n if n else 0.0
    z = F.abs(F.col("k") - F.col("d") * share) / F.sqrt(F.col("d") * (share * (1 - share)) + 1e-9)
    best = [r["m"] for r in counts.where(z >= LEAST_Z).orderBy(z.desc(), "m").limit(VOCABULARY).collect()]
    held = spark.sparkContext.broadcast(set(best) | {x for g in IDENTITY for x in g})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, vocab = {t for g in IDENTITY for t in g}, held.value
        pick = lambda words: sorted(vocab & marks(set(words)))
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

        for b in batches:
            for doc, t, toxic in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = t.as_py() or ""
                own = words_of(text)
                made: list[tuple] = [(doc, -1, toxic, pick(own), None)]  # the document itself
                for n, s in enumerate(_SENTENCE.findall(text) if not terms.isdisjoint(own) else ()):
                    made += [(doc, n, toxic, pick(WORD.findall(s.lower())), pick(x)) for x in swaps(s)]
                    if len(made) >= 1000:
                        yield out(made)
                        made = []
                yield out(made)

    made = materialise(sample.select("doc_id", "text", "toxic").mapInArrow(returning(read), "doc_id long, n long, toxic int, words array<string>, after array<string>"))
    rows = [(r["words"], r["toxic"]) for r in sorted(made.where("n < 0").collect(), key=lambda r: (r["doc_id"], r["words"]))]  # sample_rows rows, about
    kept = sample_of(made.where("n >= 0"), F.xxhash64("doc_id", "n", "words", "after"), SWAPS, 13).collect()
    return fit(rows, [(r["words"], r["after"]) for r in sorted(kept, key=lambda r: (r["doc_id"], r["n"], r["words"], r["after"]))])


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1)]], names=["m", "d", "k"])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs`` (doc_id, text).

    Defined cases: a null, empty or wordless text has the score of the bias;
    repeated rows each give a row; an empty table gives an empty table; a
    score at the threshold is predicted; further columns are not looked at,
    except those in ``keep``, which pass through, whatever their names, with
    the score behind them (gl_score, with underscores where ``docs`` has one).
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([held.value.score(words_of(t.as_py())) for t in b.column(1)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [held.value.score(words_of(t.as_py())) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], "score"])

    text, own = F.col("text").cast("string"), unused(docs, "gl_score")
    if keep is not None:
        # not every name can go through mapInArrow
        taken = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns(docs, keep))], text.alias("text"))
        return taken.mapInArrow(returning(run_all), T.StructType([*taken.schema.fields[:-1], T.StructField("score", T.DoubleType())])).toDF(*keep, own)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(returning(run), "doc_id long, score double, predicted int")


def score_held_out(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on labels whose crc32(doc_id) mod 3 is not 1; score every document."""
    model = train(docs, labels.where(crc_mod("doc_id", 3) != 1), sample_rows)
    return score(docs, model, threshold).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged.

    Defined cases: as :func:`score`; without a labelled row the model is its
    bias alone, which rejects nothing; an empty table gives an empty table;
    further columns pass through, whatever their names.
    """
    model = train(docs, labels.where(crc_mod("doc_id", 3) != 1), sample_rows)
    return score(docs, model, threshold, keep=docs.columns).where(F.col(unused(docs, "gl_score")) < threshold).select(*columns(docs))
