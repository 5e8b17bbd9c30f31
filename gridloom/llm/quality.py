"""A quality classifier: a generalised additive model with pairwise terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, crc_mod, returning, sample_of

#: Labelled rows to fit on, about; bins of a feature and, in a pair, of each of the two.
SAMPLE_ROWS, BINS, PAIR_BINS = 12_000, 48, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 150, 60, 0.15, 8
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "stop", "other_punct", "high",
    "distinct_words", "repeat_next", "distinct_pairs", "top_word", "symbol_ends", "lone_symbols", "distinct_lines", "line_words", "byte_entropy", "upper_words", "most_repeats",
)
# classes of bytes: 0 other, 1 upper, 2 digit, 3 space, 4 newline, 5 sentence mark, 6 other ASCII mark, 7 above ASCII
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 7 if _c > 127 else 1 if _ch.isupper() else 2 if _ch.isdigit() else 4 if _ch == "\n" else 3 if _ch.isspace() else 5 if _ch in ".,!?;:" else 6 if 32 < _c < 127 and not _ch.isalnum() else 0
_SYMBOL = re.compile(r"(?:[^\w\s.,;:]|!!)(?=\s|$)")
_PIECE = 4 << 20


def features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text. Shares, not counts, but for the logarithms of the length."""
    text = text or ""
    counts = np.zeros(256, np.int64)
    for k in range(0, len(text), _PIECE):
        counts += np.bincount(np.frombuffer(text[k : k + _PIECE].encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 8)
    n = max(1, counts.sum())
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    run = longest = 1
    again = 0
    last = None
    for w in words:
        if w == last:
            again += 1
            run += 1
            if run > longest:
                longest = run
        else:
            run = 1
        last = w
    p = counts[counts > 0] / n
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / m, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n,
        len(tally) / m, again / m, len(set(zip(words, words[1:], strict=False))) / m, max(tally.values(), default=0) / m,
        len(_SYMBOL.findall(text)) / m, sum(v for w, v in tally.items() if len(w) == 1 and not w.isalnum()) / m,
        len(set(lines)) / len(lines), np.log1p(m / len(lines)), -(p * np.log2(p)).sum(), sum(v for w, v in tally.items() if len(w) > 1 and w.isupper()) / m, np.log(longest),
    ])


@dataclass
class QualityModel:
    """Cuts between a feature's bins, its lookup table, and the tables of pairs; a score is one addition for each."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cuts, x[:, k], side="right")]
        for i, j, a, b, table in self.pairs:
            z += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton values of a shallow regression tree over ordered bins: the best cut, then the best in either part."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda s, w: s * s / (w + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for n, (a, b) in enumerate(spans):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(cg[k] - cg[a], ch[k] - ch[a]) + worth(cg[b] - cg[k], ch[b] - ch[k]) - worth(cg[b] - cg[a], ch[b] - ch[a])
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], n, int(k[i]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Cyclic boosting: every round fits a tree of three leaves on each feature in turn and adds it to the feature's table.

    Then the PAIRS pairs of features whose cells explain most of what is left
    get tables of their own, boosted likewise along rows and columns.
    """
    n, d = x.shape
    if not n:
        return QualityModel(0.0)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = QualityModel(float(np.log(rate / (1 - rate))))
    model.cuts = [_cuts(x[:, k], BINS) for k in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    z = np.full(n, model.bias)
    for _ in range(ROUNDS):
        for k in range(d):
            p = 1 / (1 + np.exp(-z))
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], y - p, size), np.bincount(bins[k], p * (1 - p), size))
            model.tables[k] += step
            z += step[bins[k]]
    small = [_cuts(x[:, k], PAIR_BINS) for k in range(d)]
    low = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(small)]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            shape = (len(small[i]) + 1, len(small[j]) + 1)
            cell = low[i] * shape[1] + low[j]
            g, h = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
            gains.append((float((g * g / (h + 1.0)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, small[i], small[j], np.zeros((len(small[i]) + 1, len(small[j]) + 1))))
    for _ in range(PAIR_ROUNDS):
        for i, j, _a, _b, table in model.pairs:
            p = 1 / (1 + np.exp(-z))
            cell = low[i] * table.shape[1] + low[j]
            g = np.bincount(cell, y - p, table.size).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            # a cut along one feature, then one along the other within each part
            first = _tree(g.sum(axis=1), h.sum(axis=1), 2)
            step = np.zeros(table.shape)
            for v in np.unique(first):
                rows = first == v
                step[rows] = _tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 2)
            table += RATE * step
            z += RATE * step[low[i], low[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on about ``sample_rows`` rows of ``labels`` (doc_id, quality) and their whole texts; the driver gets their features."""
    bounded_batches(docs.sparkSession)
    own = sample_of(labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")), F.col("doc_id"), sample_rows, 13)
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "text", "quality").mapInArrow(returning(run), "doc_id long, quality int, x array<double>").collect()  # sample_rows rows, about
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs`` (doc_id, text).

    Defined cases: a null text is scored as the empty one; a model fitted on
    no row scores 0.5; a score at the threshold is predicted; repeated rows
    each give a row; an empty table gives an empty table; further columns are
    not looked at.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(b.num_rows, len(FEATURES))
            s = held.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(returning(run), "doc_id long, score double, predicted int")


def score_held_out(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on labels whose crc32(doc_id) mod 5 is not 0; score every document."""
    model = train(docs, labels.where(crc_mod("doc_id", 5) != 0), sample_rows)
    return score(docs, model, threshold).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
