"""Language identification by error-correcting output codes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, crc_mod, returning, sample_of

#: Labelled rows that the classifiers are fitted on, about.
SAMPLE_ROWS = 12_000
#: Of those, documents whose own margins set the scales, at most.
CALIBRATION = 4_000
#: Buckets of hashed n-grams, and the lengths of n-grams in bytes.
BUCKETS, ORDERS = 1 << 15, (2, 3, 4)
#: A text is ambiguous if its best language is less likely than this.
SURE = 0.8
_WORDY = re.compile(r"[^\W\d_]")
_SPACED = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_PIECE = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numerals such as a half or a superscript are none."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def ngrams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text: lower case, ASCII other than letters as spaces."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(raw), _PIECE):
        a = _SPACED[raw[k : k + _PIECE + max(ORDERS) - 1]].astype(np.uint32)
        for n in ORDERS:
            m = min(_PIECE, len(a) - n + 1)
            if m > 0:
                h = a[:m] * _MIX[0]
                for i in range(1, n):
                    h = (h ^ a[i : i + m]) * _MIX[i]
                counts += np.bincount(h >> np.uint32(17), minlength=BUCKETS)
    return counts


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of ``n`` classes, one row each.

    Up to seven classes get every division of the classes in two; more get
    the best of a few seeded random codes by the least distance of two rows.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1 if k == 0 or (b >> (k - 1)) & 1 else -1 for b in range((1 << (n - 1)) - 1)] for k in range(n)], float)
    bits, rng, best = int(10 * np.log2(n)) + 1, np.random.default_rng(5), None
    for _ in range(50):
        code = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class LanguageModel:
    """languages; code: a row each; weights: buckets x bits; scale, shift, worth: one for each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    worth: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        seen = np.flatnonzero(counts)
        n = counts[seen]
        return self.scale * (n @ self.weights[seen] / max(1, n.sum())) + self.shift

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, likelihood and whether the text is ambiguous."""
        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0, True
        # each bit's logistic loss against each codeword, weighed by the bit's worth on the sample
        loss = np.logaddexp(0, -self.code * self.margins(ngrams(text))) @ self.worth
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < SURE)


def fit(sums: dict[str, np.ndarray], some: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Fit a binary n-gram classifier for each bit of the codewords.

    ``sums``: n-gram counts of each language; ``some``: language, buckets and
    counts of single documents. A classifier's weights are the n-grams'
    log-odds between the languages whose bit is on and those whose bit is
    off, the languages counting alike. A logistic scale and shift, fitted on
    the single documents, follow; the bit's worth is its share of right
    answers above chance.
    """
    names = sorted(sums)
    code = codewords(len(names))
    bits = code.shape[1]
    if len(names) < 2:
        return LanguageModel(names, code, np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones(1), np.ones(1))
    per = np.stack([sums[k] for k in names]) + 0.5
    per = per / per.sum(axis=1, keepdims=True)
    on = code > 0
    weights = np.stack([np.log(per[on[:, b]].mean(axis=0)) - np.log(per[~on[:, b]].mean(axis=0)) for b in range(bits)], axis=1).astype(np.float32)
    f = np.array([n @ weights[at] / max(1, n.sum()) for _, at, n in some])
    which = np.array([names.index(x) for x, _, _ in some])
    scale, shift, worth = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        x, y = f[:, b], on[which, b].astype(float)
        unit = x.std() or 1.0
        x, a, c = x / unit, 1.0, 0.0
        for _ in range(30):  # Newton steps, with a ridge that keeps parted classes finite
            p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
            v = p * (1 - p) + 1e-4
            g = np.array([((y - p) * x).sum() - 0.05 * a, (y - p).sum() - 0.05 * c])
            h = np.array([[(v * x**2).sum() + 0.05, (v * x).sum()], [(v * x).sum(), v.sum() + 0.05]])
            step = np.clip(np.linalg.solve(h, g), -2, 2)
            a, c = a + step[0], c + step[1]
        scale[b], shift[b] = a / unit, c
        worth[b] = max(0.05, 2 * np.mean((a * x + c > 0) == (y > 0)) - 1)
    return LanguageModel(names, code, weights, scale, shift, worth)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on about ``sample_rows`` rows of ``docs`` (doc_id, text, lang), rows without a lang left out.

    Executors count n-grams; the driver adds the sampled rows' counts up, one
    partition after the other, and holds CALIBRATION of them at most.
    """
    bounded_batches(docs.sparkSession)
    sample = sample_of(docs.where("lang is not null and text is not null").select("doc_id", "text", "lang"), F.col("doc_id"), sample_rows, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for t in b.column(0):
                counts = ngrams(t.as_py())
                seen = np.flatnonzero(counts)
                at.append(seen.astype(np.uint16).tobytes())
                n.append(counts[seen].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])

    sums: dict[str, np.ndarray] = {}
    some: list[tuple[str, np.ndarray, np.ndarray]] = []
    stride = 1
    for i, r in enumerate(sample.select("text", "lang").mapInArrow(returning(run), "lang string, at binary, n binary").toLocalIterator()):
        at, n = np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.int64)
        sums.setdefault(r["lang"], np.zeros(BUCKETS, np.int64))[at] += n
        if i % stride == 0:
            some.append((r["lang"], at, n))
            if len(some) >= CALIBRATION:
                some, stride = some[::2], stride * 2
    return fit(sums, some)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of ``docs`` (doc_id, text).

    Defined cases: ``und`` with score 0, ambiguous, for a null text or one
    without a letter; a text as likely in two languages gets the one first in
    code-point order, flagged ambiguous; repeated rows each give a row; an
    empty table gives an empty table, and a model fitted on no row says
    ``und``; further columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [held.value.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(returning(run), "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify_held_out(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on documents whose crc32(doc_id) mod 3 is not 1; predict every one. Null doc_ids are not learnt from, nor held out."""
    model = train(docs.where(crc_mod("doc_id", 3) != 1), sample_rows)
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
