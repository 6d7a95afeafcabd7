"""Quality classifier: regularised quadratic discriminant analysis (operator 5).

Each text becomes a vector of transformed statistics. Per class, Spark sums the
moments of all labelled training rows; the class covariances are shrunk towards
the pooled one and its diagonal and factored once (Cholesky). A score is the
posterior from the difference of the two log densities, whose Mahalanobis terms
come from the cached factors.

Defined results: null and empty texts have the statistics of no characters and
are scored like any other; a row with a null id is scored and is not held out; a table without labels scores 0.5 everywhere, one
with a single class scores that class; rows that repeat get a row each; labels
outside 0 and 1 are ignored; extra columns pass through :func:`score`, which
replaces a column of the score's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Kinds of bytes: upper, lower, digit, blank, line end, sentence mark, other symbol, first and later non-ASCII byte.
UPPER, LOW, DIGIT, BLANK, LINE, MARK, SYMBOL, LEAD, REST = range(9)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x30:0x3A] = UPPER, LOW, DIGIT
KIND[[0x20, 0x09, 0x0B, 0x0C]], KIND[[0x0A, 0x0D]] = BLANK, LINE
KIND[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
KIND[0x80:0xC0], KIND[0xC0:] = REST, LEAD

STATISTICS = ("chars", "words", "upper", "digits", "blanks", "lines", "marks", "symbols", "non_ascii", "word_length",
              "word_length_spread", "symbol_words", "shouted_words", "distinct_words", "top_word", "echoed_words",
              "distinct_lines", "line_length")


#: Shares that a text of no characters is taken to have, and the counts with which they enter
#: every share: few characters, words or lines say little, so short texts stay near them.
CHAR_PRIOR, WORD_PRIOR, LINE_PRIOR = 40.0, 12.0, 4.0
TYPICAL_WORD, TYPICAL_SPREAD = 5.0, 9.0


def _rate(part: np.ndarray, whole: np.ndarray, typical: float, prior: float) -> np.ndarray:
    """Log-odds of a share drawn towards ``typical``."""
    p = (part + prior * typical) / (whole + prior)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def statistics(col: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    off, data = common.text_bytes(col)
    out = np.zeros((len(off) - 1, len(STATISTICS)))
    for a, b in common.slices(off):
        w = common.cut_words(off, data, a, b, common.NOT_SPACE, lower=False)
        n = b - a
        size = np.diff(w.offsets)
        doc_of = np.repeat(np.arange(n), size)
        kind = KIND[w.buf]
        c = np.bincount(doc_of * 16 + kind, minlength=n * 16).reshape(n, 16).astype(float)
        chars, words = size - c[:, REST], w.per_doc().astype(float)
        wlen = (w.end - w.start).astype(float)
        mean = (np.bincount(w.doc, wlen, n) + WORD_PRIOR * TYPICAL_WORD) / (words + WORD_PRIOR)
        var = (np.bincount(w.doc, (wlen - mean[w.doc]) ** 2, n) + WORD_PRIOR * TYPICAL_SPREAD) / (words + WORD_PRIOR)
        sym = np.concatenate([[0], np.cumsum(kind == SYMBOL, dtype=np.int64)])
        up = np.concatenate([[0], np.cumsum(kind == UPPER, dtype=np.int64)])
        low = np.concatenate([[0], np.cumsum(kind == LOW, dtype=np.int64)])
        has_sym = sym[w.end] > sym[w.start]
        shout = (up[w.end] > up[w.start]) & (low[w.end] == low[w.start])
        seen, count = np.unique(common.mix64(w.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                return_index=True, return_counts=True)[1:]
        distinct = np.bincount(w.doc[seen], minlength=n).astype(float)
        top = np.zeros(n)
        np.maximum.at(top, w.doc[seen], count)
        echo = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
        ln = common.cut_words(off, data, a, b, KIND != LINE, lower=False)
        lines = ln.per_doc().astype(float)
        first = np.unique(common.mix64(ln.hash + ln.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                          return_index=True)[1]
        dl = np.bincount(ln.doc[first], minlength=n).astype(float)
        out[a:b] = np.stack([
            np.log1p(chars), np.log1p(words), *[_rate(c[:, k], chars, t, CHAR_PRIOR) for k, t in (
                (UPPER, 0.03), (DIGIT, 0.005), (BLANK, 0.16), (LINE, 0.01), (MARK, 0.03), (SYMBOL, 0.003), (LEAD, 0.02))],
            np.log(mean), np.log(np.sqrt(var)),
            _rate(np.bincount(w.doc, has_sym, n), words, 0.02, WORD_PRIOR),
            _rate(np.bincount(w.doc, shout, n), words, 0.02, WORD_PRIOR),
            _rate(distinct, words, 0.7, WORD_PRIOR), _rate(top, words, 0.06, WORD_PRIOR),
            _rate(echo, words, 0.01, WORD_PRIOR), _rate(dl, lines, 0.97, LINE_PRIOR),
            np.log((size + LINE_PRIOR * 150) / (lines + LINE_PRIOR))], 1)
    return out


@dataclass
class Model:
    """Per class: log prior minus half the log determinant, mean, lower Cholesky factor."""
    const: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    only: float | None = None     # the score when there is no second class

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        dens = [c - 0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(0)
                for c, m, f in zip(self.const, self.mean, self.factor)]
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)),
                                            pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "x"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, x array<double>"))


def fit(measured: DataFrame, labels: DataFrame, shrink: float = 0.2, diagonal: float = 0.05,
        folds: int = 5, held: int = 0) -> Model:
    """Class densities from the rows of ``labels (doc_id, y)`` outside fold ``held``.

    ``shrink`` is the weight of the pooled covariance, ``diagonal`` that of the
    diagonal in what results.
    """
    rows = (measured.where(common.fold("doc_id", folds) != held)
            .join(labels.where(F.col("y").isin(0, 1)).select("doc_id", F.col("y").cast("int").alias("y")), "doc_id"))
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = np.asarray(b.column("y"))
            x = np.asarray(b.column("x").flatten()).reshape(len(y), d)
            for k in (0, 1):
                v = x[y == k]
                acc[k] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        at = np.arange(acc.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc.ravel())], ["at", "v"])

    sums = np.zeros(2 * (1 + d + d * d))
    for r in rows.mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    sums = sums.reshape(2, -1)
    n = sums[:, 0]
    if n.min() < 1:
        return Model([], [], [], only=0.5 if n.max() < 1 else float(n[1] >= 1))
    mean = [sums[k, 1:1 + d] / n[k] for k in (0, 1)]
    cov = [sums[k, 1 + d:].reshape(d, d) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    const, factor = [], []
    for k in (0, 1):
        s = (1 - shrink) * cov[k] + shrink * pooled
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(d)
        f = np.linalg.cholesky(s)
        factor.append(f)
        const.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum()))
    return Model(const, mean, factor)


def score(docs: DataFrame, model: Model, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text added; all columns pass through."""
    keep = [c for c in docs.columns if c != out]
    src = docs.select(*keep)
    at = keep.index(text_col)
    schema = common.with_field(src.schema, out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(model.score(statistics(b.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*keep, out])

    return src.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(measure(docs), labels.select("doc_id", F.col("quality").alias("y")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels outside fold 0 of 5."""
    measured = common.stage(measure(common.read(spark, sf_dir, "documents")), "op5-statistics")
    model = fit(measured, common.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")))

    @F.pandas_udf("double")
    def posterior(x):
        import pandas as pd
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    out = measured.select("doc_id", common.held("doc_id", 5, 0).alias("held_out"), posterior("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
