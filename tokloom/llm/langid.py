"""Language of words in code-switched text by a linear-chain CRF (operator 7).

Each word emits scores from hashed features (its first and last bytes, its byte
trigrams, the word itself as a lexicon entry); learned transitions join the
words of a text. Forward-backward gives each word's posterior over languages,
exactly and over the whole text; many texts advance in step, longest first.
A text's language is the one with the largest mean posterior.

Defined results: a text that is null or without a letter is ``und`` with score
0; without any labelled text every text is ``und``; null labels teach nothing;
rows that repeat get a row each; extra columns pass through :func:`predict`,
which replaces columns of its result's names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters: ASCII letters and all bytes of non-ASCII characters.
LETTERS = common.ALNUM.copy()
LETTERS[0x30:0x3A] = False
AFFIXES = (1, 2, 3, 4)
BITS = 17


def features(w: common.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of some words and, aligned with them, the position in ``which``."""
    start, end = w.start[which], w.end[which]
    size, n = end - start, len(which)
    mask = np.uint64((1 << BITS) - 1)
    at, of = [common.mix64(w.hash[which] + np.uint64(1)) & mask], [np.arange(n)]
    pre = np.zeros(n, np.uint64)
    suf = np.zeros(n, np.uint64)
    for k in range(1, max(AFFIXES) + 1):
        ok = np.flatnonzero(size >= k)
        pre[ok] = common.mix64(pre[ok] * np.uint64(257) + w.buf[start[ok] + k - 1] + np.uint64(k << 20))
        suf[ok] = common.mix64(suf[ok] * np.uint64(263) + w.buf[end[ok] - k] + np.uint64(k << 21))
        if k in AFFIXES:
            at += [pre[ok] & mask, common.mix64(suf[ok] + np.uint64(7)) & mask]
            of += [ok, ok]
    tri = np.flatnonzero(size >= 3)
    reps = size[tri] - 2
    if len(tri):
        word = np.repeat(tri, reps)
        step = np.arange(len(word)) - np.repeat(np.cumsum(reps) - reps, reps)
        p = start[word] + step
        b = w.buf
        g = (b[p].astype(np.uint64) << np.uint64(16)) | (b[p + 1].astype(np.uint64) << np.uint64(8)) | b[p + 2]
        at.append(common.mix64(g + np.uint64(1 << 40)) & mask)
        of.append(word)
    return np.concatenate(at).astype(np.int64), np.concatenate(of)


def emissions(weights: np.ndarray, feat: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Summed feature weights per word and language."""
    return np.stack([np.bincount(of, weights[feat, k], n) for k in range(weights.shape[1])], 1)


def forward_backward(e: np.ndarray, length: np.ndarray, trans: np.ndarray,
                     filtered: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of all words; ``e``: scores of the words of text after text, ``length``: words per text.

    ``filtered``, when given, receives the forward probabilities of the words.
    """
    if not len(e):
        return e
    k = e.shape[1]
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    size = length[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")     # texts longer than t
    base = np.concatenate([[0], np.cumsum(active)])
    perm = np.empty(len(e), np.int64)
    for t, n in enumerate(active):
        perm[base[t]:base[t + 1]] = first[:n] + t
    p = np.exp(e - e.max(1, keepdims=True))[perm]
    m = np.exp(trans - trans.max())
    alpha = np.empty_like(p)
    a = p[:base[1]] / k
    alpha[:base[1]] = a = a / a.sum(1, keepdims=True)
    for t in range(1, len(active)):
        a = (a[:active[t]] @ m) * p[base[t]:base[t + 1]]
        a /= a.sum(1, keepdims=True)
        alpha[base[t]:base[t + 1]] = a
    if filtered is not None:
        filtered[perm] = alpha
    beta = np.ones((active[0], k))
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        b = (beta[:n] * p[base[t + 1]:base[t + 2]]) @ m.T
        beta[:n] = b / b.sum(1, keepdims=True)
        alpha[base[t]:base[t + 1]] *= beta[:active[t]]
    alpha /= alpha.sum(1, keepdims=True)
    out = np.empty_like(alpha)
    out[perm] = alpha
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray       # features x languages
    trans: np.ndarray         # from x to

    def words(self, w: common.Words) -> np.ndarray:
        """Posterior per word; the scores of equal words are computed once."""
        u, one, inv = np.unique(w.hash, return_index=True, return_inverse=True)
        e = emissions(self.weights, *features(w, one), len(one))
        return forward_backward(e[inv], w.per_doc(), self.trans)

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: none) and score per text."""
        off, data = common.text_bytes(col)
        lang, score = np.full(len(off) - 1, -1), np.zeros(len(off) - 1)
        if not self.languages:
            return lang, score
        for a, b in common.slices(off, 4 << 20):
            w = common.cut_words(off, data, a, b, LETTERS)
            if not len(w.start):
                continue
            q = self.words(w)
            n = w.per_doc()
            mean = np.stack([np.bincount(w.doc, q[:, k], w.n_docs) for k in range(q.shape[1])], 1) / np.maximum(n, 1)[:, None]
            best = mean.argmax(1)
            lang[a:b] = np.where(n > 0, best, -1)
            score[a:b] = np.where(n > 0, np.clip(mean.max(1), 0, 1), 0)
            ascii_letters = np.concatenate([[0], np.cumsum(LETTERS[w.buf] & (w.buf < 0x80))])[w.offsets]
            for d in np.flatnonzero((n > 0) & (np.diff(ascii_letters) == 0)):
                if not any(c.isalpha() for c in w.buf[w.offsets[d]:w.offsets[d + 1]].tobytes().decode("utf-8", "replace")):
                    lang[a + d], score[a + d] = -1, 0
        return lang, score


def _windows(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """At most ``most`` runs of ``size`` words per text, spread evenly over the whole text."""
    for b in batches:
        off, data = common.text_bytes(b.column("text"))
        lang = b.column("lang").to_pylist()
        la, tx = [], []
        for i, j in common.slices(off):
            w = common.cut_words(off, data, i, j, LETTERS)
            ends = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
            for d in range(w.n_docs):
                lo, hi = int(ends[d]), int(ends[d + 1])
                runs = max(1, -(-(hi - lo) // size))
                for r in sorted({int(x) for x in np.linspace(0, runs - 1, min(most, runs))}):
                    s = [w.text(x) for x in range(lo + r * size, min(hi, lo + (r + 1) * size))]
                    if s:
                        la.append(lang[i + d])
                        tx.append(" ".join(s))
        yield pa.RecordBatch.from_arrays([pa.array(la, pa.string()), pa.array(tx, pa.string())], ["lang", "text"])


def fit(docs: DataFrame, per_language: int = 300, run_words: int = 40, runs: int = 6, epochs: int = 4,
        folds: int = 3, held: int = 1, seed: int = 5, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Learns from about ``per_language`` labelled texts of each language outside fold ``held``.

    The sample is drawn by a hash of the id. Of each text at most ``runs`` runs
    of ``run_words`` words reach the driver, spread over the text.
    """
    spark = docs.sparkSession
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (common.fold(id_col, folds) != held))
            .select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()       # a row per language, as the model has
    if not counts:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)))
    share = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in counts], "lang string, share double")
    u = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")
    got = picked.mapInArrow(lambda it: _windows(it, run_words, runs), "lang string, text string").collect()
    langs = sorted({r["lang"] for r in counts})
    texts = sorted((r["text"], r["lang"]) for r in got)
    return _learn(langs, [t for t, _ in texts], [langs.index(x) for _, x in texts], epochs, seed)


def _learn(langs: list[str], texts: list[str], label: list[int], epochs: int, seed: int, batch: int = 96) -> Model:
    """Adagrad on the log likelihood; two of five sequences switch language halfway."""
    k, rng = len(langs), np.random.default_rng(seed)
    model = Model(langs, np.zeros((1 << BITS, k)), np.zeros((k, k)))
    if k == 1 or not texts:
        return model
    off, data = common.text_bytes(pa.array(texts))
    w = common.cut_words(off, data, 0, len(texts), LETTERS)
    ends = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    feat, of = features(w, np.arange(len(w.start)))
    o = np.argsort(of, kind="stable")
    feat, fat = feat[o], np.searchsorted(of[o], np.arange(len(w.start) + 1))
    label = np.array(label)
    gw, gt = np.full(model.weights.shape, 1e-2), np.full((k, k), 1.0)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            mates = rng.permutation(part)
            seqs, gold = [], []
            for i, j in zip(part.tolist(), mates.tolist()):
                a = np.arange(ends[i], ends[i + 1])
                c = np.arange(ends[j], ends[j + 1])
                if rng.random() < 0.4:
                    a, c = a[:len(a) // 2 + 1], c[len(c) // 2:]
                else:
                    c = c[:0]
                seqs.append(np.concatenate([a, c]))
                gold.append(np.concatenate([np.full(len(a), label[i]), np.full(len(c), label[j])]))
            words, y = np.concatenate(seqs), np.concatenate(gold)
            length = np.array([len(s) for s in seqs])
            reps = fat[words + 1] - fat[words]
            at = np.repeat(np.arange(len(words)), reps)
            f = feat[np.repeat(fat[words], reps) + np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)]
            fwd = np.empty((len(words), k))
            q = forward_backward(emissions(model.weights, f, at, len(words)), length, model.trans, fwd)
            err = np.eye(k)[y] - q
            g = np.stack([np.bincount(f, err[at, c], 1 << BITS) for c in range(k)], 1) / len(part) - 1e-6 * model.weights
            gw += g * g
            model.weights += 0.3 * g / np.sqrt(gw)
            # Transitions: gold pairs less the posteriors of pairs, a_t(i) m(i,j) / sum_i a_t(i) m(i,j) * q_t+1(j).
            inner = np.flatnonzero(np.diff(np.repeat(np.arange(len(seqs)), length)) == 0)
            have = np.zeros((k, k))
            np.add.at(have, (y[inner], y[inner + 1]), 1)
            pair = np.exp(model.trans - model.trans.max())[None] * fwd[inner][:, :, None]
            pair *= (q[inner + 1] / pair.sum(1))[:, None, :]
            g = (have - pair.sum(0)) / max(1, len(inner)) - 1e-3 * model.trans
            gt += g * g
            model.trans += 0.3 * g / np.sqrt(gt)
    return model


def predict(docs: DataFrame, model: Model, out: str = "lang_pred", score: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the language of every whole text and its score added."""
    keep = [c for c in docs.columns if c not in (out, score)]
    src = docs.select(*keep)
    at = keep.index(text_col)
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, s = model.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[lang], pa.string()), pa.array(s)], [*keep, out, score])

    return src.mapInArrow(run, common.with_field(common.with_field(src.schema, out, "string"), score, "double"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from languages outside fold 1 of 3."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", common.held("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
