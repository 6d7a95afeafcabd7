"""Quality rules: a learned decision list over text statistics (operator 11).

One narrow pass counts the statistics of every whole text. From labelled rows a
list of rules is learned by sequential covering: a rule, a conjunction of
thresholds on ratios of the counts, is grown literal by literal by information
gain on two thirds of the sample until it covers no good row, cut back to the
prefix that is best on the other third, and kept if precise enough there; the rows it
covers leave and the next rule is grown. The list comes out as one ordered
Spark conditional expression (:func:`decision`), which judges all rows in the JVM.

Defined results: null, empty and blank texts have no words and fail the base
rules; without labels of both classes the list is empty and every text that passes
the base rules is kept; labels outside 0 and 1 are ignored; texts of any length are
counted whole; rows that repeat get a row each; a null id is in no held-out fold; an empty table gives no rows.
Columns beyond id and text are ignored by :func:`measure` and kept as they are by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits",
          "n_marks", "n_lines", "n_symbol_words", "n_shouted", "n_bare", "n_distinct", "n_top")
#: Ratios that rules speak of, as SQL over the counts.
RATIOS = {
    "words": "n_words", "mean_word": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "symbol_words": "n_symbol_words / greatest(n_words, 1)", "bare_words": "n_bare / greatest(n_words, 1)",
    "shouted_words": "n_shouted / greatest(n_words, 1)", "distinct_words": "n_distinct / greatest(n_words, 1)",
    "top_word": "n_top / greatest(n_words, 1)", "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)", "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper": "n_upper / greatest(n_chars, 1)", "digits": "n_digits / greatest(n_chars, 1)", "marks": "n_marks / greatest(n_chars, 1)",
}
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

# Kinds of bytes.
OTHER, UPPER, LOW, DIGIT, MARK, SYMBOL, REST = range(7)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x30:0x3A], KIND[0x80:0xC0] = UPPER, LOW, DIGIT, REST
KIND[[ord(c) for c in ".,;:!?"]] = MARK
KIND[[ord(c) for c in "#*$%&|<>"]] = SYMBOL
NOT_LF = np.ones(256, bool)
NOT_LF[0x0A] = False


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Small numbers that are equal exactly where both columns are."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1].astype(np.int64)


def repeated_words(ids: np.ndarray, doc: np.ndarray, sizes: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of ``k`` (a power of two) words that its text holds twice or more."""
    n = len(ids)
    if n < k:
        return np.zeros(n, bool)
    names, step = ids, 1
    while step < k:                                   # names of 2, 4, 8 consecutive words, told exactly
        names = _pair_names(names[:-step], names[step:])
        step *= 2
    first = np.flatnonzero(np.repeat(np.cumsum(sizes), sizes)[:len(names)] >= np.arange(len(names)) + k)
    _, inv, count = np.unique(doc[first] * (names.max() + 1) + names[first], return_inverse=True, return_counts=True)
    again = first[count[inv] > 1]
    depth = np.bincount(again, minlength=n + 1) - np.bincount(again + k, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def statistics(col: pa.Array) -> np.ndarray:
    """The :data:`COUNTS` of each text, a row per text."""
    off, data = common.text_bytes(col)
    out = np.zeros((len(off) - 1, len(COUNTS)), np.int64)
    for a, b in common.slices(off):
        n = b - a
        w = common.cut_words(off, data, a, b, common.NOT_SPACE, lower=False)
        ln = common.cut_words(off, data, a, b, NOT_LF, lower=False)
        kind = KIND[w.buf]
        by_kind = np.bincount(np.repeat(np.arange(n), np.diff(w.offsets)) * 8 + kind, minlength=n * 8).reshape(n, 8)
        chars = np.diff(w.offsets) - by_kind[:, REST]

        def upto(mask: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

        def within(total: np.ndarray, x: common.Words) -> np.ndarray:
            return total[x.end] - total[x.start]

        size = w.per_doc().astype(np.int64)
        up, low, sym = within(upto(kind == UPPER), w), within(upto(kind == LOW), w), within(upto(kind == SYMBOL), w)
        alnum = within(upto(common.ALNUM[w.buf]), w)
        not_rest = upto(common.NOT_SPACE[w.buf] & (kind != REST))
        ids = common.exact_ids(common.word_strings(w, common.NOT_SPACE))
        seen, count = np.unique(w.doc * (ids.max(initial=0) + 1) + ids, return_counts=True)
        owner = seen // (ids.max(initial=0) + 1)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, owner, count)
        worded = within(upto(common.NOT_SPACE[w.buf]), ln) > 0
        line_ids = common.exact_ids(common.word_strings(ln, NOT_LF))[worded]
        n_lines = np.bincount(ln.doc[worded], minlength=n)
        kinds_of_line = np.unique(ln.doc[worded] * (line_ids.max(initial=0) + 1) + line_ids) // (line_ids.max(initial=0) + 1)

        def per(mask: np.ndarray) -> np.ndarray:
            return np.bincount(w.doc[mask], minlength=n)

        out[a:b] = np.stack([
            size, np.diff(not_rest[w.offsets]), by_kind[:, SYMBOL], n_lines - np.bincount(kinds_of_line, minlength=n),
            per(repeated_words(ids, w.doc, size)), chars, by_kind[:, UPPER], by_kind[:, DIGIT], by_kind[:, MARK], n_lines,
            per(sym > 0), per((up > 1) & (low == 0)), per(alnum == 0), np.bincount(owner, minlength=n), top], 1)
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the :data:`COUNTS` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["doc_id", *COUNTS])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)))


@dataclass(frozen=True)
class Literal:
    """``ratio <= cut`` or ``ratio > cut``."""
    ratio: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"{RATIOS[self.ratio]} {'>' if self.above else '<='} {self.cut!r}D"

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.ratio] > self.cut if self.above else x[self.ratio] <= self.cut

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; texts that meet it are rejected. ``bad``, ``good``: rows of the sample it took when learned."""
    literals: tuple[Literal, ...]
    bad: int
    good: int

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([lit.covers(x) for lit in self.literals])

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()
    keep_rest: bool = True
    cuts: dict = field(default_factory=dict, compare=False)

    def __str__(self) -> str:
        return "\n".join([f"if {r}: reject ({r.bad} bad, {r.good} good)" for r in self.rules]
                         + [f"else: {'keep' if self.keep_rest else 'reject'}"])


def grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Literal]:
    """Literals taken one after the other by FOIL's gain until no good row is covered."""
    rows, out = np.arange(len(bad)), []
    bins = {k: np.searchsorted(c, x[k], "left") for k, c in cuts.items()}     # x <= c[j] exactly for bins <= j
    while len(out) < most:
        y = bad[rows]
        p0, n0 = int(y.sum()), int((~y).sum())
        if not n0 or not p0:
            break
        best = None
        for k, c in cuts.items():
            if not len(c):
                continue
            h = np.stack([np.bincount(bins[k][rows[m]], minlength=len(c) + 1) for m in (y, ~y)])
            below = np.cumsum(h, 1)[:, :-1]
            for above in (False, True):
                p, n = (below[:, :] if not above else np.array([[p0], [n0]]) - below)
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                gain[p == 0] = 0.0
                j = int(np.argmax(gain))
                if gain[j] > 1e-6 and n[j] < n0 and (best is None or gain[j] > best[0] + 1e-9):
                    best = (float(gain[j]), Literal(k, above, float(c[j])))
        if best is None:
            break
        out.append(best[1])
        rows = rows[best[1].covers({best[1].ratio: x[best[1].ratio][rows]})]
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_literals: int = 4, precision: float = 0.9,
          n_cuts: int = 63) -> DecisionList:
    """The decision list of some labelled rows (``bad``: label 0); every third row prunes."""
    if not bad.any() or bad.all():
        return DecisionList()
    cuts = {}
    for k, v in x.items():
        q = np.unique(np.quantile(v, np.linspace(0, 1, n_cuts + 2), method="nearest"))
        cuts[k] = np.unique([float(f"{c:.6g}") for c in (q[1:] + q[:-1]) / 2])
    prune = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules:
        g, p = left & ~prune, left & prune
        if not bad[g].any():
            break
        lits = grow({k: v[g] for k, v in x.items()}, bad[g], cuts, most_literals)
        if not lits:
            break
        # The prefix that tells bad from good rows best where it was not grown; of equals the shortest.
        part, scores = {k: v[p] for k, v in x.items()}, []
        for n in range(1, len(lits) + 1):
            hit = Rule(tuple(lits[:n]), 0, 0).covers(part)
            b, c = int((hit & bad[p]).sum()), int((hit & ~bad[p]).sum())
            scores.append(((b - c) / (b + c) if b + c else -1.0, b, c))
        n = int(np.argmax([s for s, _, _ in scores]))
        b, c = scores[n][1:]
        hit = Rule(tuple(lits[:n + 1]), 0, 0).covers(x) & left
        if b + c and b / (b + c) < precision or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(Rule(tuple(lits[:n + 1]), int((hit & bad).sum()), int((hit & ~bad).sum())))
        left &= ~hit
    rest = bad[left]
    return DecisionList(tuple(rules), bool(2 * rest.sum() <= len(rest)), cuts)


def fit(measured: DataFrame, labels: DataFrame, per_class: int = 20_000, folds: int = 5, held: int = 0, **options) -> DecisionList:
    """Learn from ``labels (doc_id, y)`` outside fold ``held``, on rows that pass the base rules.

    The sample is bounded: ``per_class`` rows of each label, those whose id's hash is least.
    """
    rows = (measured.where(~F.expr(BASE_FAILED)).where(common.fold("doc_id", folds) != held)
            .join(labels.where(F.col("y").isin(0, 1)).select("doc_id", F.col("y").cast("int").alias("y")), "doc_id"))
    rows = rows.select(F.xxhash64("doc_id", F.lit(11)).alias("h"), "doc_id", "y",
                       *[F.expr(e).cast("double").alias(k) for k, e in RATIOS.items()])
    got = []
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy("h", "doc_id", *RATIOS).limit(per_class)
        got += [tuple(r) for r in part.collect()]
    got.sort()
    table = np.array([r[3:] for r in got], float).reshape(len(got), len(RATIOS))
    return learn({k: table[:, i] for i, k in enumerate(RATIOS)}, np.array([r[2] == 0 for r in got], bool), **options)


def decision(model: DecisionList) -> Column:
    """The list as one ordered Spark conditional over the :data:`COUNTS`: whether a text is kept."""
    out = F
    for r in model.rules:
        out = out.when(F.expr(" AND ".join(f"({lit.sql()})" for lit in r.literals)), F.lit(False))
    return out.otherwise(F.lit(model.keep_rest)) if model.rules else F.lit(model.keep_rest)


def which_rule(model: DecisionList) -> Column:
    """The number of the first rule that a text meets, from 1; null if none."""
    out = F
    for i, r in enumerate(model.rules):
        out = out.when(F.expr(" AND ".join(f"({lit.sql()})" for lit in r.literals)), F.lit(i + 1))
    return out.otherwise(F.lit(None).cast("int")) if model.rules else F.lit(None).cast("int")


def judge(measured: DataFrame, model: DecisionList) -> DataFrame:
    """``measured`` with ``base_failed``, ``kept`` and ``rule``."""
    failed = F.expr(BASE_FAILED)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & decision(model),
                                 "rule": F.when(~failed, which_rule(model))})


def keep(docs: DataFrame, model: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, columns as they were."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    src = docs.toDF(*names)
    schema = src.schema
    for c in COUNTS:
        schema = common.with_field(schema, c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c)) for c in x.T)], [*names, *COUNTS])

    return judge(src.mapInArrow(run, schema), model).where("kept").select(*names).toDF(*docs.columns)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the base rules and by a list learned from quality labels outside fold 0 of 5."""
    measured = common.stage(measure(common.read(spark, sf_dir, "documents")), "op11-counts")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return judge(measured, fit(measured, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule",
        common.held("doc_id", 5, 0).alias("held_out"))
