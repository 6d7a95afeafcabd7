"""Toxicity by a weighted finite-state pattern grammar (operator 9).

Words are read by a lexical transducer: insults (patterns with weights, learned
from labelled rows), threats (stems with the endings of their verbs), targets, negations (also contracted ones, and not those
that affirm, as in "no doubt") and verbs of reported speech.
Three small transducers over these tags (negation scope, reported speech,
target) are composed into one table, which reads each clause that holds a
matched word and gives it a weight. A threat counts when a target stands within
reach on either side: the target transducer also reads the clause from its end.
A document's evidence is the sum over its clauses, and a logistic curve fitted on the labelled sample turns it into a
score.

Defined results: null, empty and wordless texts have no evidence; a null id is in no held-out fold; a table
without labels falls back to the seed patterns and a fixed curve; rows that
repeat get a row each; labels outside 0 and 1 are ignored; extra columns pass
through :func:`score`, which replaces a column of the score's name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed word lists of the grammar (English, German, French, Spanish).
SEED_INSULTS = "idiot moron scum loser imbecile dumbass bastard vermin arschloch dummkopf connard salaud pendejo gilipollas"
#: Threats are stems with the endings of their verbs; the lexicon holds every form.
THREAT_FORMS = (
    ("kill murder hurt destroy slaughter beat shoot crush stab", "s ed ing en"), ("strangl", "e es ed ing"), ("stabb", "ed ing"),
    ("töt ermord", "e en est et ete eten"), ("umbring erschlag verprügel erschieß", "e en st t"),
    ("tue frappe étrangle massacre", "s r z nt ra rai ras rons ront"), ("détrui", "re s t sent sez sons ra rai ras rons"),
    ("mat golpe asesin estrangul", "a as ar an o amos ando aré ará arás aremos é ó"), ("destru", "ir yo ye yes yen iré irá irás iremos"),
)
#: Stems that are words by themselves.
BARE_THREATS = "kill murder hurt destroy slaughter beat shoot crush stab tue frappe étrangle massacre"
TARGETS = "you your yourself he she they him her them du dich ihr euch sie tu toi vous ils elles tú usted ustedes ellos"
NEGATIONS = "not never no nicht nie kein keine ne pas jamais nunca tampoco"
#: What follows a negation word that then negates nothing ("no doubt", "nicht nur").
AFFIRMING = "doubt question wonder only just merely nur seulement solo sólo"
REPORTS = "said says claimed reported wrote quoted called sagte schrieb behauptete dit écrit dijo escribió"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Reach of a negation and of a target, in words.
NEGATION_REACH, TARGET_REACH = 3, 3
#: What remains of a pattern's weight when negated or reported, and what a target adds.
NEGATED, REPORTED, TARGETED, THREATENED = 0.25, 0.4, 1.25, 3.0
#: Bytes of a word's start that a pattern may fix (0: the whole word).
PREFIXES = (4, 5, 6, 7, 8, 0)


@dataclass
class Transducer:
    """Deterministic weighted transducer over tags: (state, tag) -> (state, tag out, factor)."""
    start: object
    arcs: dict = field(default_factory=dict)

    def compose(self, other: "Transducer") -> "Transducer":
        """Reads with this machine, feeds its output to ``other``; factors multiply."""
        out = Transducer((self.start, other.start))
        todo = [out.start]
        while todo:
            a, b = state = todo.pop()
            if (state, OTHER) in out.arcs:
                continue
            for tag in range(6):
                na, mid, fa = self.arcs[a, tag]
                nb, end, fb = other.arcs[b, mid]
                out.arcs[state, tag] = ((na, nb), end, fa * fb)
                todo.append((na, nb))
        return out


def negation_scope() -> Transducer:
    """Matches within a few words after a negation lose weight."""
    t = Transducer(0)
    for left in range(NEGATION_REACH + 1):
        for tag in range(6):
            to = NEGATION_REACH if tag == NEGATION else max(0, left - 1)
            t.arcs[left, tag] = (to, tag, NEGATED if left and tag in (INSULT, THREAT) else 1.0)
    return t


def reported_speech() -> Transducer:
    """Matches after a verb of reporting lose weight to the end of the clause."""
    t = Transducer(False)
    for said in (False, True):
        for tag in range(6):
            t.arcs[said, tag] = (said or tag == REPORT, tag, REPORTED if said and tag in (INSULT, THREAT) else 1.0)
    return t


def target_scope() -> Transducer:
    """Matches within a few words after someone addressed or named gain weight."""
    t = Transducer(0)
    for left in range(TARGET_REACH + 1):
        for tag in range(6):
            to = TARGET_REACH if tag == TARGET else max(0, left - 1)
            t.arcs[left, tag] = (to, tag, TARGETED if left and tag in (INSULT, THREAT) else 1.0)
    return t


def threat_words() -> str:
    """Every form of every threat."""
    return " ".join([BARE_THREATS, *(stem + end for stems, ends in THREAT_FORMS for stem in stems.split() for end in ends.split())])


def contracted_negation(w: common.Words, which: np.ndarray) -> np.ndarray:
    """Which of some words are the end of a contraction like ``don't``: a "t" right after an apostrophe that a word in "n" stands
    before (the plain apostrophe cuts words), or a word that ends in n, the curled apostrophe and t."""
    out = np.zeros(len(w.start), bool)
    which = which[w.buf[w.end[which] - 1] == 0x74]          # it ends in t
    size, buf = (w.end - w.start)[which], w.buf
    t = which[(size == 1) & (w.start[which] - w.offsets[w.doc[which]] >= 2)]
    out[t] = (buf[w.start[t] - 1] == 0x27) & (buf[w.start[t] - 2] == 0x6E)
    long_ = which[size > 5]
    tail = np.stack([buf[w.end[long_] - k] for k in range(5, 1, -1)], 1)
    out[long_] = (tail == np.array([0x6E, 0xE2, 0x80, 0x99], np.uint8)).all(1)
    return out


GRAMMAR = negation_scope().compose(reported_speech()).compose(target_scope())
#: Read from a clause's end: which threats a target follows.
AHEAD = target_scope()

_CLAUSE_END = np.zeros(256, np.int64)
_CLAUSE_END[[ord(c) for c in ".!?;\n\r"]] = 1


def word_keys(w: common.Words, prefixes: tuple[int, ...] = PREFIXES) -> dict[int, np.ndarray]:
    """Per pattern length, the hash of each word's start (0 where the word is not longer)."""
    out: dict[int, np.ndarray] = {}
    size = w.end - w.start
    h = np.zeros(len(w.start), np.uint64)
    pw = common.powers(max(prefixes) + 1)
    last = max(len(w.buf) - 1, 0)
    for k in range(1, max(prefixes) + 1):
        if len(w.start):
            h = h + (w.buf[np.minimum(w.start + k - 1, last)].astype(np.uint64) + np.uint64(1)) * pw[k - 1]
        if k in prefixes:
            out[k] = np.where(size > k, common.mix64(h + np.uint64(k << 32)), np.uint64(0))
    if 0 in prefixes:
        out[0] = w.hash
    return out


def _hashes(words: str) -> np.ndarray:
    """Hashes of whole words of a list."""
    off, data = common.text_bytes(pa.array([words]))
    return common.cut_words(off, data, 0, 1).hash


@dataclass
class Model:
    """The lexicon (hash and weight per pattern length) and the curve ``a + b log(1 + evidence)``."""
    patterns: dict[int, tuple[np.ndarray, np.ndarray]]
    a: float = -3.0
    b: float = 3.0

    def __post_init__(self) -> None:
        threats = threat_words()
        tags = [(threats, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)]
        h = np.concatenate([_hashes(w) for w, _ in tags])
        t = np.concatenate([np.full(len(_hashes(w)), g) for w, g in tags])
        o = np.argsort(h)
        self.tag_hash, self.tag = h[o], t[o]
        self.sieve = {}
        for k, (hs, _) in self.patterns.items():
            self.sieve[k] = np.zeros(1 << 16, bool)
            self.sieve[k][(hs & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.threat_sieve = np.zeros(1 << 16, bool)
        self.threat_sieve[(_hashes(threats) & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.affirming = np.sort(_hashes(AFFIRMING))

    def evidence(self, w: common.Words) -> np.ndarray:
        """Summed clause weights per document."""
        total = np.zeros(w.n_docs)
        if not len(w.start):
            return total
        weight = np.zeros(len(w.start))
        for k, keys in word_keys(w).items():
            hs, ws = self.patterns.get(k, (np.zeros(0, np.uint64), np.zeros(0)))
            if not len(hs):
                continue
            hit = np.flatnonzero(self.sieve[k][(keys & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hs, keys[hit]), len(hs) - 1)
            good = hs[at] == keys[hit]
            weight[hit[good]] = np.maximum(weight[hit[good]], ws[at[good]])
        threat = self.threat_sieve[(w.hash & np.uint64(0xFFFF)).astype(np.int64)] & np.isin(w.hash, self.tag_hash[self.tag == THREAT])
        marked = np.flatnonzero((weight > 0) | threat)
        if not len(marked):
            return total
        ends = np.cumsum(_CLAUSE_END[w.buf])
        clause = ends[w.start] + w.doc       # never the same in two documents or clauses that follow each other
        lo = np.searchsorted(clause, clause[marked], "left")
        hi = np.searchsorted(clause, clause[marked], "right")
        inside = np.bincount(lo, minlength=len(w.start) + 1) - np.bincount(hi, minlength=len(w.start) + 1)
        contracted = contracted_negation(w, np.flatnonzero(np.cumsum(inside)[:-1] > 0))
        done = -1
        for i, j in zip(lo.tolist(), hi.tolist()):
            if i == done:
                continue
            done = i
            total[w.doc[i]] += self.clause(w.hash[i:j], weight[i:j], contracted[i:j])
        return total

    def clause(self, h: np.ndarray, weight: np.ndarray, contracted: np.ndarray) -> float:
        """The weight of one clause: runs the composed grammar over its tags."""
        at = np.minimum(np.searchsorted(self.tag_hash, h), len(self.tag_hash) - 1)
        tags = np.where(self.tag_hash[at] == h, self.tag[at], OTHER)
        affirms = np.append(np.isin(h[1:], self.affirming), False)
        tags = np.where((tags == NEGATION) & affirms, OTHER, np.where(contracted, NEGATION, tags))
        tags = np.where(weight > 0, INSULT, tags)
        tags = tags.tolist()
        followed = [False] * len(tags)
        if THREAT in tags:
            state = AHEAD.start
            for i in range(len(tags) - 1, -1, -1):
                state, _, factor = AHEAD.arcs[state, tags[i]]
                followed[i] = factor > 1
        state, total = GRAMMAR.start, 0.0
        for tag, wt, later in zip(tags, weight.tolist(), followed):
            earlier = state[1] > 0                   # a target stands shortly before
            state, tag, factor = GRAMMAR.arcs[state, tag]
            if tag == INSULT:
                total += wt * factor
            elif tag == THREAT and (earlier or later):
                total += THREATENED * (factor / TARGETED if earlier else factor)
        return total

    def score_texts(self, col: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a + self.b * np.log1p(self.evidence_of(col)))))

    def evidence_of(self, col: pa.Array) -> np.ndarray:
        off, data = common.text_bytes(col)
        out = np.zeros(len(off) - 1)
        for a, b in common.slices(off):
            out[a:b] = self.evidence(common.cut_words(off, data, a, b))
        return out


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, folds: int, held: int, id_col: str,
            text_col: str) -> DataFrame:
    """``y, text``: at most ``per_class`` labelled training texts of each class, each text once."""
    spark = docs.sparkSession
    train = labels.where(F.col("y").isin(0, 1) & (common.fold("doc_id", folds) != held)).select(
        "doc_id", F.col("y").cast("int").alias("y"))
    ids = [r for k in (0, 1) for r in train.where(F.col("y") == k).distinct()
           .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class).collect()]
    picked = spark.createDataFrame([(r["doc_id"], r["y"]) for r in ids], "_id long, y int")
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(picked), "_id").dropDuplicates(["text", "y"]).select("y", "text"))
    return common.stage(rows, "op9-sample")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts per class of all pattern candidates of the partition."""
    seen: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in PREFIXES}
    for b in batches:
        off, data = common.text_bytes(b.column("text"))
        y = np.asarray(b.column("y")).astype(np.int64)
        for i, j in common.slices(off):
            w = common.cut_words(off, data, i, j)
            label = y[i:j]
            for k, keys in word_keys(w).items():
                use = np.flatnonzero(keys)
                one = np.unique(common.mix64(keys[use] + w.doc[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                return_index=True)[1]
                seen[k].append((keys[use][one], label[w.doc[use][one]]))
    for k, parts in seen.items():
        if not parts:
            continue
        h, y = (np.concatenate(x) for x in zip(*parts))
        u, inv = np.unique(h, return_inverse=True)
        bad, good = (np.bincount(inv, y == c, len(u)).astype(float) for c in (1, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(bad), pa.array(good)],
            ["k", "h", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, min_share: float = 0.012, purity: float = 0.97,
        folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns the insult patterns and the curve from a bounded sample of labelled rows.

    A pattern (the start of a word, or a word) must occur in ``min_share`` of the
    sample's toxic texts, and ``purity`` of the texts that hold it must be toxic.
    Where several patterns fit a word, the largest weight counts. ``per_class`` bounds the sample.
    """
    rows = _sample(docs, labels, per_class, folds, held, id_col, text_col)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad_n, good_n = n.get(1, 0), n.get(0, 0)
    seeds = _hashes(SEED_INSULTS)
    got: dict[int, dict[int, float]] = {k: {} for k in PREFIXES}
    for h in seeds:
        got[0][int(h)] = 3.0
    if bad_n and good_n:
        counts = rows.mapInArrow(_candidates, "k int, h long, bad double, good double").groupBy("k", "h").agg(
            F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        least = max(5.0, min_share * bad_n)
        share = F.col("bad") / bad_n
        chosen = counts.where((F.col("bad") >= least) & (share / (share + F.col("good") / good_n) >= purity))
        # Bounded by the sample: each pattern stands in min_share of at most per_class texts.
        for r in chosen.collect():
            w = math.log(((r["bad"] + 0.5) / (bad_n + 1)) / ((r["good"] + 0.5) / (good_n + 1)))
            got[r["k"]][r["h"] & (2**64 - 1)] = w
    patterns = {}
    for k, table in got.items():
        hs = np.array(sorted(table), np.uint64)
        patterns[k] = (hs, np.array([table[int(h)] for h in hs]))
    model = Model(patterns)
    if not (bad_n and good_n):
        return model

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(model.evidence_of(b.column("text")))], ["y", "e"])

    seen = rows.mapInArrow(weigh, "y int, e double").collect()       # two numbers per row of the sample
    y = np.array([r["y"] for r in seen], float)
    model.a, model.b = _curve(np.log1p(np.array([r["e"] for r in seen])), y)
    return model


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, slope kept above zero."""
    z = np.stack([np.ones_like(x), x], 1)
    c = np.array([-1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        g = z.T @ (y - p) - ridge * c
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), g)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(max(c[1], 0.1))


def score(docs: DataFrame, model: Model, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text added; all columns pass through."""
    keep = [c for c in docs.columns if c != out]
    src = docs.select(*keep)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score_texts(b.column(at)))], [*keep, out])

    return src.mapInArrow(run, common.with_field(src.schema, out, "double"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels outside fold 0 of 5."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")))
    out = score(docs, model).select("doc_id", common.held("doc_id", 5, 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
