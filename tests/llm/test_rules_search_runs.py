"""Operators 11 (decision lists), 12 (ranked search) and 13 (periodic runs)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import LONG, ROWS, SCHEMA, edge, empty, prose
from conftest import SF_SMALL
from tokloom.llm import common, rules, runs, search

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(r):
    return tuple((x is None, x) for x in r)


# --- 11: decision lists --------------------------------------------------------------------

def brute_counts(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


TRICKY = [
    (20, "a b\n\n \na b\na b \n\na b", "en", "s", 1), (21, " ".join("abcdefgh" * 3), "en", "s", 1),
    (22, " ".join("x" * 30), "en", "s", 1), (23, "one two three four five six seven eight nine one two three four five six seven eight", "en", "s", 1),
    (24, "#a $b %é| <漢字> &*", "en", "s", 1), (25, "same line here\r\nsame line here\nsame line here\r\n", "en", "s", 1),
]


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").unionByName(spark.createDataFrame(ROWS + TRICKY, SCHEMA))
    got = rules.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r["doc_id"], *brute_counts(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_counts_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([t for _, t, *_ in ROWS + TRICKY])
    whole = rules.statistics(texts)
    monkeypatch.setattr(common.slices, "__defaults__", (50,))
    assert (rules.statistics(texts) == whole).all()


def table(n, seed=5):
    r = np.random.default_rng(seed)
    return {"a": r.random(n), "b": r.random(n), "c": r.integers(0, 3, n).astype(float)}


def test_rules_are_found_and_pruned():
    x = table(3000)
    bad = ((x["a"] > 0.7) & (x["b"] <= 0.4)) | (x["c"] == 2) & (x["b"] > 0.9)
    model = rules.learn(x, bad)
    hit = np.logical_or.reduce([r.covers(x) for r in model.rules])
    assert model.keep_rest and (hit == bad).mean() > 0.97 and 2 <= len(model.rules) <= 10
    used = {lit.ratio for lit in model.rules[0].literals}
    assert used == {"a", "b"}
    noise = rules.learn(x, np.random.default_rng(1).random(3000) < 0.2)      # nothing to learn
    assert noise.keep_rest and sum(r.bad + r.good for r in noise.rules) < 150


def test_growing_takes_the_best_gain():
    x, bad = table(200), table(200)["a"] > 0.5
    cuts = {k: np.unique(v) for k, v in x.items()}
    best = None
    for k, c in cuts.items():
        for cut in c:
            for above in (False, True):
                m = x[k] > cut if above else x[k] <= cut
                p, n = (m & bad).sum(), (m & ~bad).sum()
                if p and n < (~bad).sum():
                    gain = p * (np.log2(p / (p + n)) - np.log2(bad.mean()))
                    best = max(best or (gain,), (gain,))
    lits = rules.grow(x, bad, cuts, 1)
    m = lits[0].covers(x)
    assert (m & bad).sum() * (np.log2((m & bad).sum() / m.sum()) - np.log2(bad.mean())) == pytest.approx(best[0])


def test_the_spark_expression_is_the_list(spark):
    lit = rules.Literal
    model = rules.DecisionList((rules.Rule((lit("top_word", True, 0.3), lit("words", False, 40.0)), 1, 0),
                                rules.Rule((lit("upper", True, 0.01),), 1, 0)), True)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = rules.judge(rules.measure(docs), model).collect()
    for r in rows:
        n = max(r["n_words"], 1)
        first = (1 if r["n_top"] / n > 0.3 and r["n_words"] <= 40 else 2 if r["n_upper"] / max(r["n_chars"], 1) > 0.01 else None)
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and first is None)
        assert r["rule"] == (None if failed else first)
    assert {r["rule"] for r in rows} >= {2, None} and any(r["kept"] for r in rows)
    reject = rules.DecisionList((), False)
    assert rules.judge(rules.measure(docs), reject).where("kept").count() == 0


def test_held_out_verdicts(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    got = rules.op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.where("held_out and not base_failed").select("kept", "quality").collect()
    assert len(rows) > 500 and sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.98 * len(rows)


def test_rules_of_edge_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 0), (11, 5), (None, 1)], "doc_id long, y int")
    measured = rules.measure(edge(spark))
    model = rules.fit(measured, labels)
    got = rules.judge(measured, model).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((r[0] is None, r[0]) for r in ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"] and by[3]["base_failed"]
    assert rules.fit(measured, labels.where("false")) == rules.DecisionList()
    assert rules.judge(rules.measure(empty(spark)), model).count() == 0
    kept = rules.keep(edge(spark).withColumn("n_words", F.lit("x")).withColumn("rule", F.lit("y")), rules.DecisionList())
    assert kept.columns[-2:] == ["n_words", "rule"] and {r["n_words"] for r in kept.collect()} == {"x"}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if not r["base_failed"])


# --- 12: ranked search ---------------------------------------------------------------------

def brute_search(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in counts:
            n = sum(c.values())
            s = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
            if s > 0:
                rows.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(out, key=key)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=key)


@pytest.mark.parametrize("tiles", [None, (3, 2, 4)])
def test_search_equals_brute_force(spark, tiles, monkeypatch):
    if tiles:
        for name, n in zip(("VOCABULARY_TILE", "DOCUMENT_TILE", "ITEM_TILE"), tiles):
            monkeypatch.setattr(search, name, n)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ä", "漢字", "X1"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 40])))) for i in range(120)]
    docs += [(200, "w1 w2"), (201, "w1 w2"), (202, "W1-w2"), (None, "w1 w2"), (203, None), (203, "w1 w2")]      # ties
    items = [(1, "w1 w2 w1"), (2, "nothing here"), (3, None), (4, "ä 漢字 x1, w7"), (4, "w3"), (None, "w5 w6"), (7, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit("x")).withColumn("block", F.lit("y"))
    want = brute_search(docs, items)
    assert found(search.search(d.withColumn("n", F.lit("x")), q)) == want
    if not tiles:
        assert found(search.search(d, q, block_bytes=70)) == want           # several blocks of items
        assert found(search.search(d, q, k=3)) == brute_search(docs, items, 3)


def test_search_of_edge_tables(spark):
    items = spark.createDataFrame([(1, prose(9, 2)), (2, "one")], "item_id long, text string")
    assert found(search.search(edge(spark), items)) == brute_search([(r[0], r[1]) for r in ROWS], [(1, prose(9, 2)), (2, "one")])
    assert search.search(empty(spark), items).count() == 0
    assert search.search(edge(spark), items.where("false")).count() == 0


def test_ties_at_the_end_of_the_list_go_by_id():
    scores, doc = np.array([5, 7, 5, 5, 0, 5]), np.array([9, 8, 3, 4, 1, 2])
    rows = search.best(scores, doc, np.array([0, 0, 0, 0, 0, 1]), 3)
    assert doc[rows].tolist() == [8, 3, 4]


def test_sums_stay_exact():
    tf, n = np.array([1, 10**6, 10**9]), np.array([1, 10**6, 10**9])
    got = search.impacts(tf, n, 10**11, 10**14)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * m * 10**11 // 10**14)) for t, m in zip(tf.tolist(), n.tolist())]
    most = search.weights(2**62, np.array([0]))[0]
    assert most < 2**16 and got.max() < 2**20 and search.VOCABULARY_TILE * 2**36 < 2**53


# --- 13: periodic runs ---------------------------------------------------------------------

def brute_runs(w):
    out, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(2 * p, 12):
                out.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def some_words(r):
    k, n, kind = r.randint(1, 4), r.choice([0, 1, 5, 12, 13, 30, 60, 200]), r.random()
    if kind < 0.4:
        return [r.randrange(k) for _ in range(n)]
    if kind < 0.8:
        base = [r.randrange(k + 2) for _ in range(r.randint(1, 20))]
        return ([r.randrange(k) for _ in range(r.randint(0, 9))] + [base[i % len(base)] for i in range(n)]
                + [r.randrange(k) for _ in range(r.randint(0, 9))])
    f = [[0], [1]]
    while len(f[-1]) < n:
        f.append(f[-1] + f[-2])
    return f[-1][:n]


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_runs_equal_brute_force(step, monkeypatch):
    monkeypatch.setattr(runs, "GRID_STEP", step)
    r = random.Random(step)
    for _ in range(300):
        texts = [some_words(r) for _ in range(r.randint(1, 6))]
        got = [[] for _ in texts]
        for t, *run in zip(*(x.tolist() for x in runs.runs_of(
                np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts])))):
            got[t].append(tuple(run))
        assert got == [brute_runs(t) for t in texts]


def test_extensions_equal_brute_force():
    r = random.Random(2)
    for _ in range(60):
        body = some_words(r) + some_words(r)
        seq = np.array([0, *(x + 2 for x in body), 1])
        g = runs.Grammar(seq)
        assert len(g.seq[-1]) == 1 and (g.seq[0] == seq).all()
        n = len(seq)
        if n < 4:
            continue
        i = np.array([r.randrange(1, n - 1) for _ in range(200)])
        j = np.array([r.randrange(1, n - 1) for _ in range(200)])
        i, j = i[i != j], j[i != j]
        for forward in (True, False):
            got, d = g.extension(i, j, forward), 1 if forward else -1
            for a, b, m in zip(i.tolist(), j.tolist(), got.tolist()):
                k = 0
                while seq[a + d * k] == seq[b + d * k]:
                    k += 1
                assert m == k


def expected(doc, text, rewrite=False):
    w = re.findall(WORD, text or "")
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in found).encode()).hexdigest()
    return (doc, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            digest, hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("length(text) < 6000")
    got = runs.digests(runs.detect(docs, rewrite=runs.echoed_tails)).drop("n_words")
    want = [expected(r["doc_id"], r["text"], True) for r in docs.collect()]
    assert sum(w[1] > 0 for w in want) >= 10
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    whole = runs.op13_periodic_runs(spark, SF_SMALL)
    assert whole.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_runs_of_edge_rows(spark):
    rows = ROWS + [(30, "a " * 50_000, "en", "s", 1), (31, "x " + "p q r " * 10 + "y", "en", "s", 1), (31, "p  q\n" * 6, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as runs", "'y' as start", "'z' as n_words")
    got = sorted((tuple(r) for r in runs.digests(runs.detect(df)).drop("n_words").collect()), key=key)
    small = sorted([expected(r[0], r[1]) for r in rows if r[0] not in (30, 4)], key=key)
    assert [g for g in got if g[0] not in (30, 4)] == small
    assert next(g for g in got if g[0] == 30)[1:6] == (1, 0, 50_000, 1, 50_000_000)
    assert next(g for g in got if g[0] == 4)[1] == 0 and len(LONG.split()) == 40_000
    out = {r["collapsed"] for r in runs.detect(df).where("doc_id = 31").collect()}
    assert out == {"x p q r y", "p q"}
    assert runs.digests(runs.detect(edge(spark).where("false"))).count() == 0
