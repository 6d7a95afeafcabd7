"""Operators that learn or compare: 1, 4, 5, 7, 9, and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import LONG, ROWS, edge, empty, prose
from conftest import SF_MID, SF_SMALL
from tokloom.llm import common, decontaminate, jaccard, langid, lm, quality, queries, sharding, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALL_IDS = sorted((r[0] is None, r[0]) for r in ROWS)


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)


def fold(d, k):
    return zlib.crc32(str(d).encode()) % k


# --- 1: Jaccard join -----------------------------------------------------------------------

def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(texts):
    """Links per row and the least row of each component, rows numbered as given."""
    sets, n = [shingle_set(t) for t in texts], [0] * len(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return n, [find(i) for i in range(len(texts))]


def near_copies(n, words, seed):
    base = prose(words, seed).split()
    out = []
    for i in range(n):
        w = list(base)
        w[(7 * i) % words] = f"edit{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [1024, 4])
def test_join_equals_brute_force(spark, chunk):
    texts = (near_copies(30, 120, 5) + near_copies(6, 60, 6) + [prose(80, 100 + i) for i in range(40)] + [prose(80, 100)] * 5
             + ["a b c", "A, b. c!", "a b", "", None, "..."])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in jaccard.join(df, chunk=chunk)[1].collect()}
    n, root = brute_links(texts)
    assert [got[i]["n_links"] for i in range(len(texts))] == n
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [i for i in range(len(texts)) if got[i]["kept"]] == sorted(set(root))
    assert got[76]["copy_id"] == 36


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    order = sorted(docs)
    n, root = brute_links([docs[d] for d in order])
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_jaccard_join"](spark, SF_SMALL).collect()}
    assert {d: got[d]["n_links"] for d in order} == dict(zip(order, n))
    assert {d: got[d]["class_id"] for d in order} == {d: order[r] for d, r in zip(order, root)}


def test_join_of_edge_rows(spark):
    got = jaccard.join(edge(spark))[1].collect()
    assert ids(got) == ALL_IDS
    copies = [r for r in got if r["class_id"] == 5]
    assert sorted(r["doc_id"] for r in copies) == [5, 5, 6] and [r["n_links"] for r in copies] == [2, 2, 2]
    assert sum(r["kept"] for r in copies) == 1
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert jaccard.join(empty(spark))[1].count() == 0
    kept = jaccard.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns and kept.count() == len(ROWS) - 2


def test_slices_of_few_words():
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def measured(*texts):
        n = range(len(texts))
        rows = [r for b in jaccard._measure(iter([pa.record_batch([pa.array(n), pa.array(n), pa.array(texts)], schema=schema)]))
                for r in b.to_pylist()]
        return [(r["words"], r["k1"], r["k2"], r["sig"]) for r in rows]

    few = ["one", "two words", "three small words", "these are four words"]
    together = measured(*few, "and here are more than five words")[:4]
    assert [r[0] for r in together] == [1, 2, 3, 4]
    for text, want in zip(few, together):
        assert measured(text) == [want]
        assert measured("word " * 400_000, text)[1] == want         # a slice of its own, after a long text


def test_bayesian_bound():
    least = jaccard.least_matches()
    # the posterior after n of n matches is near one, so a perfect run is never dropped
    assert all(least[n] <= n for n in range(1, jaccard.HASHES + 1))
    # and what is dropped has less than the tolerance, by direct integration of the posterior
    for n in (8, 40, 96):
        m = int(least[n]) - 1
        if m >= 0:
            x = np.linspace(0, 1, 200_001)
            d = x ** m * (1 - x) ** (n - m)
            assert d[x >= 0.8].sum() / d.sum() < 2 * jaccard.TOLERANCE


def test_shared_shingles_two_ways():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, 80)).astype(np.uint64) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    want = [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j)]
    assert jaccard._shared(sets, i, j).tolist() == want
    assert jaccard._shared(sets, i[:5], j[:5]).tolist() == want[:5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (150, 150), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["v"]: r["root"] for r in jaccard.components(df, "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100, 300: 300, 301: 300}


# --- 4: language model ---------------------------------------------------------------------

def brute_base(rows, held=1):
    toks = {}
    for i, (d, text, *_) in enumerate(rows):
        toks[i] = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]
    count = Counter(t for i, (d, *_) in enumerate(rows) if d is None or fold(d, 5) != held for t in toks[i])
    n, v = sum(count.values()), len(count)
    return [(d, len(toks[i]), sum(count[t] > 0 for t in toks[i]), n,
             sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks[i])) for i, (d, *_) in enumerate(rows)]


def test_counts_and_base_equal_brute_force(spark):
    for sf in (SF_SMALL,):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        got = {r["doc_id"]: r for r in queries.QUERIES["op4_context_mixing"](spark, sf).collect()}
        assert len(got) == len(rows)
        for d, n, known, total, base in brute_base(rows):
            r = got[d]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(d, 5) == 1, n, known, total)
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        held = [r for r in got.values() if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_of_edge_rows(spark):
    got = lm.score(edge(spark)).collect()
    assert ids(got) == ALL_IDS
    want = sorted(((d is None, d, n, k, t, round(b, 6)) for d, n, k, t, b in brute_base(ROWS)), key=str)
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                   for r in got), key=str) == want
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm.score(empty(spark)).count() == 0


def test_without_training_texts(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = lm.score(df, folds=1, held=0).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0)
    assert r["base_score"] == pytest.approx(0) and np.isfinite(r["score"])


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    a, b = ({r["doc_id"]: (r["base_score"], r["score"]) for r in lm.score(df.repartition(n)).collect()} for n in (1, 3))
    assert a.keys() == b.keys()
    for d in a:
        assert a[d][0] == pytest.approx(b[d][0], rel=1e-12) and a[d][1] == pytest.approx(b[d][1], rel=1e-6)


def test_code_and_spelling_sum_to_one():
    code = lm.huffman(np.random.default_rng(2).integers(0, 1000, 256))
    assert sum(2.0 ** -code.length) == pytest.approx(1)
    # probabilities of every one-letter word and of the empty rest, under random statistics
    r = np.random.default_rng(3)
    s = lm.Speller(code, r.integers(0, 5, lm.SLOTS).astype(np.float32), r.integers(0, 5, lm.SLOTS).astype(np.float32))
    words = ["", *"abc"]
    words += [a + b for a in "abc" for b in "abc"]
    p = 10 ** s.log10(pa.array(words))
    assert (p > 0).all() and p.sum() < 1
    b, _, place = lm.word_bytes(pa.array([chr(i) for i in range(128)]))
    first = np.zeros(128)
    for live, bit, slots in lm.bits(b, place, code):
        low = np.minimum(place, lm.PLACES - 1)[live]
        x, gate = s.known(slots, low)
        q = s.refined(s.mixed(x, gate), low)
        np.add.at(first, live[place[live] == 0] // 2, np.log2(np.where(bit == 1, q, 1 - q))[place[live] == 0])
    assert (2 ** first).sum() <= 1 + 1e-6


def test_mixing_inside_texts_equals_one_text_at_a_time():
    r = np.random.default_rng(4)
    length = np.array([5, 1, 40, 17])
    n = int(length.sum())
    p, after = r.uniform(1e-6, 1e-2, n), r.uniform(0, 0.3, n)
    gate, ctx = r.integers(0, lm.PAIR_GATES, n).astype(np.uint8), r.integers(0, 256, n).astype(np.uint8)
    seen = np.concatenate([np.minimum(np.arange(k), r.integers(0, 3, k)) for k in length])
    whole = lm.mix_text(p, after, gate, seen, ctx, length)
    at = np.append(0, np.cumsum(length))
    for i in range(4):
        s = slice(at[i], at[i + 1])
        assert lm.mix_text(p[s], after[s], gate[s], seen[s], ctx[s], length[i:i + 1])[0] == pytest.approx(whole[i], rel=1e-5)


def test_packed_numbers_return():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 32, 1000).astype(np.uint32)
    assert (lm.unpack(lm.pack(x)) == x).all() and len(lm.unpack(lm.pack(x[:0]))) == 0
    h = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_hashes(lm.pack_hashes(h)) == h).all()


def test_long_unseen_words_cost_their_whole_spelling():
    r = np.random.default_rng(6)
    zero, one = (r.integers(0, 5, lm.SLOTS).astype(np.float32) for _ in range(2))
    speller, totals = lm.Speller(lm.huffman(r.integers(0, 1000, 256)), zero, one), lm.Totals(1000, 100, 10, 0.5)
    words = pa.array(["".join(r.choice(list("abcxyz"), n)) for n in (60, 10_000, 200_000)])
    full = totals.log10(np.zeros(3, np.int64), speller.log10(words))
    assert full[1] < -1000 and full[2] < -20_000
    off, data = common.text_bytes(words)
    w = common.cut_words(off, data, 0, 3, common.NOT_SPACE)
    o = np.argsort(w.hash)
    cell = lm.zstandard.ZstdCompressor().compress("\n".join(words.take(pa.array(o)).to_pylist()).encode())
    n, own = lm.pack_long(np.zeros(3)), lm.pack(np.zeros(3))
    ask = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([-1, 0]), pa.array([cell] * 2), pa.array([n, own])],
                                     ["bucket", "block", "words", "n"])
    table = lm.BlockTable()
    for b in lm._answer_words(speller, totals)(iter([ask])):
        for x in b.to_pylist():
            table.add(0, x["bucket"], x["keys"], x["n"], x["lp"])
    table.close()
    texts = pa.array([*words.to_pylist(), f"{words[2]} {words[2]}"])
    docs = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([True] * 4), texts], ["doc_id", "held_out", "text"])
    got = np.asarray(lm._mixed([lm._look_up(docs, table, totals, 1)]).column("score"))
    assert got[:3] == pytest.approx(full + totals.end(), abs=3)
    assert got[3] == pytest.approx(full[2] + totals.end(), abs=5)     # said again, it is the text's own word


def test_counts_beyond_32_bits():
    big = 3_000_000_000
    cell = lm.zstandard.ZstdCompressor().compress(b"the")
    rows = pa.RecordBatch.from_pydict({"bucket": [0, 0], "words": [cell] * 2, "n": [lm.pack(np.array([big]))] * 2})
    r = next(lm._merge_words(iter([rows]))).to_pylist()[0]
    assert lm.unpack_long(r["n"]).tolist() == [r["tokens"]] == [2 * big]
    pairs = pa.RecordBatch.from_pydict({"bucket": [0, 0], "block": [1, 2], "keys": [lm.pack(np.array([7]))] * 2,
                                        "n": [lm.pack(np.array([big]))] * 2, "held": [lm.pack(np.array([0]))] * 2})
    table = lm.BlockTable()
    x = next(lm._count_pairs(iter([pairs]))).to_pylist()[0]
    table.add(1, x["bucket"], x["keys"], x["n"], None)
    table.close()
    assert table.pair(np.array([7], np.uint64)).tolist() == [2 * big]


# --- 5: quality ----------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rows = queries.QUERIES["op5_quality"](spark, SF_MID).join(
        spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_densities_equal_the_formula():
    r = np.random.default_rng(6)
    d = len(quality.STATISTICS)
    mean, factor, const = [], [], []
    for k in range(2):
        a = r.normal(size=(d, d))
        s = a @ a.T + np.eye(d)
        mean.append(r.normal(size=d))
        factor.append(np.linalg.cholesky(s))
        const.append(float(np.log((0.3, 0.7)[k]) - np.log(np.diag(factor[k])).sum()))
    x = r.normal(size=(50, d))
    dens = [np.log((0.3, 0.7)[k]) - 0.5 * np.linalg.slogdet(factor[k] @ factor[k].T)[1]
            - 0.5 * np.einsum("ni,ij,nj->n", x - mean[k], np.linalg.inv(factor[k] @ factor[k].T), x - mean[k]) for k in (0, 1)]
    assert quality.Model(const, mean, factor).score(x) == pytest.approx(1 / (1 + np.exp(dens[0] - dens[1])))


@pytest.mark.parametrize("cls", [quality, toxicity])
def test_scores_of_edge_rows(spark, cls):
    some = [(1, 1), (2, 0), (4, 1), (5, 1), (5, None), (6, 0), (7, 1), (8, 0), (9, 0), (10, 1), (None, 1), (3, 7), (99, 1)]
    labels = spark.createDataFrame(some, "doc_id long, y int")
    train = (lambda d, x: quality.fit(quality.measure(d), x)) if cls is quality else toxicity.fit
    for given in (labels, labels.where("y = 1"), labels.where("false")):
        got = cls.score(edge(spark), train(edge(spark), given)).collect()
        assert ids(got) == ALL_IDS and all(0 <= r["score"] <= 1 for r in got)
    model = train(empty(spark), labels)
    assert cls.score(empty(spark), model, "out").count() == 0
    out = cls.score(edge(spark), model, "out")
    assert out.columns == [*edge(spark).columns, "out"]


def test_statistics_do_not_depend_on_neighbours():
    texts = [t for _, t, *_ in ROWS if t != LONG]
    whole = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert quality.statistics(pa.array([t], pa.string()))[0] == pytest.approx(whole[i])


# --- 7: language ---------------------------------------------------------------------------

def test_languages_on_held_out_rows(spark):
    rows = queries.QUERIES["op7_language"](spark, SF_MID).join(
        spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_words(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = langid.fit(docs)
    pick = {r["lang"]: r["text"] for r in docs.where("length(text) > 500 and length(text) < 3000").collect()}
    a, b = (pick[x].translate(LOWER).split()[:40] for x in ("de", "en"))
    off, data = common.text_bytes(pa.array([" ".join(a + b)]))
    q = model.words(common.cut_words(off, data, 0, 1, langid.LETTERS)).argmax(1)
    half = len(q) // 2
    assert np.mean(q[:half - 5] == model.languages.index("de")) > 0.9
    assert np.mean(q[half + 5:] == model.languages.index("en")) > 0.9


def test_posteriors_equal_enumeration():
    r = np.random.default_rng(7)
    k, length = 3, np.array([4, 1, 3])
    e, trans = r.normal(size=(8, k)), r.normal(size=(k, k))
    got, at = langid.forward_backward(e, length, trans), 0
    for n in length:
        want = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            s = sum(e[at + i, y] for i, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:]))
            for i, y in enumerate(path):
                want[i, y] += np.exp(s)
        assert got[at:at + n] == pytest.approx(want / want.sum(1, keepdims=True))
        at += n


def test_language_of_edge_rows(spark):
    model = langid.fit(edge(spark))
    got = langid.predict(edge(spark), model).collect()
    assert ids(got) == ALL_IDS
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(by[d] == ("und", 0.0) for d in (1, 2, 3, 9)) and by[10][0] != "und" and by[4][0] != "und"
    assert langid.fit(empty(spark)).languages == []
    assert {r["lang_pred"] for r in langid.predict(edge(spark), langid.fit(empty(spark))).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0
    only = spark.createDataFrame([(2, "\U0001f600 — …", "en")], "doc_id long, text string, lang string")
    assert langid.predict(only, model).first()["lang_pred"] == "und"


# --- 9: toxicity ---------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    rows = queries.QUERIES["op9_toxicity"](spark, SF_MID).join(
        spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_clauses_are_weighed():
    model = toxicity.Model({0: (np.sort(toxicity._hashes(toxicity.SEED_INSULTS)), np.full(len(toxicity.SEED_INSULTS.split()), 3.0))})

    def weight(text):
        return float(model.evidence_of(pa.array([text]))[0])

    plain = weight("what an idiot")
    assert weight("a fine day, friend") == 0 and plain == pytest.approx(3.0)
    assert weight("you are an idiot") == pytest.approx(3.0 * toxicity.TARGETED)
    assert weight("this is not an idiot") == pytest.approx(3.0 * toxicity.NEGATED)
    assert weight("somebody said what an idiot") == pytest.approx(3.0 * toxicity.REPORTED)
    assert weight("that is not so. what an idiot") == pytest.approx(plain)      # scopes end with the clause
    assert weight("an idiot; a moron") == pytest.approx(2 * plain)
    # A threat counts with a target on either side, so the second clause weighs in full.
    assert weight("we kill time") == 0 and weight("i want you to die, i will kill you") == pytest.approx(toxicity.THREATENED)
    assert weight("you they will kill") > 0
    assert weight("idiots") == 0


def test_threats_count_with_a_target_on_either_side():
    model = toxicity.Model({0: (np.sort(toxicity._hashes(toxicity.SEED_INSULTS)), np.full(len(toxicity.SEED_INSULTS.split()), 3.0))})

    def weight(text):
        return float(model.evidence_of(pa.array([text]))[0])

    full = toxicity.THREATENED
    assert weight("i will kill you") == pytest.approx(full)
    assert weight("we are going to murder them") == pytest.approx(full)
    assert weight("you i will kill") == pytest.approx(full) and weight("you i will kill, you") == pytest.approx(full)
    assert weight("i will hurt and kill you") == pytest.approx(2 * full)
    assert weight("i will not kill you") == pytest.approx(full * toxicity.NEGATED)
    assert weight("john said i will kill you") == pytest.approx(full * toxicity.REPORTED)
    assert weight("you will not kill") == pytest.approx(full * toxicity.NEGATED)
    assert weight("we kill time") == 0
    assert weight("i kill a lot of time for you") == 0      # out of reach
    assert weight("i will kill. you") == 0                  # another clause


def test_composition_multiplies_scopes():
    state, total = toxicity.GRAMMAR.start, 1.0
    for tag in (toxicity.REPORT, toxicity.TARGET, toxicity.NEGATION, toxicity.INSULT):
        state, out, f = toxicity.GRAMMAR.arcs[state, tag]
        total *= f
    assert out == toxicity.INSULT and total == pytest.approx(toxicity.NEGATED * toxicity.REPORTED * toxicity.TARGETED)


# --- the pipeline --------------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark):
    docs = common.read(spark, SF_SMALL, "documents")
    cols, stages, out = docs.columns, dict(corpus_pipeline.STAGES), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, SF_SMALL), "test-pipeline")
        out.append(docs)
        if name != "sharding":
            assert docs.columns == cols
    good, single, clean, mixed, placed = out
    before = common.read(spark, SF_SMALL, "documents")
    model = quality.train(before, common.read(spark, SF_SMALL, "labels"))
    kept = {r["doc_id"] for r in quality.score(before, model, "q").where("q >= 0.3").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and 0 < len(kept) < before.count()
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    order = sorted(texts)
    _, root = brute_links([texts[d] for d in order])
    assert {r["doc_id"] for r in single.collect()} == {order[i] for i in set(root)}
    bench = common.read(spark, SF_SMALL, "benchmark")
    dirty = {r["doc_id"] for r in decontaminate.find(single, bench).where("n_hit > 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - dirty and dirty
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= {r["doc_id"] for r in clean.collect()} and max(times.values()) <= 3
    assert Counter(r["doc_id"] for r in placed.collect()) == times
    n = Counter(r["shard"] for r in placed.collect())
    assert sorted(n) == list(range(8)) and max(n.values()) - min(n.values()) <= 1
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_edge_rows(spark, tmp_path):
    for name, table in (("labels", spark.createDataFrame([(4, 1), (5, 1), (7, 1), (9, 0), (11, 0), (2, 0)], "doc_id long, quality int")),
                        ("benchmark", spark.createDataFrame([(1, "one")], "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (edge(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stage(stage(spark, docs, str(tmp_path)), "test-edge")
        assert docs.count() >= 0 and "shard" in docs.columns
