"""What tables of users hold beside the test data: ids that repeat, many sources, clashing names, null ids."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import ROWS, SCHEMA, edge, prose
from conftest import SF_SMALL
from tokloom.llm import common, decontaminate, exact_dedup, jaccard, mixing, quality, queries, sharding, toxicity

CLASH = ["_row", "row", "_k1", "_k2", "_hits", "_times", "_gaps", "_said", "c0", "c1", "key", "tie", "times", "last", "text_", "rule"]


def clashing(spark, rows=None):
    df = spark.createDataFrame(rows or [(1, "a b c d e f g h", "en", "s", 1), (2, prose(40, 1), "en", "s", 1),
                                        (3, prose(40, 1), "en", None, 1), (None, "x", None, "s", 1)], SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return df


# --- 2: mixing -----------------------------------------------------------------------------

def repeated(spark):
    r = random.Random(7)
    rows = [(i % 22, prose(r.randint(1, 90), i), "en", f"s{i % 4}", i) for i in range(220)]
    return spark.createDataFrame(rows + rows[:5], SCHEMA)


def test_reruns_agree_when_ids_repeat(spark):
    docs = repeated(spark)
    cols = ["doc_id", "source", "size", "target", "taken", "first_slot"]
    got = [Counter(map(tuple, mixing.taken(docs.repartition(n), block_words=64).select(*cols).collect())) for n in (1, 5, 9)]
    assert got[0] == got[1] == got[2]
    mixed = [Counter(map(tuple, mixing.mixture(docs.repartition(n), block_words=64).collect())) for n in (1, 6)]
    assert mixed[0] == mixed[1] and sum(mixed[0].values()) > 100


def test_every_slot_is_one_sources(spark):
    for blocks in ([170] * 6, [1] * 300 + [0, 9]):
        rows = mixing.schedule(spark, blocks, [b / sum(blocks) for b in blocks]).collect()
        assert len({r["slot"] for r in rows}) == len(rows) == sum(blocks)
        assert Counter(r["src"] for r in rows) == {i: b for i, b in enumerate(blocks) if b}
        assert len({(r["src"], r["block"]) for r in rows}) == len(rows)


def test_sources_are_planned_as_a_table(spark):
    r = random.Random(1)
    for sizes in ([10, 500, 500], [0, 0], [r.randint(0, 10 ** r.randint(0, 6)) for _ in range(300)]):
        w = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
        got = mixing.planned(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "src long, size long"), (5.0, 2.0, 1.0), 3)
        want = mixing.targets(sizes, w)
        rows = got.orderBy("src").collect()
        assert [x["target"] for x in rows] == pytest.approx(want)
        assert [x["quota"] for x in rows] == [min(round(t), 3 * s) for t, s in zip(want, sizes)]
    assert mixing.planned(spark.createDataFrame([], "src long, size long"), (5.0, 2.0, 1.0), 3).count() == 0


def test_targets_by_definition():
    """The rule of the contract, step by step."""
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.randint(0, 10 ** r.randint(1, 5)) for _ in range(r.randint(1, 12))]
        w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        want, free = [0.0] * len(sizes), set(range(len(sizes)))
        while free:
            rest = sum(sizes) - sum(want[i] for i in range(len(sizes)) if i not in free)
            share = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
            over = {i for i in free if share[i] > 3 * sizes[i]}
            for i in over or free:
                want[i] = 3.0 * sizes[i] if over else share[i]
            free = free - over if over else set()
        assert mixing.targets(sizes, w) == pytest.approx(want)


def test_a_hundred_thousand_sources(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                       F.concat(F.lit("https://host/"), "id").alias("source"))
    got = mixing.taken(docs, block_words=2).agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("t"), F.sum("target").alias("w"),
                                                 F.max("taken").alias("most")).first()
    assert got["n"] == 100_000 and got["w"] == pytest.approx(300_000) and abs(got["t"] - 300_000) < 100_000 and got["most"] <= 9


# --- clashing names ------------------------------------------------------------------------

def test_no_column_name_clashes(spark):
    docs = clashing(spark)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2]
    for mode, n in (("document", 3), ("span", 4)):
        out = decontaminate.clean(docs, bench, mode)
        assert out.columns == docs.columns and out.count() == n
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    for df in (kept, decontaminate.clean(docs, bench, "span"), mixed):
        for r in df.collect():
            assert all(r[c] == f"{c}-{'null' if r['doc_id'] is None else r['doc_id']}" for c in CLASH)


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op4_context_mixing", "op5_quality", "op7_language", "op9_toxicity", "op11_quality_rules"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).select("doc_id", "held_out").collect()
        assert len(rows) == len(ROWS) and all(r["held_out"] is False for r in rows if r["doc_id"] is None)


# --- 1: units ------------------------------------------------------------------------------

def test_chunks_are_told_by_16_bits(spark):
    for chunk in (0, 1 << 15):
        with pytest.raises(ValueError):
            jaccard.join(spark.createDataFrame(ROWS, SCHEMA), chunk=chunk)


def test_units_are_cut_by_bytes(spark, monkeypatch):
    base = prose(300, 1).split()
    rows = [(i, " ".join(base[:150] + [f"w{i}"] + base[151:]), "en", "s", 1) for i in range(24)]
    docs = spark.createDataFrame(rows + [(100, prose(80, 3), "en", "s", 1)], SCHEMA)
    cols = ["doc_id", "class_id", "copy_id", "n_links", "kept"]
    want = sorted(map(tuple, jaccard.join(docs)[1].select(*cols).collect()))
    monkeypatch.setattr(jaccard, "UNIT_BYTES", 3000)
    assert sorted(map(tuple, jaccard.join(docs)[1].select(*cols).collect())) == want
    assert [r[3] for r in want if r[0] < 24] == [23] * 24


# --- 6: hot texts --------------------------------------------------------------------------

def test_hot_texts_are_combined_in_steps(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CROWDED", 6)
    monkeypatch.setattr(exact_dedup, "IDS_PER_ROW", 3)
    rows = [(i, "hot text" if i % 3 else f"text {i % 40}", "en", "s", 1) for i in range(600)] + [(None, "hot text", "en", "s", 1)] * 5
    got = exact_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t, []).append(d)
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == sorted(
        ((d is None, d, max(x for x in who if x is not None), len(who)) for who in groups.values() for d in who), key=str)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == {r["text_sha256"]: 1 for r in got}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


# --- 9: the grammar by recursion -----------------------------------------------------------

LISTS = {k: set(v.split()) for k, v in (("target", toxicity.TARGETS), ("neg", toxicity.NEGATIONS), ("rep", toxicity.REPORTS),
                                        ("aff", toxicity.AFFIRMING), ("threat", toxicity.threat_words()), ("insult", toxicity.SEED_INSULTS))}


def brute_weight(text):
    """Each clause word by word: what stands before and after a match decides its factors."""
    total = 0.0
    for clause in re.split(r"[.!?;\n\r]", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
        words = [(m.group(), m.start()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause)]
        tags = []
        for i, (w, at) in enumerate(words):
            then = words[i + 1][0] if i + 1 < len(words) else ""
            if w in LISTS["insult"]:
                tags.append("insult")
            elif (w == "t" and clause[max(0, at - 2):at] == "n'") or (len(w) > 3 and w.endswith("n’t")):
                tags.append("neg")
            elif w in LISTS["neg"] and then in LISTS["aff"]:
                tags.append("")
            else:
                tags.append(next((k for k in ("threat", "target", "neg", "rep") if w in LISTS[k]), ""))
        for i, t in enumerate(tags):
            if t not in ("insult", "threat"):
                continue
            f = 1.0
            if "neg" in tags[max(0, i - 3):i]:
                f *= toxicity.NEGATED
            if "rep" in tags[:i]:
                f *= toxicity.REPORTED
            before, after = "target" in tags[max(0, i - 3):i], "target" in tags[i + 1:i + 4]
            if t == "insult":
                total += 3.0 * f * (toxicity.TARGETED if before else 1.0)
            elif before or after:
                total += toxicity.THREATENED * f
    return total


def weights(texts):
    seeds = np.sort(toxicity._hashes(toxicity.SEED_INSULTS))
    return toxicity.Model({0: (seeds, np.full(len(seeds), 3.0))}).evidence_of(pa.array(texts))


def test_phrases_weigh_as_they_should():
    full = toxicity.THREATENED
    want = {
        "t'es un connard": 3.0, "es un connard": 3.0, "vitamin t idiot": 3.0, "no doubt an idiot": 3.0, "nicht nur ein idiot": 3.0,
        "not an idiot": 3.0 * toxicity.NEGATED, "he isn't an idiot": 3.0 * toxicity.NEGATED, "you aren't idiot": 3.0 * toxicity.NEGATED * toxicity.TARGETED,
        "that isn’t an idiot": 3.0 * toxicity.NEGATED, "you are killing them": full, "kills you": full, "i'll beat you": full,
        "i didn't beat them": full * toxicity.NEGATED, "we kill time": 0.0, "nous vous tuerons": full, "ich werde euch töten": full,
    }
    assert weights(list(want)) == pytest.approx(list(want.values()))


def test_grammar_equals_recursion():
    r = random.Random(5)
    pool = ("you them dich not never no doubt only isn't don’t said sagte kill killing beats töten matará idiot moron scum t n a the of "
            "one two three . ; ! \n").split(" ")
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    got = weights(texts)
    for t, g in zip(texts, got.tolist()):
        assert g == pytest.approx(brute_weight(t)), t
    assert (got > 0).mean() > 0.3


# --- 5 and 10 against brute force ----------------------------------------------------------

def test_quality_fit_equals_numpy(spark):
    """Moments, shrinkage and posterior of the labelled training rows, computed in one piece."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    measured = quality.measure(docs)
    model = quality.fit(measured, labels)
    rows = measured.where(common.fold("doc_id", 5) != 0).join(labels, "doc_id").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = ((y == 0).sum() * cov[0] + (y == 1).sum() * cov[1]) / len(y)
    whole = np.array([r["x"] for r in measured.collect()])
    dens = []
    for k in (0, 1):
        s = 0.8 * cov[k] + 0.2 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))
        d = whole - x[y == k].mean(0)
        dens.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(1))
    assert model.score(whole) == pytest.approx(1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500))), abs=1e-6)


def test_documents_lie_in_the_order_of_the_curve(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for law in ("rows", "bytes"):
        rows = sorted(sharding.place(docs, law=law).collect(), key=lambda r: (r["shard"], r["slot"]))
        assert [r["curve"] for r in rows] == sorted(r["curve"] for r in rows)
        if law == "rows":
            n = len(rows)
            assert [r["shard"] for r in rows] == [i * 8 // n for i in range(n)] or Counter(r["shard"] for r in rows) == Counter(
                s for s in range(8) for _ in range(n // 8 + (s < n % 8)))


def test_scores_of_the_language_model_do_not_depend_on_partitions(spark, tmp_path):
    from tokloom.llm import lm
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).select("doc_id", "text")
    docs.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/a/documents.parquet")
    docs.repartition(7).write.mode("overwrite").parquet(f"{tmp_path}/b/documents.parquet")
    a, b = ({r["doc_id"]: r["score"] for r in lm.op4_context_mixing(spark, f"{tmp_path}/{x}").collect()} for x in "ab")
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
