"""Bulk encoding through the dictionary, and the token store that is read by position."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tokloom.operators import encode
from tokloom.operators.bpe import train_bpe
from tokloom.operators.encode import _merge_word, decoded, encode_texts, encode_udf
from tokloom.operators.pieces import piece_counts
from tokloom.operators.windows import sample_windows
from tokloom.functions.text import pieces
from tokloom.sources.tokenstore import TokenStore, write_store

SIZES = [257, 280, 340, 400]
TEXTS = ["one two three two one", "", None, "ä😀 漢字 x", " \n\n spaces  and\ttabs ", "two " * 300, "unseen wörds only here"]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "k long, t string")
    return docs, train_bpe(piece_counts(docs, "t"), SIZES[-1])


def one_by_one(spark, docs, merges):
    """Every piece of every text by the sequential segmentation, per vocabulary."""
    out = {}
    for r in docs.select("k", pieces("t").alias("p")).collect():
        for v in SIZES:
            ranks = {(a, b): (k, n) for k, a, b, n, _ in merges[:v - 257]}
            out[r["k"], v] = [i for p in r["p"] or [] for i in _merge_word([x + 1 for x in p.encode()], ranks)]
    return out


@pytest.mark.parametrize("limit", [0, 60, 8 << 20])
def test_the_dictionary_changes_nothing(spark, trained, monkeypatch, limit):
    docs, res = trained
    monkeypatch.setattr(encode.dictionary, "__defaults__", (limit,))
    monkeypatch.setattr(encode, "CACHED_PIECES", 3)
    known = encode.dictionary(res.types, encode.rank_tables(res.merge_list, SIZES), limit)
    assert (len(known.pieces) == 0) == (limit == 0) and sum(len(p.encode()) + 4 for p in known.pieces.to_pylist()) <= limit
    got = encode_texts(docs.repartition(2), "t", ["k"], res.merge_list, SIZES, types=res.types).collect()
    assert {(r["k"], r["vocab"]): r["ids"] for r in got} == one_by_one(spark, docs, res.merge_list)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_the_udf_gives_the_same_ids(spark, trained):
    docs, res = trained
    enc = encode_udf(spark, res.merge_list, SIZES)
    got = docs.select("k", enc(pieces("t")).alias("e")).collect()
    assert {(r["k"], v): r["e"][i] for r in got for i, v in enumerate(SIZES)} == one_by_one(spark, docs, res.merge_list)


@pytest.fixture(scope="module")
def store(spark, trained, tmp_path_factory):
    _, res = trained
    r, rows, at = random.Random(3), [], 0
    for i in range(200):
        doc = " ".join(r.choice(["one", "two", "three", "ä", "unseen"]) for _ in range(r.choice([1, 2, 40])))
        rows.append((i % 7, "train" if i < 170 else "val", at, len(doc.encode()), len(doc), 1, doc))
        at += len(doc.encode())
    corpus = spark.createDataFrame(rows, "doc_id long, split string, start_byte long, n_bytes long, n_doc_chars long, n_words int, doc string")
    path = str(tmp_path_factory.mktemp("store") / "s")
    write_store(corpus.repartition(5), path, res.merge_list, [280, 400], res.types, parts=9)
    ids = {v: [x["ids"] for x in encode_texts(corpus, "doc", ["start_byte"], res.merges_for(v)).orderBy("start_byte").collect()]
           for v in (280, 400)}
    return TokenStore(spark, path), ids


def test_derived_columns_are_found_for_the_ordered_rows(spark, trained, tmp_path):
    _, res = trained
    rows = [(i, "train", 10 * i, 5, "one two" if i % 2 else "three") for i in range(20)]
    corpus = spark.createDataFrame(rows, "doc_id long, split string, start_byte long, n_bytes long, doc string")
    derived = {"n_doc_chars": F.length("doc").cast("bigint"), "n_words": F.size(F.split("doc", " "))}
    write_store(corpus, str(tmp_path / "s"), res.merge_list, [280], res.types, parts=3, derived=derived)
    got = TokenStore(spark, str(tmp_path / "s")).tokens().orderBy("start_byte").collect()
    assert [(r["doc_id"], r["n_words"], r["n_doc_chars"]) for r in got] == [(i, 1 + i % 2, 7 if i % 2 else 5) for i in range(20)]


def test_positions_follow_the_corpus(store):
    s, ids = store
    for v in (280, 400):
        rows = s.tokens(v).orderBy("start_byte").collect()
        assert [r["ids"] for r in rows] == ids[v]
        at = 0
        for r in rows:
            assert r["start_pos"] == at
            at += r["n_tokens"]
        m = s.manifest.where(F.col("vocab") == v).orderBy("part", "lo").collect()
        assert sum(r["n_tokens"] for r in m) == at and m[0]["lo"] == 0 and all(a["hi"] == b["lo"] for a, b in zip(m, m[1:]))
        assert len({r["part"] for r in m}) == 9
    assert s.tokens(400, "val").count() == 30 and s.tokens(400, "val").agg(F.min("start_pos")).first()[0] == s.span(400, "val")[0]


@pytest.mark.parametrize("split", ["train", "val"])
def test_windows_read_the_parts_they_touch(spark, store, split):
    s, ids = store
    flat = [i for x in ids[400] for i in x]
    got = s.windows(400, split, 2, 3, 16, chunk=8)
    for r in got.collect():
        assert r["x"] == flat[r["start_pos"]:r["start_pos"] + 16] and r["y"] == flat[r["start_pos"] + 1:r["start_pos"] + 17]
    whole = sample_windows(s.tokens(400, split), 2, 3, 16, chunk=8)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    ranges = spark.createDataFrame([(5, 9), (40, 40)], "first long, last long")
    m = s.manifest.where("vocab = 400 and split = 'train'").collect()
    held = {r["part"] for r in s.holding(400, "train", ranges).collect()}
    assert held == {r["part"] for r in m if any(a < r["hi"] and b >= r["lo"] for a, b in ((5, 9), (40, 40)))}
    part = s.tokens(400, "train", s.holding(400, "train", ranges))
    files = {os.path.dirname(f) for f in part.inputFiles() if "/tokens/" in f}
    assert len(files) == len(held) < 9 and all(f"part={p}" in "".join(files) for p in held)
    assert s.tokens(400, "train", s.holding(400, "train", ranges.where("false"))).count() == 0


def test_windows_query_reads_no_sums(spark):
    q = E.queries()
    q["train_windows"](spark, SF_SMALL)
    plan = q["train_windows"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Window" not in plan.replace("windowspec", "") and "paths)" in plan


def test_study_at_the_reference_sizes(spark):
    from tokloom.plans.tokenizer_plans import STUDY_VOCABS, learned, prepared
    q = E.queries()
    merges = q["bpe_merges_full"](spark, SF_SMALL).collect()
    assert [r["rank"] for r in merges] == list(range(len(merges))) and 4096 < len(merges) <= STUDY_VOCABS[-1] - 257
    assert all(a["pair_count"] >= b["pair_count"] >= 2 for a, b in zip(merges, merges[1:]))
    assert [tuple(r) for r in q["bpe_merges"](spark, SF_SMALL).collect()] == learned(spark, SF_SMALL, STUDY_VOCABS[-1])[:256]
    docs = q["encode_docs_full"](spark, SF_SMALL).collect()
    text = {r["start_byte"]: r["h"] for r in prepared(spark, SF_SMALL).select("start_byte", F.md5(F.concat(F.lit(" "), "doc")).alias("h")).collect()}
    assert len(docs) == 4 * len(text) and all(r["text_md5"] == text[r["start_byte"]] for r in docs)
    study = {r["vocab"]: r for r in q["vocab_study_full"](spark, SF_SMALL).collect()}
    assert sorted(study) == STUDY_VOCABS and sorted(r["bits_rank"] for r in study.values()) == [1, 2, 3, 4]
    assert all(study[a]["fertility"] >= study[b]["fertility"] for a, b in zip(STUDY_VOCABS, STUDY_VOCABS[1:]))
