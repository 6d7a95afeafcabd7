"""Neighbouring ids counted as arrays, and the loss of the count model."""

import math
import random
from collections import Counter

import pytest

from tokloom.operators import study as ST

SCHEMA = "vocab int, split string, ids array<int>"


def made(seed, n=120):
    r = random.Random(seed)
    return [(v, r.choice(["train", "train", "val"]), [r.choice([0, 1, 7, 300, 65535]) for _ in range(r.choice([0, 1, 2, 30]))])
            for v in (300, 400) for _ in range(n)] + [(300, "train", None), (500, "val", [3])]


def counted(rows):
    out = Counter()
    for v, s, ids in rows:
        out.update((v, s, a, b) for a, b in zip([None, *(ids or [])], ids or []))
    return out


@pytest.fixture(params=["whole", "in parts"])
def bounds(request, monkeypatch):
    if request.param == "in parts":
        for name, n in (("COUNTED_PAIRS", 7), ("HELD_SUMS", 9), ("SUM_ROWS", 4)):
            monkeypatch.setattr(ST, name, n)


def test_every_neighbour_is_counted(spark, bounds):
    rows = made(1)
    t = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["vocab"], r["split"], r["prv"], r["nxt"]): r["c"] for r in ST.neighbour_counts(t).collect()}
    assert got == counted(rows)


def test_a_task_gives_sums_and_no_row_per_id(spark):
    t = spark.createDataFrame([(300, "train", [1, 2] * 500)] * 40, SCHEMA).coalesce(1)
    assert ST._neighbour_rows(t, None).count() == 3
    assert "explode" not in ST.neighbour_counts(t)._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_what_is_not_asked_is_counted_by_its_ids(spark, bounds, monkeypatch, bits):
    monkeypatch.setattr(ST, "ASKED_BITS", bits)
    rows = made(2)
    want = counted(rows)
    pairs = [(300, 1, 7), (300, 0, 65535), (400, 7, 1)]
    asked = ST.asked_pairs(spark.createDataFrame(pairs, "vocab int, prv int, nxt int"))
    got = ST.neighbour_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), asked).collect()
    by_pair = {(r["vocab"], r["split"], r["prv"], r["nxt"]): r["c"] for r in got}
    assert all(by_pair.get((v, s, a, b), 0) == want[v, s, a, b] for v, a, b in pairs for s in ("train", "val"))
    for k in (2, 3):
        sums, whole = Counter(), Counter()
        for key, c in by_pair.items():
            sums[key[0], key[1], key[k]] += c if key[k] is not None else 0
        for key, c in want.items():
            whole[key[0], key[1], key[k]] += c if key[k] is not None else 0
        assert +sums == +whole


def test_loss_as_by_hand(spark, bounds):
    rows = made(3)
    want = counted(rows)
    got = {r["vocab"]: r for r in ST.ngram_loss(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert sorted(got) == [300, 400]                    # 500 has no training ids
    for v, r in got.items():
        uni = {s: Counter() for s in ("train", "val")}
        ctx = Counter()
        for (u, s, a, b), c in want.items():
            if u == v:
                uni[s][b] += c
                if s == "train" and a is not None:
                    ctx[a] += c
        n = sum(uni["val"].values())
        total = sum(uni["train"].values()) + v
        assert r["n_val"] == n
        assert r["unigram_loss"] == pytest.approx(sum(-c * math.log((uni["train"][i] + 1) / total) for i, c in uni["val"].items()) / n)
        bi = {(a, b): c for (u, s, a, b), c in want.items() if u == v and s == "val" and a is not None}
        assert r["bigram_loss"] == pytest.approx(
            sum(-c * math.log((want[v, "train", a, b] + 1) / (ctx[a] + v)) for (a, b), c in bi.items()) / sum(bi.values()))
