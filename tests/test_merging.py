"""Merges on arrays, and what a task holds at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tokloom.operators import encode, pieces as P
from tokloom.operators.encode import Encoder, Table, _merge_word
from tokloom.operators.merging import MergeTable, merged, of_bytes, parsed, written
from tokloom.sources import corpustext as CT


@pytest.mark.parametrize("seed", range(20))
def test_all_pieces_at_once_as_one_by_one(seed):
    r = random.Random(seed)
    ranks, ids = {}, [1, 2, 3]
    while len(ranks) < 12:
        pair = r.choice(ids), r.choice(ids)
        if pair not in ranks:
            ranks[pair] = (len(ranks) * 3, 257 + len(ranks))
            ids.append(256 + len(ranks))
    words = [[r.randint(1, 3) for _ in range(r.choice([1, 1, 2, 5, 40]))] for _ in range(60)]
    size = np.array([len(w) for w in words])
    sym, n = merged(np.array(sum(words, [])), size, MergeTable(ranks))
    want = [_merge_word(w, ranks) for w in words]
    assert sym.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    y = written(sym, n)
    assert y.to_pylist() == ["|" + "||".join(map(str, w)) + "|" for w in want]
    assert [x.tolist() for x in parsed(y)] == [sum(want, []), n.tolist()]


def test_nothing_to_merge():
    none = MergeTable({})
    assert [x.tolist() for x in merged(np.array([1, 2]), np.array([2]), none)] == [[1, 2], [2]]
    some = MergeTable({(1, 2): (0, 257)})
    assert [x.tolist() for x in merged(np.zeros(0, np.int32), np.zeros(0), some)] == [[], []]
    assert [x.tolist() for x in of_bytes(pa.array(["aä", "b"][:2]).slice(1))] == [[99], [1]]
    assert [x.tolist() for x in of_bytes(pa.array([], pa.string()))] == [[], []]


def test_a_task_holds_a_bounded_number_of_pieces(monkeypatch):
    """A batch of any number of pieces is looked up and gathered in bounded parts."""
    monkeypatch.setattr(encode, "CACHED_PIECES", 50)
    monkeypatch.setattr(encode, "GATHERED_PIECES", 7)
    held = []

    class Watched(Encoder):
        def _places(self, some):
            held.append(len(some))
            return super()._places(some)

        def _gather(self, at, rest, k):
            assert len(at) <= 7
            return super()._gather(at, rest, k)

    ranks = {(98, 99): (0, 257), (257, 257): (1, 258)}
    words = [random.Random(i).choice(["ab", "abab", "c", "abc", "xabx"]) for i in range(333)]
    known = Table(pa.array(["ab", "c"]), encode.segmented(pa.array(["ab", "c"]), [MergeTable(ranks)]))
    (ids, start), = Watched([MergeTable(ranks)], known)(pa.array(words))
    assert max(held) == 50 and sum(held) == 333
    assert [ids[a:z].tolist() for a, z in zip(start, start[1:])] == [_merge_word([b + 1 for b in w.encode()], ranks) for w in words]
    cut = np.array([0, 10, 10, 200, 230, 240, 300])
    assert list(encode._runs_of_rows(cut, 50)) == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_pairs_are_summed_before_they_are_shuffled(spark):
    types = spark.createDataFrame([("|1||2||1||2|", i) for i in range(1, 401)] + [("|9|", 5)], "y string, cnt long").coalesce(1)
    rows = P.pair_rows(types)
    assert rows.count() == 2
    assert {(r["left"], r["right"]): r["cnt"] for r in rows.collect()} == {(1, 2): 2 * 80200, (2, 1): 80200}


def test_partitions_grow_with_bytes_not_with_chunks(tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(4000))
    (tmp_path / "a.txt").write_text(text)
    one_each = CT.CorpusTextReader(str(tmp_path), 64)
    monkeypatch.setattr(CT, "FEW_PARTS", 1 << 30)
    rows = [x for p in one_each.partitions() for x in one_each.read(p)]
    assert len(one_each.partitions()) == -(-len(text) // 64)
    monkeypatch.setattr(CT, "FEW_PARTS", 10)
    assert len(one_each.partitions()) <= 11
    assert [x for p in one_each.partitions() for x in one_each.read(p)] == rows
    monkeypatch.undo()
    big = CT.CorpusTextReader(str(tmp_path), 1 << 16)
    big.files = [("a", 6 << 30)]
    spans = big.partitions()
    assert len(spans) <= 1000 and spans[-1].last == 6 << 30 and max(s.last - s.first for s in spans) <= CT.PART_BYTES
