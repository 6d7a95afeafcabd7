"""The corpus as a stream of text read in bounded parts; the size cut-off that stops reading."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tokloom.functions.text import pieces
from tokloom.operators.bpe import train_bpe
from tokloom.operators.encode import encode_texts
from tokloom.operators.pieces import piece_counts
from tokloom.sources import corpustext as CT

ODD = ["Ein Wort  zwei\n\n\n drei", "ä ö  ü", "x" * 300, "漢字 漢字漢字 \U0001f600 \U0001f600", "don't  we'll\t\t'd", "\x1c \x1f a", " ", "\n \n", "é é é"]


def whole_pieces(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(pieces("t")).first()[0]


@pytest.mark.parametrize("chunk, block", [(1, 5), (7, 9), (64, 1 << 16), (1 << 20, 1 << 16)])
def test_parts_give_the_pieces_of_the_whole(spark, tmp_path, monkeypatch, chunk, block):
    monkeypatch.setattr(CT, "READ_BYTES", block)
    r = random.Random(chunk)
    text = "".join(r.choice(ODD) + r.choice([" ", "\n", "", "  "]) for _ in range(120))
    raw = text.encode()
    cuts = sorted(r.sample(range(1, len(raw)), 4))                    # files end anywhere, also inside a character
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(raw)])):
        (tmp_path / f"part-{i:05d}.txt").write_bytes(raw[a:b])
    (tmp_path / "_SUCCESS").write_text("")
    reader = CT.CorpusTextReader(str(tmp_path), chunk)
    parts = sorted(x for p in reader.partitions() for x in reader.read(p))
    assert "".join(t for _, t in parts) == text and [a for a, _ in parts] == sorted({a for a, _ in parts})
    got = []
    df = spark.createDataFrame(parts, "start_byte long, text string")
    for row in df.select("start_byte", F.when(F.col("start_byte") == 0, pieces("text")).otherwise(
            pieces("text", add_prefix_space=False)).alias("p")).orderBy("start_byte").collect():
        got += row["p"]
    assert got == whole_pieces(spark, text)
    if chunk <= 64:
        assert len(parts) > 20 and max(len(t) for _, t in parts) < 1000


def test_one_document_is_encoded_by_many_tasks(spark, tmp_path):
    r = random.Random(1)
    text = " ".join(r.choice(["Haus", "Hauptbahnhof", "der", "ä", "zwei\n"]) for _ in range(60_000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(text)
    parts = CT.read_text(spark, str(tmp_path / "in"), 1 << 14)
    assert parts.rdd.getNumPartitions() >= len(text.encode()) // (1 << 14)
    whole = spark.createDataFrame([(0, text)], "start_byte long, text string")
    res = train_bpe(piece_counts(whole, "text"), 300)
    first, rest = parts.where("start_byte = 0"), parts.where("start_byte > 0")
    ids = encode_texts(first, "text", ["start_byte"], res.merge_list).unionByName(
        encode_texts(rest, "text", ["start_byte"], res.merge_list, add_prefix_space=False))
    got = [i for row in ids.orderBy("start_byte").collect() for i in row["ids"]]
    assert got == encode_texts(whole, "text", ["start_byte"], res.merge_list).first()["ids"]


def test_empty_streams(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert CT.read_text(spark, str(tmp_path), 10).count() == 0
    (tmp_path / "b.txt").write_text("one")
    assert [tuple(r) for r in CT.read_text(spark, str(tmp_path), 1).collect()] == [(0, "one")]


def test_reading_stops_at_the_target(spark, tmp_path):
    from tokloom.operators.corpus import build_corpus, read_until
    from tokloom.sources.sinks import read_shard_folders, write_shards
    from tokloom.sources.tables import read_shards
    write_shards(read_shards(spark, SF_SMALL), str(tmp_path / "s"))
    asked = []

    def read(some):
        asked.append(list(some))
        return read_shard_folders(spark, str(tmp_path / "s"), some)

    whole = build_corpus(read_shards(spark, SF_SMALL), batch_rows=4)["batches"]
    total = whole.agg(F.sum("batch_bytes")).first()[0]
    cols = ["shard", "batch_id", "n_rows", "batch_bytes", "bytes_before"]
    for target in (1, total // 10, total // 2, 10 * total):
        asked.clear()
        got, done = read_until(read, list(range(20)), target, 4)
        want = whole.where(F.col("bytes_before") < target).select(*cols)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
        assert [s for g in asked for s in g] == done == list(range(len(done)))
        if target <= total // 10:
            assert len(done) <= 7
    with pytest.raises(ValueError):
        read_until(read, [], 5)
