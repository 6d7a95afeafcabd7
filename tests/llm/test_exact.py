"""Operators whose results can be told exactly: 2, 3, 6, 8, 10."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import LONG, ROWS, SCHEMA, edge, empty, prose
from conftest import SF_SMALL
from harness import compare
from tokloom.llm import common, decontaminate, exact_dedup, mixing, queries, sharding, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    compare(spark, name, SF_SMALL, queries.QUERIES[name], queries.ORACLE[name])


def ids(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"]) for r in rows))


ALL_IDS = sorted((r[0] is None, r[0]) for r in ROWS)


# --- words ---------------------------------------------------------------------------------

def test_words_equal_the_pattern():
    import pyarrow as pa
    texts = [t for _, t, *_ in ROWS] + ["x" * 5000 + " y", "a.b,c", "Z9é-ü"]
    off, data = common.text_bytes(pa.array(texts))
    got = defaultdict(list)
    for a, b in common.slices(off, 1000):
        w = common.cut_words(off, data, a, b)
        for i, d in enumerate(w.doc):
            got[a + d].append((w.text(i), int(w.hash[i])))
    by_word = {}
    for k, t in enumerate(texts):
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        assert [x for x, _ in got[k]] == want
        for x, h in got[k]:
            assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- 2: mixing -----------------------------------------------------------------------------

def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    # 5/8 of 1010 is above 3 * 10: the rest is shared 2 to 1
    assert mixing.targets([10, 500, 500], [5, 2, 1]) == pytest.approx([30, 980 * 2 / 3, 980 / 3])
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 10.0]
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_mix_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in mixing.taken(docs).collect()}
    raw = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()}
    assert {d: (r["source"], r["size"]) for d, r in got.items()} == raw
    total = Counter()
    for s, n in raw.values():
        total[s] += n
    names = sorted(total)
    want = dict(zip(names, mixing.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    took = Counter()
    for d, r in got.items():
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert took == {s: round(t) for s, t in want.items()}
    again = {r["doc_id"]: r["taken"] for r in mixing.taken(docs.repartition(7)).collect()}
    assert again == {d: r["taken"] for d, r in got.items()}


def test_schedule_has_low_discrepancy_and_every_block(spark):
    blocks, shares = [700, 250, 50, 0], [0.7, 0.25, 0.05, 0.0]
    rows = sorted((r["slot"], r["src"], r["block"]) for r in mixing.schedule(spark, blocks, shares).collect())
    assert sorted((s, b) for _, s, b in rows) == [(s, b) for s, n in enumerate(blocks) for b in range(n)]
    assert len({t for t, _, _ in rows}) == 1000
    seen = Counter()
    for i, (_, s, b) in enumerate(rows[:990]):
        assert b == seen[s]
        seen[s] += 1
        for k in range(3):
            assert abs(seen[k] - shares[k] * (i + 1)) < 6


def test_pieces_are_blocks_of_equal_words(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    documents, pieces = mixing.mix(docs, block_words=500)
    p = pieces.join(documents, "row")
    words = p.groupBy("slot").agg(F.sum("words").alias("w"), F.countDistinct("source").alias("n")).collect()
    assert all(r["n"] == 1 for r in words)
    short = [r for r in words if r["w"] != 500]
    assert all(r["w"] < 500 for r in short) and len(short) <= documents.select("source").distinct().count()


def test_mix_of_edge_rows(spark):
    got = mixing.taken(edge(spark)).collect()
    assert ids(got) == ALL_IDS
    for r in got:
        assert r["taken"] <= 3 * r["size"]
    by = {r["doc_id"]: r["size"] for r in got}
    assert (by[1], by[2], by[3], by[4], by[8], by[9], by[11]) == (0, 0, 0, 40_000, 1, 5, 2)
    assert mixing.taken(empty(spark)).count() == 0
    out = mixing.mixture(edge(spark))
    assert out.columns == edge(spark).columns
    assert set(r["doc_id"] for r in out.collect()) <= {r[0] for r in ROWS}
    assert mixing.mixture(empty(spark)).count() == 0


# --- 3: decontamination --------------------------------------------------------------------

def brute_hits(docs, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    grams = defaultdict(set)
    for item, text in items:
        w = cut(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[i:i + k])].add(str(item))
    out = []
    for d, text, *_ in docs:
        w, hit, found = cut(text), set(), set()
        for g, who in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= who
        out.append((d is None, d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_short_items_and_edge_rows(spark):
    tail = prose(60, 3).split()
    items = [(1, " ".join(tail[20:35]).upper()), (2, "one"), (3, "12, 34"), (4, None), (5, "..."), (6, " ".join(tail[48:])),
             (6, " ".join(tail[:9])), (7, " ".join(LONG.split()[20_000:20_012]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find(edge(spark), bench).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=str)
    assert got == brute_hits(ROWS, items)
    assert sum(r["n_hit"] > 0 for r in rows) >= 4
    assert decontaminate.find(empty(spark), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.find(edge(spark), bench.where("false")).collect())


def test_clean_removes_documents_or_spans(spark):
    passage = prose(12, 9)
    rows = [(1, f"Before. {passage.upper()}! After", "x"), (2, "clean text", "y"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, bench, "span").collect()}
    assert spans[1].split() == ["Before.", "!", "After"] and spans[2] == "clean text" and spans[3] is None
    with pytest.raises(ValueError):
        decontaminate.clean(docs, bench, "other")


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    q = decontaminate.op3_decontaminate
    want = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, q(spark, SF_SMALL).collect())) == want


# --- 6: exact deduplication ----------------------------------------------------------------

def brute_groups(rows):
    groups = defaultdict(list)
    for d, text, *_ in rows:
        groups[text or ""].append(d)
    out = []
    for text, who in groups.items():
        keep = max((d for d in who if d is not None), default=None)
        for d in who:
            out.append((d, keep, len(who), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def check_groups(rows, got):
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_groups(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_dedup_of_edge_rows(spark):
    check_groups(ROWS, exact_dedup.dedup(edge(spark)).collect())
    assert exact_dedup.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [200, 3000])
def test_small_tables_recurse(spark, limit, monkeypatch):
    """Buckets that do not fit are spilled and divided again; a hot text is folded in parts."""
    monkeypatch.setattr(exact_dedup, "IDS_PER_ROW", 16)
    rows = [(i, prose(20 + i % 5, i % 90), None, None, 0) for i in range(500)] + [(1000 + i, "hot", None, None, 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check_groups(rows, exact_dedup.dedup(df, table_bytes=limit, fan_out=3).collect())


def test_equal_hashes_are_compared_in_full():
    t = exact_dedup.ContentTable(4)
    assert [t.find(7, x) for x in (b"a", b"b", b"a", b"c", b"d", b"b")] == [0, 1, 0, 2, 3, 1]


def test_normalised_dedup(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    got = exact_dedup.dedup(df, lambda c: F.regexp_replace(F.lower(c), " +", " "))
    assert sorted((r["doc_id"], r["keep_id"]) for r in got.collect()) == [(1, 2), (2, 2), (3, 3)]


# --- 8: WARC -------------------------------------------------------------------------------

def page_rows():
    return [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u\r\nx: y", ""), (5, "http://c/", "é\r\n\r\nWARC/1.1\r\n"),
            (2, "http://b/", "<p>x</p>"), (None, "http://n/", "alone"), (None, "http://n/", "<p>x</p>"), (6, "http://long/", LONG)]


def test_bundles_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("bundle", F.lit("x"))
    path = str(tmp_path / "w")
    index = warc.write_bundles(pages, path, frame_bytes=64, bundle_bytes=100)
    got = warc.read_bundles(index, path).collect()
    want = []
    for p, _, html in page_rows():
        raw = (html or "").encode()
        same = [q for q, _, h in page_rows() if (h or "") == (html or "")]
        top = max((q for q in same if q is not None), default=None)
        kind = "response" if p == top else "revisit"
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, top if kind == "revisit" else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) \
        == sorted(want, key=str)
    for r in got:
        raw = next((h or "").encode() for p, _, h in page_rows() if p == r["page_id"] and len((h or "").encode()) == r["payload_bytes"])
        assert bytes(r["payload"]) == (raw if r["record_type"] == "response" else b"")
    # any record can be read by its place alone
    for place in index.collect():
        head, http, payload = warc.read_record(path, place.asDict())
        assert head["WARC-Record-ID"] == warc.page_urn(place["page_id"])
        assert head["WARC-Type"] == "revisit" or len(payload) == int(http["Content-Length"])
    # frames decompress on their own and in a row with any Zstandard reader
    import zstandard
    name = index.where("page_id = 6").first()["bundle"]
    raw = (tmp_path / "w" / "bundles" / name).read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n")


def test_small_payloads_are_never_revisits(spark, tmp_path):
    pages = spark.createDataFrame(page_rows()[:5], "page_id long, url string, html string")
    index = warc.write_bundles(pages, str(tmp_path / "w"), min_bytes=9)
    assert {r["record_type"] for r in warc.read_bundles(index, str(tmp_path / "w")).collect()} == {"response"}


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    index = warc.write_bundles(pages, str(tmp_path / "w"))
    f = next((tmp_path / "w" / "bundles").iterdir())
    import zstandard
    table = warc.seek_table(__import__("pyarrow").OSFile(str(f)))
    raw = zstandard.ZstdDecompressor().decompress(f.read_bytes()[:table[0][1]]).replace(b"payload", b"pAyload")
    w = warc.BundleWriter(warc.file_system(str(f))[0], str(f), 10, 3)
    w.add(1, raw)
    w.close()
    with pytest.raises(Exception, match="damaged"):
        warc.read_bundles(index, str(tmp_path / "w")).collect()


def test_bundles_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(60).selectExpr("id as page_id", "'u' as url", "concat('page ', id) as html").repartition(4)
    index = warc.write_bundles(pages, str(tmp_path / "w"), frame_bytes=64, bundle_bytes=100)
    assert index.select("bundle").distinct().count() > 8
    got = warc.read_bundles(index, str(tmp_path / "w")).select("page_id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(60)) and len({r["p"] for r in got}) > 3


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_bundles(pages, str(tmp_path / "w"))
    assert index.count() == 0 and warc.read_bundles(index, str(tmp_path / "w")).count() == 0


# --- 10: sharding --------------------------------------------------------------------------

@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = sharding.hilbert_index(cells, bits)
    assert sorted(place.tolist()) == list(range(side ** dims))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_edge_rows(spark, law):
    got = sharding.place(edge(spark), law=law, n_shards=4).collect()
    assert ids(got) == ALL_IDS
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    if law == "rows":
        n = Counter(r["shard"] for r in got)
        assert max(n.values()) - min(n.values()) <= 1 and sorted(n) == [0, 1, 2, 3]
    assert sharding.place(empty(spark), law=law).count() == 0


def test_shards_prune_and_keep_texts_together(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sharding.place(docs, law="rows").join(docs.select("doc_id", "text", "lang"), "doc_id").collect()
    n = Counter(r["shard"] for r in rows)
    assert sorted(n) == list(range(8)) and max(n.values()) - min(n.values()) <= 1
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    runs = sum(a["text"] != b["text"] for a, b in zip(order, order[1:])) + 1
    assert runs == len({r["text"] for r in rows})                 # equal texts lie next to each other
    langs = sum(len({r["lang"] for r in rows if r["shard"] == s}) for s in range(8))
    assert langs < 8 * len({r["lang"] for r in rows})


def test_bytes_law_is_near_equal(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sharding.place(docs, law="bytes").collect()
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    most = max(r["size"] for r in rows)
    assert max(load.values()) - min(load.values()) <= 2 * most


def test_written_shards(spark, tmp_path):
    docs = edge(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).drop("curve", "shard", "slot")
    out = sharding.write_shards(docs, sharding.place(docs, n_shards=3), str(tmp_path / "s"))
    assert out.count() == docs.count() and {r["shard"] for r in out.select("shard").distinct().collect()} == {0, 1, 2}


def test_sources_that_share_a_prefix_get_their_own_cells(spark):
    rows = [(i, f"text {i}", f"https://example.org/{i % 8}", "en") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    dims = {"source": F.col("source"), "nothing": F.lit(0.0)}
    curve = {r["doc_id"]: r["curve"] for r in sharding.place(docs, dims).collect()}
    assert all(curve[i] == curve[i % 8] for i in range(160)) and len(set(curve.values())) == 8
    by_default = sharding.place(docs.withColumn("text", F.concat(F.lit("text "), F.lpad("doc_id", 3, "0")))).collect()
    assert len({r["curve"] for r in by_default}) == 8
    assert sharding.text_cuts(docs, "source", 4, "test-cuts") == [f"https://example.org/{i}" for i in (1, 3, 5)]
