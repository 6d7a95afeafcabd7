"""Benchmark decontamination by a broadcast set of normalised n-grams (operator 3).

DataFrame functions only. Items are cut into windows of ``n`` consecutive words;
an item of fewer words, but not none, is one window. One pass over the documents
hashes every window of every text (grams of 2, 4 and 8 words are hashed from
the halves), looks it up in the broadcast set and compares the words of the few
that match. What leaves the pass is one narrow row per document and one per
verified window.

Defined results: null text has no words; an item without words never occurs; a
document without words is clean; empty tables give no rows or no hits; rows that
repeat get a row each, and rows with one id and different texts are separate;
columns beyond id and text, whatever their names, are ignored by :func:`find` and kept by :func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"            # after lower-casing A-Z
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to so many distinct windows (a few hundred bytes each) the set is broadcast.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _with_grams(df: DataFrame, lengths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Adds arrays of the hashes of all grams of ``w`` of each length (columns ``_g<length>``)."""
    need: set[int] = set()
    todo = list(lengths)
    while todo:
        k = todo.pop()
        if k not in need:
            need.add(k)
            if k > 1:
                p = 1 << ((k - 1).bit_length() - 1)
                todo += [p, k - p]
    for k in sorted(need):
        if k == 1:
            col = F.transform("w", lambda x: F.xxhash64(x))
        else:
            p = 1 << ((k - 1).bit_length() - 1)
            n = F.greatest(F.size("w") - F.lit(k - 1), F.lit(0))
            col = F.zip_with(F.slice(F.col(f"_g{p}"), F.lit(1), n),
                             F.slice(F.col(f"_g{k - p}"), F.lit(p + 1), n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"_g{k}", col)
    return df, {k: f"_g{k}" for k in lengths}


def windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, len, gram``: the windows of each item as words joined by blanks."""
    w = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    w = w.withColumn("len", length).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)))
    return w.select("item_id", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("gram")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, hits, n_items, items`` and its key.

    ``hits`` are the verified windows as (first word, length) in order; ``items``
    the ids of the items with an occurring window, as sorted strings. ``k1, k2``
    identify the row's id and text.
    """
    item_windows = common.stage(windows(benchmark, n, item_col, item_text_col), "op3-windows")
    grams = item_windows.select("len", "gram").distinct()
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())   # at most n values
    hashed, col = _with_grams(grams.withColumn("w", F.split("gram", " ")), lengths)
    key = F.lit(None).cast("long")
    for k in lengths:
        key = F.when(F.col("len") == k, F.get(F.col(col[k]), F.lit(0))).otherwise(key)
    grams = hashed.select(F.col("len").alias("g_len"), "gram", key.alias("g_key"))
    few = grams.count() <= BROADCAST_WINDOWS

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("k1"),
                       F.crc32(F.encode(text, "UTF-8")).alias("k2"), words(F.col(text_col)).alias("w"))
    rows, col = _with_grams(rows.withColumn("n_words", F.size("w")), lengths)
    # The last element, a null, carries the document itself through the lookup.
    all_keys = F.concat(*[F.col(col[k]) for k in lengths], F.array(F.lit(None).cast("long")))
    at = rows.select("doc_id", "k1", "k2", "w", "n_words", F.posexplode(all_keys).alias("at", "key"))
    pos, length, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for k in lengths:
        count = F.greatest(F.col("n_words") - (k - 1), F.lit(0))
        here = (F.col("at") >= before) & (F.col("at") < before + count)
        pos, length = F.when(here, F.col("at") - before).otherwise(pos), F.when(here, F.lit(k)).otherwise(length)
        before = before + count
    at = at.withColumn("pos", pos).withColumn("len", length)
    said = F.concat_ws(" ", *[F.when(F.col("len") > i, F.get("w", F.col("pos") + i)) for i in range(n)])
    out = ["doc_id", "k1", "k2", "n_words", "pos", "len", "gram"]
    if few:
        # The hash alone is the key of the lookup: words are put together only where it matches.
        same = F.col("gram").isNotNull() & (F.col("len") == F.col("g_len")) & (said == F.col("gram"))
        found = (at.join(F.broadcast(grams), F.col("key") == F.col("g_key"), "left")
                 .where(F.col("key").isNull() | same).select(*out))
    else:
        # A window goes through the shuffle with its own words, never with its document's.
        hits = (at.where(F.col("key").isNotNull()).withColumn("said", said).drop("w")
                .join(grams, (F.col("key") == F.col("g_key")) & (F.col("len") == F.col("g_len")) & (F.col("said") == F.col("gram"))))
        none = F.lit(None)
        found = hits.select(*out).unionByName(rows.select(
            "doc_id", "k1", "k2", "n_words", none.cast("int").alias("pos"), none.cast("int").alias("len"),
            none.cast("string").alias("gram")))
    found = common.stage(found, "op3-found")

    id_ = ["doc_id", "k1", "k2"]
    per = found.groupBy(*id_).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(F.col("gram").isNull(), 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("gram").isNotNull(), F.struct("pos", "len")))).alias("hits"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
                              (a["n"] + F.greatest(x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]), F.lit(0))
                               ).alias("n")), lambda a: a["n"])
    items = (found.where(F.col("gram").isNotNull()).select("k1", "k2", "len", "gram").distinct()
             .join(item_windows, ["len", "gram"])
             .groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    none = F.array().cast("array<string>")
    return (per.join(items, ["k1", "k2"], "left")
            .withColumn("n_hit", covered).withColumn("items", F.coalesce("items", none))
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "k1", "k2", "n_words", "n_hit", "hits", "n_items", "items"))


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 10, id_col: str = "doc_id",
          text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated documents, or (``mode='span'``) without the hit words."""
    if mode not in ("document", "span"):
        raise ValueError("mode is document or span")
    bad = (find(docs, benchmark, n, id_col, text_col, **options).where("n_hit > 0")
           .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("hits").alias("_hits"))
           .dropDuplicates(["_k1", "_k2"]))
    # Inside, columns have names of their own, so that none of the input's can clash.
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, body = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = docs.toDF(*names)
    text = F.coalesce(F.col(body), F.lit(""))
    same = (F.xxhash64(F.col(id_), text) == F.col("_k1")) & (F.crc32(F.encode(text, "UTF-8")) == F.col("_k2"))
    if mode == "document":
        return rows.join(bad, same, "left_anti").toDF(*docs.columns)
    gaps, said = F.split(F.col(body), ANY_CASE_WORD, -1), F.regexp_extract_all(F.col(body), F.lit(ANY_CASE_WORD), F.lit(0))
    rows = rows.join(bad, same, "left").withColumn("_gaps", gaps).withColumn("_said", said)
    kept = F.transform("_gaps", lambda g, i: F.concat(g, F.when(
        F.exists("_hits", lambda x: (x["pos"] <= i) & (i < x["pos"] + x["len"])), F.lit("")).otherwise(
        F.coalesce(F.get("_said", i), F.lit("")))))
    return rows.withColumn(body, F.when(F.col("_k1").isNull(), F.col(body)).otherwise(
        F.array_join(kept, ""))).select(*names).toDF(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of every benchmark item sought in every whole document."""
    out = find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, ks)),
h AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
nh AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT doc_id, p, unnest(generate_series(0, k - 1)) AS o FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(nh.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON nh.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""
