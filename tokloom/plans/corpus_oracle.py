"""DuckDB oracle SQL for the corpus queries.

Written independently of the Spark code: plain window functions and list
functions. DuckDB's RE2 has ASCII ``\\s``; the test text holds no other
whitespace, which the tests check.
"""

from __future__ import annotations

from .corpus_plans import QUERY_BATCH_ROWS, QUERY_TARGET_BYTES

LF = "chr(10)"

DIRTY = f"""
  CASE doc_id % 4
    WHEN 0 THEN replace(text, ' ', chr(9) || ' ' || chr(160))
    WHEN 1 THEN replace(text, {LF}, chr(13) || {LF})
    WHEN 2 THEN replace(text, {LF}, repeat({LF}, 4))
    ELSE '  ' || text || {LF} || ' '
  END"""

CLEAN = ("regexp_replace(regexp_replace(regexp_replace("
         "replace(replace(text, chr(13) || chr(10), chr(10)), chr(160), ' '), "
         "'[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), "
         "'^\\s+|\\s+$', '', 'g')")


def labelled_cte(dirtied: bool = True) -> str:
    text = DIRTY if dirtied else "text"
    return f"""
s AS (
  SELECT CAST(substr(source, 4) AS INTEGER) AS shard, doc_id, lang,
         source || '/' || CAST(doc_id AS VARCHAR) AS title, {text} AS text
  FROM documents),
c AS (SELECT *, {CLEAN} AS clean FROM s),
l AS (
  SELECT *, length(clean) AS n_chars,
    CAST(len(list_filter(string_split(clean, {LF}), lambda x: regexp_matches(x, '[^\\s]'))) AS INTEGER) AS n_lines,
    CAST(len(list_filter(string_split(clean, {LF}),
         lambda x: regexp_matches(x, '[^\\s]') AND length(x) < 40)) AS INTEGER) AS n_short
  FROM c),
lab AS (
  SELECT *, CASE WHEN text IS NULL OR text = '' THEN 'empty'
                 WHEN n_chars < 600 THEN 'short'
                 WHEN n_lines = 0 OR n_short * 2 > n_lines THEN 'list'
                 ELSE 'kept' END AS label
  FROM l),
f AS (
  SELECT *, CASE WHEN label = 'kept'
                 THEN '= ' || title || ' =' || {LF} || {LF} || clean || {LF} || {LF} END AS doc
  FROM lab),
fb AS (SELECT *, CAST(coalesce(strlen(doc), 0) AS BIGINT) AS n_bytes FROM f)"""


def batches_cte(batch_rows: int = QUERY_BATCH_ROWS, target: int | None = None, dirtied: bool = True) -> str:
    processed = "TRUE" if target is None else f"bytes_before < {int(target)}"
    return labelled_cte(dirtied) + f""",
kb AS (
  SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1) // {batch_rows} AS batch_id
  FROM fb),
b0 AS (
  SELECT shard, batch_id, count(*) AS n_rows,
         CAST(sum(CASE WHEN label = 'kept' THEN 1 ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(n_bytes) AS BIGINT) AS batch_bytes
  FROM kb GROUP BY shard, batch_id),
b AS (
  SELECT *, CAST(coalesce(sum(batch_bytes) OVER (ORDER BY shard, batch_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before,
         {processed} AS processed
  FROM b0),
o AS (
  SELECT kb.doc_id, kb.shard, kb.batch_id, kb.n_bytes,
         CAST(b.bytes_before + coalesce(sum(kb.n_bytes) OVER (PARTITION BY kb.shard, kb.batch_id
              ORDER BY kb.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           AS start_byte,
         kb.title, kb.doc, kb.n_chars
  FROM kb JOIN b USING (shard, batch_id)
  WHERE kb.label = 'kept' AND b.processed)"""


def split_cte(target: int | None, dirtied: bool = True) -> str:
    return batches_cte(target=target, dirtied=dirtied) + """,
t AS (SELECT coalesce(sum(n_bytes), 0) AS total FROM o),
sp AS (
  SELECT o.*, CASE WHEN start_byte < floor(CAST(t.total AS DOUBLE) * (1.0::DOUBLE - 0.01::DOUBLE))
                   THEN 'train' ELSE 'val' END AS split
  FROM o, t)"""


ORACLE = {
    "clean_text": f"""
WITH d AS (SELECT doc_id, {DIRTY} AS text FROM documents)
SELECT doc_id, length({CLEAN}) AS clean_chars, md5({CLEAN}) AS clean_md5 FROM d""",

    "short_line_ratio": f"""
WITH {labelled_cte()}
SELECT doc_id, n_lines, n_short,
       round(CASE WHEN n_lines > 0 THEN n_short / n_lines END, 6) AS short_ratio FROM lab""",

    "corpus_filter": f"""
WITH {labelled_cte()}
SELECT doc_id, lang, n_chars, label FROM lab WHERE label <> 'empty'""",

    "corpus_summary": f"""
WITH {labelled_cte()}
SELECT shard,
       CAST(sum(CASE WHEN label = 'kept' THEN 1 ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN label = 'short' THEN 1 ELSE 0 END) AS BIGINT) AS skipped_short,
       CAST(sum(CASE WHEN label = 'list' THEN 1 ELSE 0 END) AS BIGINT) AS skipped_list,
       CAST(sum(n_bytes) AS BIGINT) AS bytes,
       round(sum(n_bytes) / 3.2 / 1e6, 6) AS est_mtokens
FROM fb GROUP BY ROLLUP (shard)""",

    "shard_inventory": f"""
WITH s AS (SELECT CAST(substr(source, 4) AS INTEGER) AS shard, doc_id FROM documents),
k AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1) // {QUERY_BATCH_ROWS}
              AS batch_id FROM s)
SELECT shard, count(*) AS n_rows, count(DISTINCT batch_id) AS n_batches,
       min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id
FROM k GROUP BY shard""",

    "corpus_offsets": f"""
WITH {batches_cte()}
SELECT doc_id, shard, batch_id, n_bytes, start_byte FROM o""",

    "corpus_cutoff": f"""
WITH {batches_cte(target=QUERY_TARGET_BYTES)}
SELECT shard, batch_id, n_rows, kept, batch_bytes, bytes_before, processed FROM b""",

    "corpus_until": f"""
WITH {batches_cte(target=QUERY_TARGET_BYTES)}
SELECT shard, batch_id, n_rows, kept, batch_bytes, bytes_before FROM b WHERE processed""",

    "train_val_split": f"""
WITH {split_cte(None)}
SELECT doc_id, start_byte, n_bytes, split FROM sp""",

    "corpus_docs": f"""
WITH {batches_cte()}
SELECT doc_id, title, n_chars, n_bytes, md5(doc) AS doc_md5 FROM o""",
}
