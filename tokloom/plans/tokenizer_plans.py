"""Registered tokenizer queries: pieces, byte and pair histograms and the context
window; merges learned on the prepared corpus of all documents, encoding,
decoding, token totals, training windows and the vocabulary study.

The corpus, the learned tokenizer and the token table are stored stages
(``sources.stages``): each query reads what an earlier one wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..functions.constants import COMPOUNDS, CONFIGS, END_OF_TEXT, PIECE_PATTERN, EVAL_SEED, SAMPLE_SENTENCE, STUDY_ARCH, STUDY_STEPS, TRAIN_SEED
from ..operators import encode as E
from ..operators import study as ST
from ..operators.bpe import merges_from_df, train_bpe
from ..operators.corpus import build_corpus
from ..operators.pieces import byte_histogram, initial_types, pair_counts_of, piece_counts
from ..operators.windows import conversation_context, token_context
from ..session import scratch_path, staged
from ..sources import sinks, stages
from ..sources.corpustext import read_text, write_text
from ..sources.tables import read_shards, read_table, spread
from ..sources.tokenstore import TokenStore, write_store
from .corpus_oracle import CLEAN, split_cte
from .corpus_plans import QUERY_BATCH_ROWS

# Vocabulary sizes of the registered study that SQL repeats merge by merge: 32, 64, 128 and 256
# merges on top of the 257 base ids, learned once (smaller sizes are prefixes of the list).
QUERY_VOCABS = [289, 321, 385, 513]
# --- fixed values: the vocabulary sizes of the reference's study ---
STUDY_VOCABS = [4096, 8192, 16384, 32768]
WINDOW_BLOCK, WINDOW_BATCH, WINDOW_STEPS = 64, 8, 4
EVAL_BATCHES = 10
CONTEXT_PIECES = 256


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared corpus of all documents, as stored."""
    path = stages.stage_path(spark, "corpus", stages.fingerprint(spark, sf_dir, "documents"), QUERY_BATCH_ROWS)
    return stages.table(spark, path, lambda p: sinks.write_corpus(
        build_corpus(read_shards(spark, sf_dir), batch_rows=QUERY_BATCH_ROWS)["corpus"], p))


def tokenizer(spark: SparkSession, sf_dir: str, vocab: int) -> tuple[list[E.Merge], DataFrame]:
    """Merge list and pieces of the tokenizer learned on the prepared corpus, loaded from where they are stored."""
    path = stages.stage_path(spark, "tokenizer", stages.fingerprint(spark, sf_dir, "documents"), vocab)

    def write(p: str) -> None:
        res = train_bpe(piece_counts(prepared(spark, sf_dir), "doc"), vocab)
        sinks.write_tokenizer(res.merges, res.types, p)

    merges, types = sinks.read_tokenizer(spark, stages.stored(spark, path, write))
    return merges_from_df(merges), types


def learned(spark: SparkSession, sf_dir: str, vocab: int = QUERY_VOCABS[-1]) -> list[E.Merge]:
    """The merge list of the learned tokenizer."""
    return tokenizer(spark, sf_dir, vocab)[0]


def merges_for(merges: list, vocab: int) -> list:
    """Merges of a smaller vocabulary: a prefix of the list."""
    return merges[:max(0, vocab - 257)]


def token_store(spark: SparkSession, sf_dir: str, vocabs: list[int] = QUERY_VOCABS) -> TokenStore:
    """The corpus encoded by some vocabularies, stored by position."""
    path = stages.stage_path(spark, "tokens", stages.fingerprint(spark, sf_dir, "documents"), vocabs)

    def write(p: str) -> None:
        merges, types = tokenizer(spark, sf_dir, vocabs[-1])
        write_store(prepared(spark, sf_dir), p, merges, vocabs, types,
                    derived={"n_doc_chars": F.length("doc").cast("bigint"), "n_words": T.whitespace_words("doc")})

    return TokenStore(spark, stages.stored(spark, path, write))


def doc_tokens(spark: SparkSession, sf_dir: str, vocab: int | None = None, vocabs: list[int] = QUERY_VOCABS) -> DataFrame:
    """The stored token table: ``vocab, split, part, doc_id, start_byte, n_bytes, n_doc_chars, n_words, n_tokens, ids,
    local_pos, start_pos``."""
    return token_store(spark, sf_dir, vocabs).tokens(vocab)


def _raw_clean(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", T.clean_text("text").alias("text"))


def q_piece_counts(spark, sf_dir):
    return piece_counts(_raw_clean(spark, sf_dir), "text")


STREAM_CHUNK = 1 << 16


def q_stream_pieces(spark, sf_dir):
    """Pieces of the corpus as one stream of text: stored as flat files, read in parts of 64 KB by many tasks."""
    path = stages.stage_path(spark, "text", stages.fingerprint(spark, sf_dir, "documents"), QUERY_BATCH_ROWS)
    parts = read_text(spark, stages.stored(spark, path, lambda p: write_text(prepared(spark, sf_dir), p)), STREAM_CHUNK)
    # Only the stream's own beginning gets a prefix space.
    cut = F.when(F.col("start_byte") == 0, T.pieces("text")).otherwise(T.pieces("text", add_prefix_space=False))
    return parts.select(F.explode(cut).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("cnt"))


def q_byte_histogram(spark, sf_dir):
    return byte_histogram(piece_counts(_raw_clean(spark, sf_dir), "text"))


def q_pair_counts(spark, sf_dir):
    return pair_counts_of(initial_types(piece_counts(_raw_clean(spark, sf_dir), "text")))


def q_context_window(spark, sf_dir):
    c = conversation_context(spread(read_table(spark, sf_dir, "conversations")), CONTEXT_PIECES)
    return c.select("conv_id", F.col("n_total").alias("n_pieces"), "n_context",
                    F.md5(F.array_join("context", "")).alias("context_md5"))


def q_context_tokens(spark, sf_dir):
    """The last 256 token ids of every conversation by the largest vocabulary that SQL repeats."""
    enc = E.encode_udf(spark, learned(spark, sf_dir))
    c = token_context(spread(read_table(spark, sf_dir, "conversations")), CONTEXT_PIECES, enc)
    return c.select("conv_id", "n_context", F.md5(F.array_join("context", ",")).alias("context_md5"))


def q_bpe_merges(spark, sf_dir):
    return spark.createDataFrame(learned(spark, sf_dir), "rank int, left int, right int, new_id int, pair_count long")


def q_encode_docs(spark, sf_dir):
    """Every document of the corpus by the largest vocabulary: where its tokens
    start in the stream, how many, and the md5 of their ids (written ``|id|``)."""
    t = doc_tokens(spark, sf_dir, QUERY_VOCABS[-1])
    ids = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("|"), i.cast("string"), F.lit("|"))), "")
    return t.select("doc_id", "split", "start_byte", "start_pos", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.md5(ids).alias("tokens_md5"))


def q_decode_roundtrip(spark, sf_dir):
    """md5 and length of every document's text as decoded from its ids."""
    t = E.decoded(doc_tokens(spark, sf_dir, QUERY_VOCABS[-1]), learned(spark, sf_dir), "text")
    return t.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def _union(xs):
    out = xs[0]
    for x in xs[1:]:
        out = out.unionByName(x)
    return out


def q_token_totals(spark, sf_dir):
    return E.token_totals(doc_tokens(spark, sf_dir))


def _items(spark, texts: list[str]) -> DataFrame:
    schema = Ty.StructType([Ty.StructField("item_id", Ty.LongType()),
                            Ty.StructField("text", Ty.StringType())])
    return spark.createDataFrame(list(enumerate(texts)), schema)


def encode_items(spark, sf_dir, items: DataFrame, vocabs: list[int] = QUERY_VOCABS) -> DataFrame:
    """``item_id, text, vocab, ids, n_tokens`` for a probe table, by every vocabulary."""
    return E.encode_texts(items, "text", ["item_id", "text"], learned(spark, sf_dir, vocabs[-1]), vocabs)


def q_probe_splits(spark, sf_dir):
    """Benchmark items as probe words: tokens per item and the decoded pieces."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    t = E.decoded(encode_items(spark, sf_dir, items), learned(spark, sf_dir), "pieces", sep=" · ")
    return t.select("vocab", "item_id", "n_tokens", "pieces")


def q_context_words(spark, sf_dir):
    t = doc_tokens(spark, sf_dir, QUERY_VOCABS[-1])
    w = F.lit(float(ST.CONTEXT_TOKENS)) * F.col("n_words") / F.greatest(F.col("n_tokens"), F.lit(1))
    return t.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.round(w, 6).alias("words_per_256"))


def _windows(spark, sf_dir, split):
    w = token_store(spark, sf_dir).windows(QUERY_VOCABS[-1], split, WINDOW_STEPS, WINDOW_BATCH, WINDOW_BLOCK)
    return w.select("step", "slot", "start_pos", F.size("x").alias("n_x"),
                    F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


def q_train_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "train")


def q_val_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "val")


def study_parts(spark, sf_dir, sizes: list[int] = QUERY_VOCABS) -> dict[str, DataFrame]:
    """Per-vocabulary tables the study row is assembled from; each measure is one
    grouped job over the stored token table."""
    vocabs = spark.createDataFrame([(v, STUDY_ARCH) for v in sizes], "vocab INT, arch STRING")
    grid = ST.with_model_params(ST.study_grid(ST.configs_table(spark), vocabs, steps=STUDY_STEPS))
    compounds, sentence = _items(spark, COMPOUNDS), _items(spark, [SAMPLE_SENTENCE])
    t = doc_tokens(spark, sf_dir, vocabs=sizes)
    totals = t.groupBy("vocab").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("corpus_bytes"),
        F.sum("n_doc_chars").cast("bigint").alias("corpus_chars"))
    probes = ST.probe_stats(encode_items(spark, sf_dir, compounds, sizes))
    sent = ST.words_per_context(encode_items(spark, sf_dir, sentence, sizes), "text")
    ng = ST.ngram_loss(t.select("vocab", "split", "ids"))
    return {"params": grid.select("vocab", "params", "embed_params", "embed_share"),
            "fertility": ST.fertility(t).select("vocab", "fertility"), "probes": probes,
            "sentence": sent.select("vocab", "words_per_256"), "sizes": totals,
            "loss": ng.select("vocab", F.col("bigram_loss").alias("val_loss"), "unigram_loss", "n_val")}


def q_fertility(spark, sf_dir):
    f = ST.fertility(doc_tokens(spark, sf_dir))
    return f.select("vocab", F.round("fertility", 9).alias("fertility"), "sample_docs")


def q_vocab_stats(spark, sf_dir):
    """Tokenizer statistics per vocabulary, with the nine compounds' splits as a JSON map."""
    parts = study_parts(spark, sf_dir)
    t = E.decoded(encode_items(spark, sf_dir, _items(spark, COMPOUNDS)), learned(spark, sf_dir), "_d", sep=" · ")
    splits = t.select("vocab", "text", F.split("_d", " · ").alias("pieces")).groupBy("vocab").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("text", "pieces")))).alias("compound_splits"))
    st = (parts["fertility"].join(parts["probes"], "vocab").join(parts["sentence"], "vocab").join(splits, "vocab"))
    st = st.select(F.col("vocab").alias("vocab_size"), F.round("fertility", 3).alias("fertility"),
                   F.round("tokens_per_compound", 2).alias("tokens_per_compound"),
                   F.round("words_per_256", 1).alias("german_words_per_256_tokens"), "compound_splits")
    # The report as it is kept: written as JSON and read by its schema.
    path = scratch_path(spark, "stats")
    sinks.write_stats(st, path)
    return sinks.read_stats(spark, path).withColumn("compound_splits", F.to_json("compound_splits"))


def q_run_budget(spark, sf_dir):
    """Per shipped configuration: tokens per step, tokens over the run and the
    epochs that makes over the training split of the token table (largest
    vocabulary); scalars come from scalar subqueries."""
    path = scratch_path(spark, "configs")
    sinks.write_configs(ST.configs_table(spark), path)
    cfg = ST.with_model_params(ST.read_configs(spark, path))
    tok = doc_tokens(spark, sf_dir, QUERY_VOCABS[-1])
    return spark.sql("""
        SELECT name, tokens_per_step, CAST(tokens_per_step * max_steps AS BIGINT) AS total_tokens,
               (SELECT sum(n_tokens) FROM {t} WHERE split = 'train') AS train_tokens,
               round(tokens_per_step * max_steps
                     / (SELECT sum(n_tokens) FROM {t} WHERE split = 'train'), 6) AS epochs,
               (SELECT sum(n_tokens) FROM {t} WHERE split = 'train') >= block_size + 1 AS enough_tokens
        FROM {c}""", c=cfg, t=tok)


def q_vocab_study(spark, sf_dir):
    s = ST.study_table(study_parts(spark, sf_dir))
    exact = {"vocab", "params", "embed_params"}
    return s.select(*[F.col(c) if c in exact else F.round(c, 9).alias(c) for c in s.columns])


def q_bpe_merges_full(spark, sf_dir):
    """The merges of the largest vocabulary of the reference's study, as far as pairs occur twice."""
    return spark.createDataFrame(learned(spark, sf_dir, STUDY_VOCABS[-1]), "rank int, left int, right int, new_id int, pair_count long")


def q_encode_docs_full(spark, sf_dir):
    """Every document by every vocabulary of the reference's study: where its tokens start in that vocabulary's
    stream, how many, the md5 of their ids, and the md5 of the text they decode to."""
    merges = learned(spark, sf_dir, STUDY_VOCABS[-1])
    t = E.decoded(doc_tokens(spark, sf_dir, vocabs=STUDY_VOCABS), merges, "_text")
    return t.select("vocab", "doc_id", "split", "start_byte", "start_pos", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("ids", ",")).alias("tokens_md5"), F.md5("_text").alias("text_md5"))


def q_vocab_study_full(spark, sf_dir):
    """The study at the reference's vocabulary sizes, with each size's rank by loss and by bits per byte."""
    s = ST.study_table(study_parts(spark, sf_dir, STUDY_VOCABS))
    exact = {"vocab", "params", "embed_params"}
    rounded = s.select(*[F.col(c) if c in exact else F.round(c, 9).alias(c) for c in s.columns])
    return rounded.join(ST.study_ranks(rounded), "vocab")


def q_study_winners(spark, sf_dir):
    return ST.study_winners(sinks.write_study(q_vocab_study(spark, sf_dir), scratch_path(spark, "study")))


def q_ngram_loss(spark, sf_dir):
    n = study_parts(spark, sf_dir)["loss"]
    return n.select("vocab", F.round("val_loss", 9).alias("val_loss"), F.round("unigram_loss", 9).alias("unigram_loss"), "n_val")


def q_eval_batches(spark, sf_dir):
    """Evaluation as the training loop does it: fixed batches of the held-out stream, drawn by seed, and the
    mean loss of each under the count model of the training stream; the row without a step is the mean of the batches."""
    store, vocab = token_store(spark, sf_dir), QUERY_VOCABS[-1]
    counts = staged(ST.neighbour_counts(store.tokens(vocab, "train")), "train-neighbours")
    w = store.windows(vocab, "val", EVAL_BATCHES, WINDOW_BATCH, WINDOW_BLOCK, seed=EVAL_SEED)
    losses = staged(ST.batch_losses(w, counts, vocab), "eval-losses")
    whole = losses.agg(F.lit(None).cast("long").alias("step"), F.sum("n_tokens").alias("n_tokens"), F.avg("mean_loss").alias("mean_loss"))
    return losses.unionByName(whole).select("step", "n_tokens", F.round("mean_loss", 9).alias("mean_loss"))


def q_heldout_loss(spark, sf_dir):
    """Mean cross entropy of the score vectors by their target."""
    e = ST.heldout_loss(read_table(spark, sf_dir, "embeddings"), "embedding", "label")
    return e.groupBy(F.col("label").alias("target")).agg(
        F.count("nll").alias("n"), F.round(F.avg("nll"), 5).alias("mean_loss"))


QUERIES = {
    "piece_counts": q_piece_counts,
    "byte_histogram": q_byte_histogram,
    "stream_pieces": q_stream_pieces,
    "pair_counts": q_pair_counts,
    "context_window": q_context_window,
    "context_tokens": q_context_tokens,
    "bpe_merges": q_bpe_merges,
    "encode_docs": q_encode_docs,
    "decode_roundtrip": q_decode_roundtrip,
    "token_totals": q_token_totals,
    "probe_splits": q_probe_splits,
    "context_words": q_context_words,
    "train_windows": q_train_windows,
    "val_windows": q_val_windows,
    "fertility": q_fertility,
    "heldout_loss": q_heldout_loss,
    "eval_batches": q_eval_batches,
    "vocab_stats": q_vocab_stats,
    "vocab_study": q_vocab_study,
    "run_budget": q_run_budget,
    "study_winners": q_study_winners,
    "bpe_merges_full": q_bpe_merges_full,
    "encode_docs_full": q_encode_docs_full,
    "vocab_study_full": q_vocab_study_full,
    "ngram_loss": q_ngram_loss,
}

# DuckDB's RE2 has no look-ahead; with no two adjacent whitespace characters in
# the input (true of the raw texts; checked in the tests) the last two
# alternatives of the piece pattern reduce to a single whitespace character.
DUCK_PATTERN = PIECE_PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s").replace("'", "''")

PIECES_CTE = f"""
d AS (SELECT doc_id, {CLEAN} AS text FROM documents),
pc AS (
  SELECT piece, count(*) AS cnt FROM (
    SELECT unnest(regexp_extract_all(CASE WHEN left(text, 1) = ' ' THEN text ELSE ' ' || text END,
                                     '{DUCK_PATTERN}')) AS piece FROM d)
  GROUP BY piece),
bl AS (
  SELECT cnt, list_transform(range(strlen(piece)),
           lambda i: CAST(('0x' || substr(hex(encode(piece)), 2 * i + 1, 2)) AS INTEGER)) AS b
  FROM pc)"""

# In the formatted corpus whitespace runs do occur: an unused character between the last two
# characters of a run that a non-blank follows lets plain ``\\s+`` cut like the look-ahead.
RUN_PATTERN = PIECE_PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s+").replace("'", "''")


def pieces_sql(text: str) -> str:
    spaced = f"(CASE WHEN left({text}, 1) = ' ' THEN {text} ELSE ' ' || {text} END)"
    return (f"flatten(list_transform(string_split(regexp_replace({spaced}, '(\\s)(\\s[^\\s])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), "
            f"lambda x: regexp_extract_all(x, '{RUN_PATTERN}')))")


N_MERGES = QUERY_VOCABS[-1] - 257

BPE_CTE = f"""
WITH RECURSIVE
{split_cte(None, dirtied=False)},
dp AS (SELECT doc_id, split, start_byte, n_bytes, doc, {pieces_sql('doc')} AS ps FROM sp),
pc AS (SELECT piece, count(*) AS cnt FROM (SELECT unnest(ps) AS piece FROM dp) GROUP BY piece),
t0 AS (
  SELECT list(struct_pack(p := piece, y := '|' || array_to_string(list_transform(range(strlen(piece)),
           lambda i: CAST(CAST(('0x' || substr(hex(encode(piece)), 2 * i + 1, 2)) AS INTEGER) + 1 AS VARCHAR)),
           '||') || '|', c := cnt)) AS ys
  FROM pc),
st(it, ys, l, r, c) AS (
  SELECT 0, ys, NULL::INTEGER, NULL::INTEGER, NULL::BIGINT FROM t0
  UNION ALL
  SELECT st.it + 1,
         list_transform(st.ys, lambda e: struct_pack(
           p := e.p, y := replace(e.y, '|' || b.l || '||' || b.r || '|', '|' || (257 + st.it) || '|'),
           c := e.c)),
         b.l, b.r, b.c
  FROM st, LATERAL (
    SELECT pp.l AS l, pp.r AS r, sum(pp.c) AS c FROM (
      SELECT unnest(list_transform(range(1, len(sy)), lambda i: struct_pack(
               l := CAST(sy[i] AS INTEGER), r := CAST(sy[i + 1] AS INTEGER), c := ec))) AS pp
      FROM (SELECT string_split(substr(e.y, 2, length(e.y) - 2), '||') AS sy, e.c AS ec
            FROM (SELECT unnest(st.ys) AS e)))
    GROUP BY pp.l, pp.r HAVING sum(pp.c) >= 2
    ORDER BY c DESC, l, r LIMIT 1) b
  WHERE st.it < {N_MERGES})"""

BPE_SQL = BPE_CTE + """
SELECT CAST(it - 1 AS INTEGER) AS rank, l AS left, r AS right, CAST(256 + it AS INTEGER) AS new_id,
       CAST(c AS BIGINT) AS pair_count
FROM st WHERE it > 0"""

SEG_CTE = BPE_CTE + f""",
seg AS (SELECT vocab, e.p AS piece, e.y AS y, len(string_split(substr(e.y, 2, length(e.y) - 2), '||')) AS k
        FROM (SELECT 257 + it AS vocab, unnest(ys) AS e FROM st WHERE it IN ({', '.join(str(v - 257) for v in QUERY_VOCABS)}))),
occ AS (SELECT doc_id, split, start_byte, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM dp)"""

# Ids of every document in order, by each vocabulary, and neighbours within a document.
IDS_CTE = SEG_CTE + """,
ids AS (SELECT vocab, doc_id, split, start_byte, pos, i, CAST(string_split(substr(y, 2, length(y) - 2), '||')[i] AS INTEGER) AS id
        FROM (SELECT seg.vocab, occ.doc_id, occ.split, occ.start_byte, occ.pos, seg.y, unnest(range(1, seg.k + 1)) AS i
              FROM occ JOIN seg USING (piece))),
nx AS (SELECT *, lead(id) OVER (PARTITION BY vocab, doc_id ORDER BY pos, i) AS nxt FROM ids),
uni AS (SELECT vocab, split, id, count(*) AS c FROM ids GROUP BY ALL),
bi AS (SELECT vocab, split, id AS prv, nxt, count(*) AS c FROM nx WHERE nxt IS NOT NULL GROUP BY ALL),
nt AS (SELECT vocab, sum(c) AS n FROM uni WHERE split = 'train' GROUP BY vocab),
ul AS (SELECT v.vocab, sum(v.c * -ln((coalesce(t.c, 0) + 1) / (nt.n + v.vocab))) / sum(v.c) AS unigram_loss, sum(v.c) AS n_val
       FROM uni v JOIN nt ON nt.vocab = v.vocab LEFT JOIN uni t ON t.vocab = v.vocab AND t.id = v.id AND t.split = 'train'
       WHERE v.split = 'val' GROUP BY v.vocab),
cx AS (SELECT vocab, prv, sum(c) AS c FROM bi WHERE split = 'train' GROUP BY ALL),
bl2 AS (SELECT v.vocab, sum(v.c * -ln((coalesce(t.c, 0) + 1) / (coalesce(cx.c, 0) + v.vocab))) / sum(v.c) AS bigram_loss
       FROM bi v LEFT JOIN bi t ON t.vocab = v.vocab AND t.prv = v.prv AND t.nxt = v.nxt AND t.split = 'train'
       LEFT JOIN cx ON cx.vocab = v.vocab AND cx.prv = v.prv WHERE v.split = 'val' GROUP BY v.vocab)"""


def _probe_cte(name: str, texts: list[str]) -> str:
    """Tokens of some texts by each vocabulary: the merges applied in rank order."""
    values = ", ".join("('" + t.replace("'", "''") + "')" for t in texts)
    return f""",
{name}_p AS (SELECT t, unnest({pieces_sql('t')}) AS piece FROM (VALUES {values}) x(t)),
{name} AS (
  SELECT v.vocab, t, sum(len(string_split(list_reduce(list_prepend(
           '|' || array_to_string(list_transform(range(strlen(piece)),
             lambda i: CAST(CAST(('0x' || substr(hex(encode(piece)), 2 * i + 1, 2)) AS INTEGER) + 1 AS VARCHAR)), '||') || '|',
           (SELECT list('|' || l || '||' || r || '|>|' || (256 + it) || '|' ORDER BY it) FROM st WHERE it BETWEEN 1 AND v.vocab - 257)),
           lambda y, m: replace(y, string_split(m, '>')[1], string_split(m, '>')[2])), '||'))) AS n
  FROM {name}_p, (SELECT DISTINCT vocab FROM seg) v GROUP BY v.vocab, t)"""


STUDY_CTE = IDS_CTE + _probe_cte("cm", COMPOUNDS) + _probe_cte("sn", [SAMPLE_SENTENCE]) + rf""",
wd AS (SELECT sum(len(regexp_extract_all(doc, '[^\s]+'))) AS n_words, sum(n_bytes) AS n_bytes, sum(length(doc)) AS n_chars FROM dp),
tt AS (SELECT vocab, count(*) AS n FROM ids GROUP BY vocab),
-- 5 layers of width 256: 4,016,896 parameters beside the embedding, which is tied
study AS (
  SELECT CAST(tt.vocab AS INTEGER) AS vocab, 4016896 + 256 * tt.vocab AS params, 256 * tt.vocab AS embed_params,
         round(256 * tt.vocab / (4016896 + 256 * tt.vocab), 9) AS embed_share, round(tt.n / wd.n_words, 9) AS fertility,
         round(c.m, 9) AS tokens_per_compound,
         round(256.0::DOUBLE * {len(SAMPLE_SENTENCE.split())} / s.n, 9) AS words_per_256,
         round(wd.n_bytes / tt.n, 9) AS bytes_per_token, round(wd.n_chars / tt.n, 9) AS chars_per_token,
         round(bl2.bigram_loss, 9) AS val_loss, round(bl2.bigram_loss / ln(2) / (wd.n_bytes / tt.n), 9) AS bits_per_byte,
         round(bl2.bigram_loss / ln(2) / (wd.n_chars / tt.n), 9) AS bits_per_char, round(ln(tt.vocab), 9) AS uniform_loss
  FROM tt, wd, bl2, (SELECT vocab, avg(n) AS m FROM cm GROUP BY vocab) c, sn s
  WHERE bl2.vocab = tt.vocab AND c.vocab = tt.vocab AND s.vocab = tt.vocab)"""


def windows_cte(split: str, steps: int = WINDOW_STEPS, seed: int = TRAIN_SEED) -> str:
    """The stream of one split as a list of ids; starts from the md5 uniforms."""
    return IDS_CTE + f""",
sl AS (SELECT list(id ORDER BY start_byte, pos, i) AS a, count(*) AS n FROM ids WHERE vocab = {QUERY_VOCABS[-1]} AND split = '{split}'),
lo AS (SELECT CASE WHEN '{split}' = 'train' THEN 0 ELSE (SELECT count(*) FROM ids WHERE vocab = {QUERY_VOCABS[-1]} AND split = 'train') END AS at0),
wn AS (SELECT CAST(k // {WINDOW_BATCH} AS BIGINT) AS step, CAST(k % {WINDOW_BATCH} AS BIGINT) AS slot
       FROM (SELECT unnest(range({steps * WINDOW_BATCH})) AS k)),
wu AS (SELECT step, slot, CAST(floor(CAST(CAST('0x' || substr(md5({seed} || '|' || step || '|' || slot), 1, 13) AS BIGINT) AS DOUBLE)
              / 4503599627370496.0 * (n - {WINDOW_BLOCK})) AS BIGINT) AS off FROM wn, sl)"""


def windows_sql(split: str) -> str:
    return windows_cte(split) + f"""
SELECT step, slot, CAST(at0 + off AS BIGINT) AS start_pos, {WINDOW_BLOCK} AS n_x,
       array_to_string(a[off + 1 : off + {WINDOW_BLOCK}], ',') AS x, array_to_string(a[off + 2 : off + {WINDOW_BLOCK} + 1], ',') AS y
FROM wu, sl, lo"""


def _symbols(piece: str) -> str:
    """The byte symbols of a piece."""
    return (f"'|' || array_to_string(list_transform(range(strlen({piece})), lambda i: CAST(CAST(('0x' || "
            f"substr(hex(encode({piece})), 2 * i + 1, 2)) AS INTEGER) + 1 AS VARCHAR)), '||') || '|'")


def _merged(y: str, merges: str) -> str:
    """Symbols after a list of merges ``|l||r|>|new|``, one after the other."""
    return f"list_reduce(list_prepend({y}, {merges}), lambda y, m: replace(y, string_split(m, '>')[1], string_split(m, '>')[2]))"


MERGE_LIST = "list('|' || l || '||' || r || '|>|' || (256 + it) || '|' ORDER BY it)"
UTF8 = ("C[2-9A-F][89AB][0-9A-F]|D[0-9A-F][89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]|E[1-9A-CEF][89AB][0-9A-F][89AB][0-9A-F]|"
        "F[0-4][89AB][0-9A-F][89AB][0-9A-F][89AB][0-9A-F]|[0-7][0-9A-F]")

# Bytes of every id as hex, and texts cut into the decoded and stripped ids of each vocabulary. Bytes that make no character are one
# replacement sign each, which is the rule for characters of two bytes cut in half; the probes hold no longer ones.
HEX_CTE = f""",
hx(it, hs) AS (
  SELECT 0, list_concat([hex(encode('{END_OF_TEXT}'))], list_transform(range(256), lambda b: printf('%02X', b)))
  UNION ALL
  SELECT hx.it + 1, list_append(hx.hs, hx.hs[st.l + 1] || hx.hs[st.r + 1]) FROM hx JOIN st ON st.it = hx.it + 1),
hl AS (SELECT hs FROM hx ORDER BY it DESC LIMIT 1),
vm AS (SELECT v.vocab, (SELECT {MERGE_LIST} FROM st WHERE it BETWEEN 1 AND v.vocab - 257) AS ms
       FROM (VALUES {', '.join(f'({v})' for v in QUERY_VOCABS)}) v(vocab))"""


def splits_cte(name: str, source: str) -> str:
    """``vocab, k, n, parts`` of the texts ``k, t`` in ``source``."""
    char = (f"array_to_string(list_transform(regexp_extract_all(h, '{UTF8}|..'), lambda c: CASE WHEN regexp_full_match(c, '{UTF8}') "
            "THEN decode(unhex(c)) ELSE chr(65533) END), '')")
    return rf""",
{name}_p AS (SELECT k, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM (SELECT k, {pieces_sql('t')} AS ps FROM ({source}))),
{name}_s AS (SELECT vocab, piece, string_split(trim(y, '|'), '||') AS sy
             FROM (SELECT vm.vocab, piece, {_merged(_symbols('piece'), 'vm.ms')} AS y FROM (SELECT DISTINCT piece FROM {name}_p), vm)),
{name} AS (SELECT vocab, k, sum(len(sy)) AS n, flatten(list(list_transform(sy, lambda i: hs[CAST(i AS INTEGER) + 1]) ORDER BY pos)) AS hex
           FROM {name}_p JOIN {name}_s USING (piece), hl GROUP BY vocab, k),
{name}_d AS (SELECT vocab, k, n, list_transform(hex, lambda h: regexp_replace({char}, '^\s+|\s+$', '', 'g')) AS parts FROM {name})"""


def _configs_sql() -> str:
    return ", ".join(f"('{c[0]}', {c[4]}, {c[6]}, {c[7]})" for c in CONFIGS)


ORACLE = {
    "piece_counts": f"WITH {PIECES_CTE} SELECT piece, cnt FROM pc",

    "bpe_merges": BPE_SQL,
    "stream_pieces": f"""
WITH {split_cte(None, dirtied=False)},
tx AS (SELECT string_agg(doc, '' ORDER BY start_byte) AS doc FROM sp)
SELECT piece, count(*) AS cnt FROM (SELECT unnest({pieces_sql('doc')}) AS piece FROM tx) GROUP BY piece""",
    "context_tokens": BPE_CTE + f""",
ml AS (SELECT {MERGE_LIST} AS ms FROM st WHERE it > 0),
ct AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
cp AS (SELECT conv_id, regexp_extract_all(CASE WHEN left(text, 1) = ' ' THEN text ELSE ' ' || text END, '{DUCK_PATTERN}') AS ps FROM ct),
cw AS (SELECT conv_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM cp),
sg AS (SELECT piece, string_split(trim({_merged(_symbols('piece'), 'ms')}, '|'), '||') AS sy FROM (SELECT DISTINCT piece FROM cw), ml),
al AS (SELECT conv_id, flatten(list(sy ORDER BY pos)) AS a FROM cw JOIN sg USING (piece) GROUP BY conv_id)
SELECT conv_id, least(len(a), {CONTEXT_PIECES}) AS n_context,
       md5(array_to_string(list_slice(a, len(a) - least(len(a), {CONTEXT_PIECES}) + 1, len(a)), ',')) AS context_md5 FROM al""",
    "probe_splits": BPE_CTE + HEX_CTE + splits_cte("bs", "SELECT item_id AS k, text AS t FROM benchmark") + """
SELECT CAST(vocab AS INTEGER) AS vocab, k AS item_id, CAST(n AS INTEGER) AS n_tokens, array_to_string(parts, ' · ') AS pieces FROM bs_d""",
    "vocab_stats": STUDY_CTE + HEX_CTE + splits_cte("cs", "SELECT t AS k, t FROM (VALUES " + ", ".join(
        f"('{c}')" for c in COMPOUNDS) + ") x(t)") + """,
js AS (SELECT vocab, '{' || string_agg('"' || k || '":["' || array_to_string(parts, '","') || '"]', ',' ORDER BY k) || '}' AS splits
       FROM cs_d GROUP BY vocab)
SELECT vocab AS vocab_size, round(fertility, 3) AS fertility, round(tokens_per_compound, 2) AS tokens_per_compound,
       round(words_per_256, 1) AS german_words_per_256_tokens, splits AS compound_splits
FROM study JOIN js USING (vocab)""",
    "encode_docs": SEG_CTE + f"""
, tk AS (SELECT doc_id, any_value(split) AS split, any_value(start_byte) AS start_byte, CAST(sum(k) AS BIGINT) AS n_tokens,
                md5(string_agg(y, '' ORDER BY pos)) AS tokens_md5
         FROM occ JOIN seg USING (piece) WHERE vocab = {QUERY_VOCABS[-1]} GROUP BY doc_id)
SELECT doc_id, split, start_byte, CAST(coalesce(sum(n_tokens) OVER (ORDER BY start_byte
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos, n_tokens, tokens_md5
FROM tk""",
    "token_totals": SEG_CTE + """
SELECT split, CAST(vocab AS INTEGER) AS vocab, CAST(sum(k) AS BIGINT) AS n_tokens
FROM occ JOIN seg USING (piece) GROUP BY GROUPING SETS ((split, vocab), (vocab))""",
    "fertility": SEG_CTE + r"""
, wd AS (SELECT sum(len(regexp_extract_all(doc, '[^\s]+'))) AS n_words, count(*) AS n FROM dp)
SELECT CAST(vocab AS INTEGER) AS vocab, round(sum(k) / any_value(wd.n_words), 9) AS fertility, any_value(wd.n) AS sample_docs
FROM occ JOIN seg USING (piece), wd GROUP BY vocab""",
    "context_words": SEG_CTE + rf"""
, tk AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_tokens
         FROM occ JOIN seg USING (piece) WHERE vocab = {QUERY_VOCABS[-1]} GROUP BY doc_id)
SELECT doc_id, n_tokens, round(256.0::DOUBLE * len(regexp_extract_all(doc, '[^\s]+')) / n_tokens, 6) AS words_per_256
FROM tk JOIN dp USING (doc_id)""",
    "ngram_loss": IDS_CTE + """
SELECT CAST(vocab AS INTEGER) AS vocab, round(bigram_loss, 9) AS val_loss, round(unigram_loss, 9) AS unigram_loss, CAST(n_val AS BIGINT) AS n_val
FROM ul JOIN bl2 USING (vocab)""",
    "vocab_study": STUDY_CTE + " SELECT * FROM study",
    "study_winners": STUDY_CTE + """
SELECT arg_min(vocab, val_loss) AS best_by_loss, arg_min(vocab, bits_per_byte) AS best_by_bits,
       arg_min(vocab, val_loss) <> arg_min(vocab, bits_per_byte) AS disagree FROM study""",
    "eval_batches": windows_cte("val", EVAL_BATCHES, EVAL_SEED) + f""",
xy AS (SELECT step, unnest(a[off + 1 : off + {WINDOW_BLOCK}]) AS prv, unnest(a[off + 2 : off + {WINDOW_BLOCK} + 1]) AS nxt FROM wu, sl),
lb AS (SELECT step, count(*) AS n_tokens,
              avg(-ln((coalesce(t.c, 0) + 1) / (coalesce(cx.c, 0) + {QUERY_VOCABS[-1]}))) AS mean_loss
       FROM xy LEFT JOIN bi t ON t.vocab = {QUERY_VOCABS[-1]} AND t.split = 'train' AND t.prv = xy.prv AND t.nxt = xy.nxt
       LEFT JOIN cx ON cx.vocab = {QUERY_VOCABS[-1]} AND cx.prv = xy.prv GROUP BY step)
SELECT step, n_tokens, round(mean_loss, 9) AS mean_loss FROM lb
UNION ALL SELECT NULL, CAST(sum(n_tokens) AS BIGINT), round(avg(mean_loss), 9) FROM lb""",
    "train_windows": windows_sql("train"),
    "val_windows": windows_sql("val"),
    "run_budget": SEG_CTE + f"""
, tr AS (SELECT CAST(sum(k) AS BIGINT) AS n FROM occ JOIN seg USING (piece) WHERE vocab = {QUERY_VOCABS[-1]} AND split = 'train')
SELECT name, CAST(block * batch AS BIGINT) AS tokens_per_step, CAST(block * batch * steps AS BIGINT) AS total_tokens, tr.n AS train_tokens,
       round(block * batch * steps / tr.n, 6) AS epochs, tr.n >= block + 1 AS enough_tokens
FROM (VALUES {_configs_sql()}) c(name, block, batch, steps), tr""",
    "heldout_loss": """
SELECT label AS target, count(*) AS n, round(avg(m + ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - m)))) - embedding[label + 1]), 5)
         AS mean_loss
FROM (SELECT label, embedding, list_max(embedding)::DOUBLE AS m FROM embeddings) GROUP BY label""",

    "byte_histogram": f"""
WITH {PIECES_CTE}
SELECT byte, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT cnt, unnest(b) AS byte FROM bl) GROUP BY byte""",

    "pair_counts": f"""
WITH {PIECES_CTE},
pr AS (
  SELECT cnt, unnest(list_transform(range(len(b) - 1),
                     lambda i: struct_pack(l := b[i + 1] + 1, r := b[i + 2] + 1))) AS p
  FROM bl WHERE len(b) > 1)
SELECT p.l AS left, p.r AS right, CAST(sum(cnt) AS BIGINT) AS cnt FROM pr GROUP BY p.l, p.r""",

    "context_window": f"""
WITH ct AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
p AS (
  SELECT conv_id, regexp_extract_all(CASE WHEN left(text, 1) = ' ' THEN text ELSE ' ' || text END,
                                     '{DUCK_PATTERN}') AS ps FROM ct)
SELECT conv_id, len(ps) AS n_pieces, least(len(ps), {CONTEXT_PIECES}) AS n_context,
       md5(array_to_string(list_slice(ps, len(ps) - least(len(ps), {CONTEXT_PIECES}) + 1, len(ps)), ''))
         AS context_md5
FROM p""",

    "decode_roundtrip": f"""
WITH {split_cte(None, dirtied=False)}
SELECT doc_id, length(' ' || doc) AS n_chars, md5(' ' || doc) AS text_md5 FROM sp""",
}
