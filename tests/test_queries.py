"""Registered queries against their DuckDB oracle SQL on the smallest tables,
guards, partition independence and stream = batch."""

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

import __spark_entry__ as E
from conftest import SF_SMALL
from harness import compare

ORACLE = E.oracle_sql()
QUERIES = E.queries()
# The training-data queries have tests of their own.
FAST = [k for k in ORACLE if not k.startswith("op")]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, name):
    compare(spark, name, SF_SMALL, QUERIES[name], ORACLE[name])


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "kept" in df.columns


def test_missing_input_raises(spark):
    with pytest.raises(AnalysisException):
        QUERIES["corpus_summary"](spark, "/root/testdata/does-not-exist")


def test_offsets_independent_of_partitions(spark):
    from tokloom.operators.corpus import build_corpus
    from tokloom.sources.tables import read_shards
    outs = []
    for p in (1, 7, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(p))
        o = build_corpus(read_shards(spark, SF_SMALL), batch_rows=7)["offsets"]
        outs.append(sorted(tuple(r) for r in o.select("doc_id", "batch_id", "start_byte", "split").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert outs[0] == outs[1] == outs[2]
    starts = sorted((r[2], r[0]) for r in outs[0])
    sizes = {r["doc_id"]: r["n_bytes"] for r in
             build_corpus(read_shards(spark, SF_SMALL), batch_rows=7)["offsets"].collect()}
    pos = 0
    for s, d in starts:            # offsets are gapless
        assert s == pos
        pos += sizes[d]


TOKENS = "start_pos long, n_tokens int, ids array<int>"


def test_windows_guard(spark):
    from tokloom.operators.windows import sample_windows
    t = spark.createDataFrame([(0, 3, [1, 2, 3])], TOKENS)
    with pytest.raises(ValueError):
        sample_windows(t, 1, 1, block=3)
    w = sample_windows(t, 2, 2, block=2).collect()
    assert all(r["x"] == [1, 2] and r["y"] == [2, 3] for r in w)


def test_windows_of_a_stream_that_starts_later(spark):
    from tokloom.operators.windows import sample_windows
    docs, at = [], 100
    for n in (3, 1, 40, 0, 7, 250, 2):
        docs.append((at, n, list(range(at, at + n))))
        at += n
    t = spark.createDataFrame(docs, TOKENS)
    w = sample_windows(t, 8, 4, block=16, chunk=8).collect()
    assert len(w) == 32
    for r in w:
        assert 100 <= r["start_pos"] <= at - 17
        assert r["x"] == list(range(r["start_pos"], r["start_pos"] + 16))
        assert r["y"] == [i + 1 for i in r["x"]]


def test_windows_over_a_gap_fail(spark):
    from tokloom.operators.windows import sample_windows
    t = spark.createDataFrame([(0, 3, [1, 2, 3]), (90, 3, [1, 2, 3])], TOKENS)
    with pytest.raises(Exception, match="lacks tokens"):
        sample_windows(t, 4, 4, block=5).collect()


def test_stream_resumes_from_checkpoint(spark, tmp_path):
    """A restarted stream reads only the files it has not seen."""
    import shutil
    from tokloom.streaming.streams import stream_corpus_filter
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{SF_SMALL}/documents.parquet", src / "documents.parquet")
    spark.read.parquet(str(src / "documents.parquet")).withColumn("doc_id", F.col("doc_id") + 100000) \
        .write.parquet(str(tmp_path / "extra"))
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    first = stream_corpus_filter(spark, str(src), out, chk, pattern="documents*").count()
    part = next(p for p in (tmp_path / "extra").iterdir() if p.suffix == ".parquet")
    shutil.copy(part, src / "documents-more.parquet")
    second = stream_corpus_filter(spark, str(src), out, chk, pattern="documents*").count()
    assert second == 2 * first
    assert spark.read.parquet(out).select("doc_id").distinct().count() == second


NO_ORACLE = [k for k in QUERIES if k not in ORACLE and not k.startswith("op") and k != "pipeline"]


@pytest.mark.parametrize("name", NO_ORACLE)
def test_query_without_oracle_runs(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows
    if name.endswith("_windows"):
        assert len(rows) == 32 and all(r["n_x"] == 64 for r in rows)
        assert all(r["x"].split(",")[1:] == r["y"].split(",")[:-1] for r in rows)


def test_study_matches_counts(spark):
    """Losses of the count models recomputed from the stored ids."""
    import math
    from collections import Counter
    from tokloom.plans.tokenizer_plans import doc_tokens
    got = {r["vocab"]: r for r in QUERIES["ngram_loss"](spark, SF_SMALL).collect()}
    rows = doc_tokens(spark, SF_SMALL, 289).select("split", "ids").collect()
    uni, bi = Counter(), Counter()
    for r in rows:
        if r["split"] == "train":
            uni.update(r["ids"])
            bi.update(zip(r["ids"], r["ids"][1:]))
    ctx = Counter()
    for (a, _), c in bi.items():
        ctx[a] += c
    val = [r["ids"] for r in rows if r["split"] == "val"]
    n = sum(uni.values())
    u = [-math.log((uni[i] + 1) / (n + 289)) for ids in val for i in ids]
    b = [-math.log((bi[p] + 1) / (ctx[p[0]] + 289)) for ids in val for p in zip(ids, ids[1:])]
    assert got[289]["n_val"] == len(u)
    assert got[289]["unigram_loss"] == pytest.approx(sum(u) / len(u), abs=1e-8)
    assert got[289]["val_loss"] == pytest.approx(sum(b) / len(b), abs=1e-8)


def test_two_vocabularies_in_one_store(spark, tmp_path):
    from tokloom.sources.sinks import read_tokens, write_tokens
    for v in (289, 321, 289):
        write_tokens(spark.createDataFrame([(v, "train", [v])], "vocab int, split string, ids array<int>"), str(tmp_path / "t"))
    assert [read_tokens(spark, str(tmp_path / "t"), v, "train").first()["ids"] for v in (289, 321)] == [[289], [321]]


def test_history_keeps_append_order_and_resumes(spark, tmp_path):
    from tokloom.sources.sinks import append_history, read_history, resumed_history
    path = str(tmp_path / "h")
    schema = "step int, train double, val double, elapsed double"
    for rows in ([(10, 3.0, 3.1, 1.0), (20, 2.0, 2.1, 2.0)], [(20, 2.5, 2.6, 0.5), (30, 1.5, 1.6, 1.5)], [(40, 1.0, 1.1, 3.0)]):
        append_history(spark.createDataFrame(rows, schema), path)
    h = read_history(spark, path)
    order = [r["step"] for r in h.orderBy("appended", "place").collect()]
    assert order == [10, 20, 20, 30, 40]
    got = [(r["step"], r["val"], r["elapsed"]) for r in resumed_history(h).orderBy("step").collect()]
    assert got == [(10, 3.1, 1.0), (20, 2.6, 1.5), (30, 1.6, 2.5), (40, 1.1, 4.0)]


@pytest.mark.parametrize("decay", [0.0, 0.05, 0.9, 0.999])
def test_moving_average_at_any_decay(spark, decay):
    from tokloom.operators.runs import loss_ema
    values = [None, 5.0] + [float((i * 37) % 11) for i in range(300)] + [None, 2.0]
    log = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate(values)] + [(2, 1, 7.0)], "run_id int, k long, val double")
    got = {(r["run_id"], r["k"]): r["ema"] for r in loss_ema(log, decay=decay, block=16).collect()}
    ema = None
    for k, v in enumerate(values):
        if v is not None:
            ema = v if ema is None else decay * ema + (1 - decay) * v
        assert got[1, k + 1] == (None if ema is None else pytest.approx(ema, rel=1e-12))
    assert got[2, 1] == 7.0


def test_best_step_skips_null_and_anomalies_count_nan(spark):
    from tokloom.operators.runs import power_fit, run_anomalies, run_summary
    nan, inf = float("nan"), float("inf")
    log = spark.createDataFrame([(1, 10, 1, None, 1.0, 0.0), (1, 20, 2, 3.0, nan, 1.0), (1, 30, 3, 4.0, 1.0, 2.0),
                                 (2, 10, 1, 2.0, 1.0, 0.0), (2, 20, 2, inf, 1.0, 1.0)],
                                "run_id int, step int, k long, val double, train double, elapsed double")
    assert run_summary(log.where("run_id = 1")).first()["best_step"] == 20
    bad = {r["run_id"]: (r["n_nonfinite"], r["first_bad_step"]) for r in run_anomalies(log).collect()}
    assert bad == {1: (1, 20), 2: (1, 20)}
    pts = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 1.0), (1, 0.0, 1.0), (1, None, 1.0)], "g int, x double, y double")
    assert power_fit(pts, "g", "x", "y").first()["n_dropped"] == 2


def test_seen_ids_count_once(spark):
    from tokloom.operators.scoring import apply_penalty
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, -2.0), (1, 2, 1.0)], "req_id int, token_id int, score double")
    seen = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 1)], "req_id int, token_id int")
    once = {r["token_id"]: r["penalised"] for r in apply_penalty(s, seen.distinct(), 2.0).collect()}
    twice = {r["token_id"]: r["penalised"] for r in apply_penalty(s, seen, 2.0).collect()}
    assert once == twice == {0: 1.0, 1: -4.0, 2: 1.0}


def test_next_token_choice(spark):
    from tokloom.operators.scoring import sample_next
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.9), (2, 0, 0.0), (2, 1, 5.0)], "req_id int, token_id int, score double")
    seen = spark.createDataFrame([(1, 0)], "req_id int, token_id int")
    greedy = {r["req_id"]: r["token_id"] for r in sample_next(s, seen, 0.0, 0, 0.0, 2.0).collect()}
    assert greedy == {1: 1, 2: 1}
    top = {r["req_id"]: r["token_id"] for r in sample_next(s, seen, 1.0, 1, 0.0, 2.0).collect()}
    assert top == greedy


def test_stream_replay_does_not_double(spark, tmp_path):
    """The sink's batch was written but its commit was lost: the batch is played again."""
    import shutil
    from tokloom.streaming.streams import stream_corpus_filter, stream_run_summary
    for name, run in (("documents", stream_corpus_filter), ("events", stream_run_summary)):
        src = tmp_path / name
        src.mkdir()
        shutil.copy(f"{SF_SMALL}/{name}.parquet", src / f"{name}.parquet")
        out, chk = str(tmp_path / f"{name}-out"), tmp_path / f"{name}-chk"
        first = sorted(map(str, run(spark, str(src), out=out, chk=str(chk)).collect()))
        last = max((p for p in (chk / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        assert sorted(map(str, run(spark, str(src), out=out, chk=str(chk)).collect())) == first


def test_late_rows_are_not_counted(spark, tmp_path):
    import time
    from tokloom.streaming.streams import stream_event_rates, stream_sessions
    src = tmp_path / "in"
    src.mkdir()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for k, day in enumerate(("10", "20", "21", "11")):
        row = spark.sql(f"select {k}L, timestamp_ntz'2024-01-{day} 00:10:00', 1L, 'a', 1.0D, '{{}}'").toDF(*[c.split()[0] for c in schema.split(", ")])
        row.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        part = next(p for p in (tmp_path / f"p{k}").iterdir() if p.suffix == ".parquet")
        part.rename(src / f"events{k}.parquet")
        time.sleep(1.1)      # files are taken in order of their time
        (src / f"events{k}.parquet").touch()
    got = {r["w"]["start"].day: r["n"] for r in stream_event_rates(spark, str(src)).collect()}
    assert got == {10: 1, 20: 1, 21: 1}               # the row of the 11th came when the watermark had passed it
    assert [r["w"]["start"].day for r in stream_sessions(spark, str(src)).collect()] == [10]


def test_no_local_scratch_on_a_cluster(monkeypatch):
    from types import SimpleNamespace
    from tokloom.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="yarn"))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(spark)


def test_context_of_odd_conversations(spark):
    """Parts cut at white space give the pieces of the whole text, whatever the turns hold."""
    from tokloom.functions.text import pieces
    from tokloom.operators.windows import conversation_context
    rows = [(1, 0, " a b "), (1, 1, None), (1, 2, "  "), (1, 3, "\n c's\t"), (1, 4, ""), (1, 5, "d  "), (1, 6, " \n"),
            (2, 0, ""), (3, 0, " "), (3, 1, "x"), (4, 0, None), (None, 1, "u v"), (None, 0, "w "), (None, 2, " y z"),
            (5, 0, "e f "), (5, 0, "e f "), (5, 1, "g")] + [(6, i, f"turn {i}, 'll  do　") for i in range(300)]
    schema = "conv_id long, turn int, text string"
    texts = {}
    for c, _, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        texts.setdefault(c, []).extend([] if t is None else [t])
    whole = spark.createDataFrame([(c, "\n".join(t)) for c, t in texts.items()], "conv_id long, text string")
    want = {r["conv_id"]: r["p"] for r in whole.select("conv_id", pieces("text").alias("p")).collect()}
    conv = spark.createDataFrame(rows, schema).repartition(5).selectExpr("*", "'x' as part", "1 as n", "'y' as s")
    for n in (1, 3, 40):
        got = {r["conv_id"]: (r["n_total"], r["n_context"], r["context"]) for r in conversation_context(conv, n).collect()}
        assert got == {c: (len(p), min(n, len(p)), p[-n:]) for c, p in want.items()}
    assert conversation_context(conv.where("false"), 5).count() == 0
