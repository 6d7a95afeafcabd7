"""Tables as users have them: null groups, sources of any name, ids that repeat."""

import pytest
from pyspark.sql import functions as F

from tokloom.operators.corpus import build_corpus
from tokloom.operators.ordering import rank_within, running_agg
from tokloom.sources.tables import OTHER_SHARDS, as_shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("b", 5)], "g string, o int")
    got = sorted((r["g"] or "", r["o"], r["k"]) for r in rank_within(df, ["g"], ["o"], "k").collect())
    assert got == [("", 1, 1), ("", 2, 2), ("a", 1, 1), ("b", 5, 1)]
    two = spark.createDataFrame([(None, None, i) for i in range(50)] + [(1, None, 3)], "g int, h int, o int")
    s = running_agg(two, ["g", "h"], ["o"], "o", "s", "max", num_partitions=5)
    assert sorted(r["s"] for r in s.where("g is null and s is not null").collect()) == list(range(49)) and s.count() == 51


def test_runs_without_an_id_are_a_run(spark):
    from tokloom.operators import runs
    rows = [(u, k, 10 * k, float(k), 1.0, float(k), "view") for u in (None, 1) for k in range(1, 41)]
    log = spark.createDataFrame(rows, "run_id long, k long, step long, val double, train double, elapsed double, event_type string")
    for f in (lambda x: runs.loss_ema(x, block=8), runs.best_so_far, runs.run_throughput, runs.with_previous,
              lambda x: runs.lr_audit(x, 1e-3, 5)):
        out = f(log)
        assert out.count() == 80 and out.where("run_id is null").count() == 40
    ema = {(r["run_id"], r["k"]): r["ema"] for r in runs.loss_ema(log, block=8).collect()}
    assert all(ema[None, k] == ema[1, k] for k in range(1, 41))
    assert runs.overfit_onset(log).count() == 2


def prose(i):
    return "\n".join(f"sentence number {i} of line {j}, which is long enough to be counted as prose" for j in range(12))


def test_any_source_is_a_shard(spark):
    names = ["src2", "src10", "web", "src07", "SRC3", None, "", "src99999999999", "https://é"]
    rows = [(i, prose(i), "en", names[i % len(names)], 0) for i in range(90)]
    got = as_shards(spark.createDataFrame(rows, DOCS)).select("shard", "title").collect()
    assert len(got) == 90
    shards = {r["title"].rsplit("/", 1)[0] if "/" in r["title"] else None: r["shard"] for r in got}
    assert shards["src2"] == 2 and shards["src10"] == 10 and shards[None] == OTHER_SHARDS + 6
    rest = sorted((n for n in names if n is not None and n not in ("src2", "src10")), key=lambda n: n.encode())
    assert [shards[n] for n in rest] == [OTHER_SHARDS + i for i in range(6)]
    corpus = build_corpus(as_shards(spark.createDataFrame(rows, DOCS)), batch_rows=4)["corpus"]
    assert corpus.count() == 90 and corpus.select("doc_id").distinct().count() == 90


@pytest.mark.parametrize("parts", [1, 6])
def test_ids_may_repeat(spark, parts):
    rows = [(1, prose(i), "en", f"src{i % 5}", 0) for i in range(10)] + [(2, prose(50), "en", "src0", 0)] * 3
    rows += [(None, prose(60), "en", "src1", 0), (None, None, "en", "src1", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    built = build_corpus(as_shards(docs), batch_rows=2)
    got = built["corpus"].orderBy("start_byte").collect()
    assert sorted(r["doc"] for r in got) == sorted(f"= {s}{'' if d is None else '/' + str(d)} =\n\n{t}\n\n" for d, t, _, s, _ in rows if t)
    at = 0
    for r in got:
        assert r["start_byte"] == at
        at += r["n_bytes"]
    assert built["offsets"].count() == 14 and built["labelled"].count() == 15
    assert [(r["shard"], r["doc_id"] or -1) for r in got] == sorted((int(s[3:]), d or -1) for d, t, _, s, _ in rows if t)


def test_configurations_are_read_by_schema(spark, tmp_path):
    """Unknown keys are ignored, missing ones filled, and what is written is read back."""
    from tokloom.operators.study import configs_table, read_configs
    from tokloom.sources.sinks import write_configs
    (tmp_path / "one.json").write_text('{"name": "x", "n_layers": 2, "n_heads": 2, "n_embd": 64,\n "not_a_key": 1}')
    r = read_configs(spark, str(tmp_path / "one.json")).first()
    assert (r["name"], r["n_layers"], r["rope_base"], r["vocab_size"]) == ("x", 2, 10000, None) and "not_a_key" not in r.asDict()
    write_configs(configs_table(spark), str(tmp_path / "all"))
    assert sorted(map(tuple, read_configs(spark, str(tmp_path / "all")).collect())) == sorted(map(tuple, configs_table(spark).collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_configs(spark, str(tmp_path / "none.json"))


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest imports without them; a module that they need and that is missing is an error."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tokloom"), tmp_path / "tokloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
    os.makedirs(tmp_path / "tokloom" / "llm")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120, capture_output=True).returncode != 0
