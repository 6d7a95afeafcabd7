"""Published values of the reference reproduced from its formulas."""

import math

import pytest
from pyspark.sql import functions as F

from tokloom.functions.numeric import lr_at, model_params, perplexity
from tokloom.operators import study as ST

# Published study rows: vocab, params, embed_params, embed_share, chars_per_token, val_loss, bits_per_char
STUDY = [
    (4096, 5065472, 1048576, 0.2070045989791277, 3.294, 3.678, 1.6109),
    (8192, 6114048, 2097152, 0.3430054850730645, 3.743, 4.1711, 1.6079),
    (16384, 8211200, 4194304, 0.5108028059236165, 4.189, 4.5508, 1.5674),
    (32768, 12405504, 8388608, 0.6762004993912379, 4.604, 5.0584, 1.585),
]


def test_study_params_and_bits(spark):
    """Published rows through the assembled study table; a corpus of one unit per
    published units-per-token stands in for sizes."""
    vocabs = spark.createDataFrame([(v, "mid") for v, *_ in STUDY], "vocab INT, arch STRING")
    grid = ST.with_model_params(ST.study_grid(ST.configs_table(spark), vocabs, steps=4000))
    assert {(r["max_steps"], r["name"]) for r in grid.collect()} == {(4000, f"vocab{v}") for v, *_ in STUDY}
    one = spark.createDataFrame([(v, 1.0) for v, *_ in STUDY], "vocab int, x double")
    n = 1_000_000
    parts = {"params": grid.select("vocab", "params", "embed_params", "embed_share"),
             "fertility": one.withColumnRenamed("x", "fertility"), "probes": one.withColumnRenamed("x", "tokens_per_compound"),
             "sentence": one.withColumnRenamed("x", "words_per_256"),
             "sizes": spark.createDataFrame([(v, n, round(n * u), round(n * u) // 2) for v, _, _, _, u, _, _ in STUDY],
                                            "vocab int, n_tokens long, corpus_bytes long, corpus_chars long"),
             "loss": spark.createDataFrame([(v, x) for v, _, _, _, _, x, _ in STUDY], "vocab int, val_loss double")}
    got = {r["vocab"]: r for r in ST.study_table(parts).collect()}
    for v, p, e, share, units, loss, bits in STUDY:
        assert (got[v]["params"], got[v]["embed_params"]) == (p, e)
        assert got[v]["embed_share"] == pytest.approx(share, rel=1e-12)
        assert got[v]["bytes_per_token"] == pytest.approx(units)
        assert got[v]["bits_per_byte"] == pytest.approx(bits, abs=3e-4)
        assert got[v]["bits_per_char"] == pytest.approx(2 * bits, abs=1e-3)
        assert got[v]["uniform_loss"] == pytest.approx(math.log(v))


def test_config_params(spark):
    c = {r["name"]: r for r in ST.with_model_params(ST.configs_table(spark)).collect()}
    assert c["mid"]["params"] == 8211200
    assert c["small"]["params"] == 20453760
    assert c["tiny"]["params"] == 2950272 and c["nano"]["params"] == 2950272
    assert all(r["valid"] for r in c.values())
    assert c["small"]["tokens_per_step"] == 8192
    # learning rates of the configs follow lr ~ 1/sqrt(width) from 6e-4 at 384
    assert c["mid"]["scaled_lr_384"] == pytest.approx(7.35e-4, rel=2e-3)
    assert c["tiny"]["scaled_lr_384"] == pytest.approx(1.039e-3, rel=2e-3)


def test_scaling_fit_and_table(spark):
    pts = spark.createDataFrame([("tiny", 2950272, 4.5045), ("mid", 8211200, 4.0396),
                                 ("small", 20453760, 3.7623)], "model string, params long, val_loss double")
    from tokloom.operators.runs import power_fit
    fit = power_fit(pts.withColumn("g", F.lit(1)), "g", "params", "val_loss").first()
    assert round(fit["exponent"], 4) == 0.0933
    tab = {r["model"]: r for r in ST.scaling_table(pts).collect()}
    assert round(tab["tiny"]["perplexity"], 1) == 90.4
    assert round(tab["mid"]["perplexity"], 1) == 56.8
    assert round(tab["small"]["perplexity"], 1) == 43.0
    assert round(tab["mid"]["param_ratio"], 2) == 2.78 and round(tab["mid"]["loss_drop"], 3) == 0.465
    assert round(tab["small"]["param_ratio"], 2) == 2.49 and round(tab["small"]["loss_drop"], 3) == 0.277


def test_resume_schedule(spark):
    """6e-4 run resumed at 8000 of 12000 with a fresh counter ends at 4.73e-4, not 6.0e-5."""
    r = spark.range(1).select(
        lr_at(F.lit(4000), 6e-4, 200, 12000).alias("replayed"),
        lr_at(F.lit(12000), 6e-4, 200, 12000).alias("planned"),
        lr_at(F.lit(0), 6e-4, 200, 12000).alias("start"),
        lr_at(F.lit(100), 6e-4, 200, 12000).alias("mid_warmup")).first()
    assert f"{r['replayed']:.2e}" == "4.73e-04"
    assert f"{r['planned']:.2e}" == "6.00e-05"
    assert r["start"] == pytest.approx(1.2e-5)
    assert r["mid_warmup"] == pytest.approx(1.2e-5 + 0.5 * (6e-4 - 1.2e-5))


def test_winners_disagree(spark):
    rows = [(v, l, b) for v, _, _, _, _, l, b in STUDY]
    st = spark.createDataFrame(rows, "vocab int, val_loss double, bits_per_byte double")
    w = ST.study_winners(st).first()
    assert (w["best_by_loss"], w["best_by_bits"], w["disagree"]) == (4096, 16384, True)
    ranks = {r["vocab"]: (r["loss_rank"], r["bits_rank"]) for r in ST.study_ranks(st).collect()}
    assert ranks == {4096: (1, 4), 8192: (2, 3), 16384: (3, 1), 32768: (4, 2)}


def test_perplexity_clamp(spark):
    r = spark.range(1).select(perplexity(F.lit(25.0)).alias("c"),
                              perplexity(F.lit(2.0), clamp=False).alias("u")).first()
    assert r["c"] == pytest.approx(math.exp(20)) and r["u"] == pytest.approx(math.exp(2))


def test_model_params_formula(spark):
    r = spark.range(1).select(model_params(F.lit(16384), F.lit(8), F.lit(384)).alias("p")).first()
    assert r["p"] == 20453760
