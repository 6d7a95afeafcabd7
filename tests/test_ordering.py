"""Two-level prefix operators against pandas, with a hot group and several
partition counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokloom.operators.ordering import rank_within, running_agg
from tokloom.operators.runs import loss_ema


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 30, 3000))   # group 0 is hot
    df = pd.DataFrame({"g": g, "o": rng.permutation(3000), "v": rng.normal(size=3000).round(3)})
    return df, spark.createDataFrame(df)


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_running_agg_matches_pandas(spark, data, parts):
    pdf, sdf = data
    exp = pdf.sort_values(["g", "o"]).copy()
    exp["s"] = exp.groupby("g")["v"].cumsum() - exp["v"]
    exp["m"] = exp.groupby("g")["v"].cummin()
    exp["k"] = exp.groupby("g").cumcount() + 1
    s = running_agg(sdf, ["g"], ["o"], "v", "s", "sum", num_partitions=parts)
    s = running_agg(s, ["g"], ["o"], "v", "m", "min", inclusive=True, num_partitions=parts)
    s = rank_within(s, ["g"], ["o"], "k").toPandas().sort_values(["g", "o"])
    assert np.allclose(s["s"].values, exp["s"].values)
    assert np.allclose(s["m"].values, exp["m"].values)
    assert (s["k"].values == exp["k"].values).all()


def test_blocked_ema_matches_recurrence(spark, data):
    pdf, _ = data
    log = pdf.sort_values(["g", "o"]).copy()
    log["k"] = log.groupby("g").cumcount() + 1
    log = log.rename(columns={"g": "run_id"})
    got = loss_ema(spark.createDataFrame(log), "v", block=16).toPandas().sort_values(["run_id", "k"])
    exp = []
    for _, grp in log.groupby("run_id"):
        r = None
        for x in grp["v"]:
            r = x if r is None else 0.9 * r + 0.1 * x
            exp.append(r)
    assert np.allclose(got["ema"].values, np.array(exp), atol=1e-12)
