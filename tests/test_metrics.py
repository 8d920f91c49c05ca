"""Exact metrics that put no group into one task."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gimbal.operators import metrics as M
from gimbal.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_quantile_is_exact(spark, q):
    """Continuous and tied values, one value, an infinite tail, a null group; a group of nulls has none."""
    rng = np.random.default_rng(4)
    groups = {"a": rng.lognormal(0, 4, 3001), "b": np.repeat([1.0, 2.0, 7.0, 1e9], [10, 700, 5, 900]), "c": [5.0], None: rng.normal(0, 1, 400), "e": [1.0, 2.0, 3.0, np.inf, np.inf]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for lower in (False, True):
        got = {r.g: r.x for r in M.quantile(df, ["g"], F.col("v"), q, "x", lower=lower).collect()}
        want = {g: float(np.quantile(v, q, method="inverted_cdf" if lower else "linear")) for g, v in groups.items() if g != "e"}
        assert got.keys() == groups.keys() and all(np.isclose(got[g], w, rtol=1e-12) for g, w in want.items())
        assert got["e"] == pytest.approx({0.0: 1.0, 0.05: 1.0 if lower else 1.2, 0.5: 3.0, 0.9: np.inf, 1.0: np.inf}[q])


@pytest.mark.parametrize("name", ["und_eval_summary", "nan_statistics", "weighted_category_mean", "exposure"])
def test_no_percentile_holds_a_group(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\bpercentile(_disc|_cont)?\(", plan)


def test_rolling_loss_with_gaps_in_the_ids(spark, tmp_path):
    ids = [i for i in range(5000) if i % 1000 < 900 or i % 7 == 0]
    values = np.random.default_rng(8).random(len(ids))
    spark.createDataFrame(list(zip(ids, values.tolist())), "event_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["loss_rolling"](spark, str(tmp_path)).toPandas().sort_values("iter")
    want = [values[max(0, k - 99) : k + 1].mean() for k in range(len(ids))]
    assert got["iter"].tolist() == ids and np.allclose(got["rolling"], want, atol=1e-6)


def test_equal_errors_are_one_row(spark):
    """Two million equal errors, and none: areas, medians and quantiles as for a few."""
    many = spark.range(2_000_000).select(F.lit("m").alias("metric"), F.lit(2.5).alias("e")).union(spark.createDataFrame([("m", 0.5), ("k", 3.0), ("k", float("nan")), (None, 4.0)], "metric string, e double"))
    got = {(r.metric, r.threshold): r.auc for r in M.auc(many, [1.0, 5.0]).collect()}
    assert got["m", 5.0] == pytest.approx(0.5, abs=1e-3) and got["m", 1.0] == 0 and got["k", 5.0] == pytest.approx((2 * 0.5 * 0.5 + 2 * 0.5) / 5, abs=1e-4)
    assert (None, 5.0) in got
    assert {r.metric: r.q for r in M.quantile(many, ["metric"], M.finite(F.col("e")), 0.5, "q").collect()} == {"m": 2.5, "k": 3.0, None: 4.0}
    assert M.quantile(many.where("false"), ["metric"], F.col("e"), 0.5, "q").count() == 0 and M.auc(many.where("false"), [1.0]).count() == 0
