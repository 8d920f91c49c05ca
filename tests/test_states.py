"""Counts that are merged: batches equal one pass, also when one is written twice; edges and curves against numpy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gimbal.operators import states

VALUES = {"x": (-1.0, 1.0), "y": (0.0, 10.0)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 0.6, 490), [-1, 1, np.nan, np.inf, -np.inf, 0, 0, 0.02, -0.98, 1]]
    data = [(i % 3, None if i % 97 == 0 else float(v), float(i % 12), bool(v > 0.1), float(abs(v) % 1)) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "part int, x double, y double, label boolean, score double").cache()


def counts(df):
    return {(r.name, r.bin): r.n for r in df.collect()}


def test_batches_are_one_pass(spark, rows, tmp_path):
    for again in (0, 1, 2, 1):
        states.append(states.histograms(rows.where(F.col("part") == again), [], VALUES, 20), f"{tmp_path}/h", again)
    got = counts(states.merged(spark, f"{tmp_path}/h"))
    assert got == counts(states.histograms(rows, [], VALUES, 20)) and sum(got.values()) == 2 * rows.count()


def test_bins_are_numpy_bins(rows):
    values = np.array([np.nan if r.x is None else r.x for r in rows.collect()])
    got = counts(states.histograms(rows, [], {"x": (-1.0, 1.0)}, 16))  # edges are exact in binary
    want = np.histogram(values[np.isfinite(values)], 16, (-1, 1))[0]
    assert [got.get(("x", k), 0) for k in range(16)] == want.tolist()
    assert got[("x", -1)] == (values < -1).sum() and got[("x", 16)] == (values > 1).sum() and got[("x", None)] == np.isnan(values).sum()
    edged = {r.bin: (r.low, r.high) for r in states.edges(states.histograms(rows, [], {"x": (-1.0, 1.0)}, 16), {"x": (-1.0, 1.0)}, 16).collect()}
    assert edged[0] == (-1, -0.875) and edged[-1] == (None, -1) and edged[16] == (1, None) and edged[None] == (None, None)


def test_curve(spark, rows, tmp_path):
    for k in range(3):
        states.append(states.scores(rows.where(F.col("part") == k), ["part"], "score", F.col("label"), 11), f"{tmp_path}/c", k)
    got = {(r.part, round(r.threshold * 10)): (r.precision, r.recall) for r in states.curve(states.merged(spark, f"{tmp_path}/c"), ["part"], 11).collect()}
    data = rows.collect()
    for part in range(3):
        own = [(int(min(max(r.score, 0), 1) * 10) if r.score == r.score else -1, r.label) for r in data if r.part == part]
        for k in range(11):
            called = [x for b, x in own if b >= k]
            want = (sum(called) / len(called) if called else None, sum(called) / sum(x for _, x in own))
            assert got[(part, k)] == pytest.approx(want)


def test_empty(spark, rows, tmp_path):
    none = rows.limit(0)
    assert states.histograms(none, ["part"], VALUES).count() == 0
    assert states.curve(states.scores(none, ["part"], "score", F.col("label")), ["part"]).count() == 0
