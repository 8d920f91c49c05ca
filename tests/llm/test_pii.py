"""Personal data: running results and overlaps against plain loops, and a trained model from end to end."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EMPTY

from gimbal.llm import pii


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 1000])
def test_running_results(spark, n):
    v = np.random.default_rng(n).integers(0, 50, n)
    df = spark.createDataFrame([(v.tolist(),)], "v array<int>")
    total, top = df.select(pii._scan(F.col("v"), lambda x, y: x + y, 0), pii._scan(F.col("v"), F.greatest, 0)).first()
    assert total == np.cumsum(v).tolist() and top == np.maximum.accumulate(v).tolist()


def test_overlaps_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    spans = lambda k: [(int(s), int(s + rng.integers(1, 9))) for s in rng.integers(0, 120, k)]
    rows = [(i, spans(int(rng.integers(0, 12))), spans(int(rng.integers(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, f array<struct<s:int,e:int>>, h array<struct<s:int,e:int>>")
    for r in df.select("f", "h", pii._apart(F.col("f"), F.col("h")).alias("got")).collect():
        want = [x for x in r.f if not any(x.s < y.e and y.s < x.e for y in r.h)]
        assert sorted(map(tuple, r.got)) == sorted(map(tuple, want))


def test_a_span_is_not_lost_to_one_that_is_dropped(spark):
    """The wide address reaches into a base address and goes; the number that it overlaps stays."""
    docs = spark.createDataFrame([(1, "a@b.cd,555@12345678901")], "doc_id long, text string")
    model = pii.SpanModel([1.0], [1.0], {g: 0.5 for g in range(3)})
    got = pii.personal_data(docs, model).first()
    assert got.spans == "email:0:6,number:11:22" and got.n_spans == 2


def test_very_many_matches(spark):
    text = "".join(f"a{i}@b{i}.cd 10.0.0.{i % 256} " for i in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.SpanModel([1.0], [1.0], {g: 0.5 for g in range(3)})
    began = time.time()
    got = pii.personal_data(docs, model).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    assert (got.n_email, got.n_ip) == (4000, 4000) and [(r.s, r.e) for r in got.redactions] == want
    assert time.time() - began < 60


@pytest.mark.parametrize("table", ["empty", "sf0.001", "sf0.01"])
def test_a_trained_model_finds_new_values(spark, table):
    docs = spark.createDataFrame([], EMPTY) if table == "empty" else spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    model = pii.train(docs)
    assert len(model.trees) == 12 and set(model.thresholds) == {0, 1, 2}
    new = pii.planted(spark, 1200, "other").select(F.monotonically_increasing_id().alias("doc_id"), "*").cache()
    found = pii.personal_data(new, model).join(new.select("doc_id", "s", "e", "label"), "doc_id")
    added = lambda r: ~r["kind"].isin(list(pii.BASE)) & (r["s"] < F.col("e")) & (r["e"] > F.col("s"))
    rows = found.select("label", F.exists("redactions", added).alias("hit")).toPandas()
    assert rows[rows.label == 1].hit.mean() >= 0.9 and rows[rows.label == 0].hit.mean() <= 0.1
    for r in pii.personal_data(docs, model).join(docs, "doc_id").where("text rlike 'token = \"[0-9a-f]{40}\"'").collect():
        spans = {(x.s, x.e) for x in r.redactions}
        assert all(m.span(1) in spans for m in re.finditer('token = "([0-9a-f]{40})"', r.text))


def test_formats_left_out_and_alone(spark):
    of = lambda **k: {F_(r) for r in pii.planted(spark, 600, "formats", **k).where("g = 2 AND label = 1").collect()}
    F_ = lambda r: bool(re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", r.text[r.s : r.e]))  # noqa: E731, N806
    assert of() == {True, False} and of(only={2: 0}) == {True} and of(without={2: 0}) == {False}
