"""Reports, conversations, collation and sets on odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from gimbal.functions import text as X
from gimbal.operators import conversations as V
from gimbal.operators import evaluation as E
from gimbal.operators import reports
from gimbal.operators import sampling as S
from gimbal.sources import tables

NAN = float("nan")


def test_report_selects_and_rounds(spark, tmp_path):
    rows = [("a", 0.5, 2.0, 1.0, "x"), ("b", 3.0, NAN, 2.0, "y"), ("c", 4.0, 1.0, 4.0, "z")]
    df = spark.createDataFrame(rows, "name string, roll_error double, pixel_share double, width double, note_error string")
    got = {r.name: r.value for r in reports.report(df, "name", [1.0, 5.0]).collect()}
    assert got.keys() == {"mean_roll_error", "median_roll_error", "mean_pixel_share", "median_pixel_share", "auc_roll_error@1", "auc_roll_error@5"}
    assert got["mean_roll_error"] == 2.5 and got["median_pixel_share"] == 1.5 and got["auc_roll_error@1"] == 0.333
    extra = spark.createDataFrame([("broken", NAN), ("far", math.inf)], "name string, value double")
    path = str(tmp_path / "r")
    reports.save(reports.report(df, "name", []).union(extra), df.withColumn("raster", F.array(F.array(F.lit(1.0)))), path)
    summary, results = reports.load(spark, path)
    back = {r.name: r.value for r in summary.collect()}
    assert back["mean_roll_error"] == 2.5 and math.isnan(back["broken"]) and math.isnan(back["far"])
    assert "raster" not in results.columns and results.count() == 3
    assert reports.report(df.limit(0), "name", []).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        E.some_rows(df.limit(0), "predictions")


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def turns(*rows):
    kind = V.TURN
    return F.array(*[F.struct(*[F.lit(v) for v in r]).cast(kind) for r in rows])


def test_encoding_masks_and_ends(spark):
    ids = lambda t: F.transform(F.filter(F.split(t, " "), lambda w: w != ""), lambda w: w.cast("int"))
    talk = turns(("10 11", "12", True, True, "13"), ("14", "15", False, False, ""), ("16", None, None, None, None), ("17", "18", True, None, None))
    got = one(spark, V.encode(talk, ids, 1, 2))
    assert got.input_ids == [1, 10, 11, 12, 2, 13, 1, 14, 15, 16, 17, 18, 2]
    assert got.labels == [-100, -100, -100, 12, 2, -100, -100, -100, -100, -100, -100, 18, 2]
    assert one(spark, V.encode(talk, ids, 1, 2, max_length=3)).input_ids == [1, 10, 11]
    assert one(spark, V.encode(talk, ids, None, 2, max_length=3, truncation="left")).labels == [-100, 18, 2]
    with pytest.raises(Exception, match="more than 3 tokens"):
        one(spark, V.encode(talk, ids, 1, 2, max_length=3, truncation=None))
    assert one(spark, V.encode(F.array().cast(f"array<{V.TURN}>"), ids, 1, 2)).input_ids == []


def test_placeholders(spark):
    ids = V.word_ids
    n = lambda s: len(one(spark, ids(F.lit(s))))
    got = one(spark, V.encode(turns(("see <image> now", "draw <query>", True, True, "")), ids, 1, 2, image_length=3, query_length=2))
    assert got.input_ids.count(V.IMAGE_IN) == 3 and got.input_ids.count(V.QUERY) == 2 and len(got.input_ids) == 1 + n("see now") + 3 + n("draw") + 2 + 1
    with pytest.raises(Exception, match="more than one <image>"):
        one(spark, V.encode(turns(("<image> <image>", "x", True, True, "")), ids, 1, 2))
    talk = V.image_turn(F.lit("What is it?"), F.lit("a cat"))
    assert one(spark, talk)[0].input == "<image>\nWhat is it?"


def test_padding_and_positions(spark):
    a = F.array(F.lit(5), F.lit(6))
    assert one(spark, V.padded(a, 4, 0)) == [0, 0, 5, 6] and one(spark, V.mask(a, 4)) == [False, False, True, True]
    assert one(spark, V.positions(a, 4)) == [0, 0, 0, 1] and one(spark, V.positions(a, 1)) == [0, 1]
    empty = F.array().cast("array<int>")
    assert one(spark, V.positions(empty, 0)) == [] and one(spark, V.next_tokens(empty)) == []
    assert [tuple(p) for p in one(spark, V.next_tokens(F.array(*[F.lit(x) for x in (7, -100, 8, 9)])))] == [(1, 8), (2, 9)]


def test_collation_checks_sizes(spark):
    rows = [(0, 1, [1, 2]), (0, 0, [3, 4]), (0, None, [9]), (1, 2, [5])]
    df = spark.createDataFrame(rows, "b int, k int, a array<int>")
    got = {r.b: (r.k, r.a) for r in S.collate(df, "b", "k", ["k", "a"], sized="a").collect()}
    assert got == {0: ([0, 1], [[3, 4], [1, 2]]), 1: ([2], [[5]])}
    with pytest.raises(Exception, match="differs in size"):
        S.collate(df.fillna({"k": 7}), "b", "k", ["a"], sized="a").collect()


def test_required_columns_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "name string, v double")
    with pytest.raises(KeyError, match="missing columns: u, w"):
        tables.required(df, ["w", "v", "u"])
    with pytest.raises(ValueError, match="twice: a"):
        tables.export(df, str(tmp_path / "e"), ["v"])
    tables.export(df.limit(1), str(tmp_path / "e"), ["v"], ["absent"], half=True)
    assert dict(spark.read.parquet(str(tmp_path / "e")).dtypes) == {"name": "string", "v": "float"}


def test_nested_values_are_mapped(spark):
    df = spark.sql("SELECT array(1, null) AS a, named_struct('x', 2.0D, 's', 'keep') AS b, map('k', 3) AS m, 'text' AS t")
    r = tables.mapped(df, lambda x: x * 2).first()
    assert r.a == [2, None] and r.b.x == 4.0 and r.b.s == "keep" and r.m == {"k": 6} and r.t == "text"


def test_templates_and_places(spark):
    row = spark.createDataFrame([("left", "7"), ("Up", "x7")], "p string, c string")
    got = row.select(X.place_yaw(F.col("p")).alias("y"), X.category(F.col("c")).alias("c"), X.fill("{a}/b-{a}.h5", {"a": F.col("c")}).alias("f")).collect()
    assert [tuple(r) for r in got] == [("1.5710", 7, "7/b-7.h5"), (None, None, "x7/b-x7.h5")]
    with pytest.raises(KeyError):
        X.fill("{absent}", {})
