"""Literal cases of parsing, metrics and sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gimbal.functions import camera as C
from gimbal.functions import numeric as N
from gimbal.functions import text as X
from gimbal.operators import estimate
from gimbal.operators import fields as P
from gimbal.operators import metrics as M
from gimbal.operators.ranking import ranked


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(
    "text, want",
    [("x The camera parameters are: -0.3939, 0.0277, 0.7595.", (-0.3939, 0.0277, 0.7595)), ("are: 1, 2, 3. \n", (1, 2, 3)), ("none", (None,) * 3)],
)
def test_base_parser(spark, text, want):
    assert tuple(one(spark, *X.triple(F.lit(text), X.BASE))) == want


def test_strict_parser_fails(spark):
    with pytest.raises(Exception, match="no camera parameters"):
        one(spark, *X.triple(F.lit("none"), X.BASE, strict=True))


def test_lenient_parser_needs_decimals(spark):
    assert tuple(one(spark, *X.triple(F.lit("are: 1, 2, 3."), X.LENIENT, X.DEFAULTS))) == X.DEFAULTS


def test_think_spans_lines(spark):
    assert one(spark, X.think(F.lit("a<think>x\ny</think>b")))[0] == "x\ny"


def test_dynamic_size(spark):
    assert tuple(one(spark, *C.dynamic_size(F.lit(1024), F.lit(600)))) == (512, 320)


def auc_plain(errors, t, floor=1.0):
    e = np.sort(errors)
    r = (np.arange(len(e)) + 1) / len(e)
    s = (e <= floor).mean()
    xs, ys = np.concatenate([[0, floor], e[e > floor]]), np.concatenate([[s, s], r[e > floor]])
    k = np.searchsorted(xs, t, side="right")
    return round(np.trapezoid(np.r_[ys[:k], ys[k - 1]], np.r_[xs[:k], t]) / t, 4)


@pytest.mark.parametrize("errors", [[0.2, 0.5, 3.0], [1.0, 5.0, 5.0, 2.0, 9.9, float("inf")], list(np.random.default_rng(1).gamma(2, 3, 300))])
def test_auc(spark, errors):
    df = spark.createDataFrame([("m", float(e)) for e in errors], "metric string, e double")
    got = {r.threshold: r.auc for r in M.auc(df, [0.5, 1.0, 5.0, 10.0]).collect()}
    for t, v in got.items():
        assert v == pytest.approx(auc_plain(errors, t), abs=1.01e-4)


def test_nan_is_a_miss_for_recall_and_skipped_by_the_summary(spark):
    df = spark.createDataFrame([("m", e) for e in (0.5, 1.0, float("nan"))], "metric string, e double")
    assert M.recall_at(df, [1.0]).first().recall == pytest.approx(1 / 3)
    df = spark.createDataFrame([("m", e) for e in (1.0, float("nan"), 2.0, 4.0, None)], "metric string, e double")
    assert M.summary(df).first().median == 2.0


def test_ranked_numbers_without_gaps(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    out = ranked(df, ["g"], F.floor(F.col("id") / 50), [F.col("id")], "i", "n").toPandas()
    for _, part in out.groupby("g"):
        assert part.sort_values("id").i.tolist() == list(range(1, len(part) + 1)) and (part.n == len(part)).all()


@pytest.mark.parametrize("roll, pitch", [(0.3, -0.2), (0.0, 0.4), (-0.5, 0.0), (0.78, 0.78)])
def test_jacobian_is_the_finite_difference(spark, roll, pitch):
    """Also at zero and at the greatest angles."""
    x, y, f, step = 3.0, -2.0, 9.0, 1e-6

    def value(r, p, f):
        one = lambda v: np.array([v])
        return estimate.model(estimate.gravity_of(one(r), one(p)), np.log(one(f)), None, one([x]), one([y]))[:, 0, 0]

    j = P.jacobian(F.lit(x / f), F.lit(y / f), F.lit(roll), F.lit(pitch), F.lit(f))
    got = spark.range(1).select(*[c.alias(k) for k, c in j.items()]).first()
    for i, name in enumerate(("roll", "pitch", "f")):
        d = np.eye(3)[i] * step
        want = (value(*(np.array([roll, pitch, f]) + d)) - value(*(np.array([roll, pitch, f]) - d))) / (2 * step)
        assert [got[f"{o}_{name}"] for o in ("up_x", "up_y", "sin")] == pytest.approx(want.tolist(), abs=1e-6)


def test_sectors_and_latitude_bins(spark):
    got = one(spark, N.encode_up(F.lit(0.0), F.lit(0.0), 37), N.encode_up(F.lit(1.0), F.lit(0.0), 37), N.encode_up(F.lit(-1.0), F.lit(0.0), 37))
    assert tuple(got) == (36, 18, 0)
    # Right-closed: a boundary belongs to the bin below it.
    edges = one(spark, *[N.encode_latitude(F.lit(v), 10) for v in (-90.0, -72.0, -71.9, 90.0)])
    assert tuple(edges) == (0, 0, 1, 9)
    assert one(spark, N.decode_latitude(F.lit(9), 10))[0] == pytest.approx(np.radians(81))


def test_max_radius_is_where_growth_ends(spark):
    r, free = one(spark, C.brown_max_radius(F.lit(-0.1), F.lit(0.0)), C.brown_max_radius(F.lit(0.1), F.lit(0.0)))
    assert 1 - 3 * 0.1 * r * r == pytest.approx(0) and free == float("inf")


def test_precision_recall_with_ties_and_no_positives(spark):
    rows = [("a", 3.0, True), ("a", 3.0, False), ("a", 1.0, True), ("b", 2.0, False)]
    out = M.precision_recall(spark.createDataFrame(rows, "g string, s double, y boolean"), ["g"], "s", F.col("y"), F.floor("s"))
    got = {(r.g, r.s): (r.precision, r.recall) for r in out.collect()}
    assert got == {("a", 3.0): (0.5, 0.5), ("a", 1.0): (2 / 3, 1.0), ("b", 2.0): (0.0, None)}


@pytest.mark.parametrize(
    "text, pattern, want",
    [
        ("are: 0.1234 , 0.2000 , 0.9000", X.BASE, (0.1234, 0.2, 0.9)),
        ("0.1234 , 0.2000\u00a0, 0.9000", X.LENIENT, (0.1234, 0.2, 0.9)),
        ("<answer> +1 ,-2.5,3 </answer>", X.ANSWER, (1.0, -2.5, 3.0)),
        ("are: .5, 1, 2", X.BASE, (None,) * 3),
        ("are: 1., 1, 2", X.BASE, (None,) * 3),
        (".5, .25, .75", X.LENIENT, (None,) * 3),
        ("x 1.50, 2.5, 3.5 4.5", X.LENIENT, (1.5, 2.5, 3.5)),
    ],
)
def test_numbers_and_commas(spark, text, pattern, want):
    assert tuple(one(spark, *X.triple(F.lit(text), pattern))) == want


def test_strip_takes_all_white_space(spark):
    assert one(spark, X.strip(F.lit("\x1f\u3000 a\u00a0b\u2003\n\x85")))[0] == "a\u00a0b"


@pytest.mark.parametrize("path, name", [("a/b.c/img_1.png", "img_1.jpg"), ("img.tar.gz", "img.tar.jpg"), (".hidden", ".hidden.jpg"), ("plain", "plain.jpg")])
def test_stem_and_suffix(spark, path, name):
    assert one(spark, X.stem(F.lit(path), "jpg"))[0] == name


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-9, 0.001, 0.02, 0.1, 0.5, 0.77, 0.99, 1 - 1e-9]
    got = one(spark, *[N.normal_quantile(F.lit(p)) for p in ps])
    assert list(got) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-7, abs=1e-9)
    low, high = one(spark, N.truncated_normal(F.lit(0.0), -2.0, 1.0, 5.0, 0.5), N.truncated_normal(F.lit(1.0), -2.0, 1.0, 5.0, 0.5))
    assert (low, high) == pytest.approx((4.0, 5.5), abs=1e-6)


def test_decimals_are_those_of_the_exact_value(spark):
    """Ties of the binary value go to even, and what only looks like a tie in decimal digits isn't one."""
    rng = np.random.default_rng(5)
    ties = [0.125, 0.375, -0.125, 0.145, -0.045, 1.005, 2.675, 0.5, 0.0, -0.0, -0.001, 12345.125, 99.995, 1e9, 3.0]
    values = [*ties, *(float(x) for x in rng.integers(-10**6, 10**6, 2000) / 1000), *(float(x) for x in rng.normal(0, 2, 500))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed(F.col("v"), 2).alias("a"), X.fixed(F.col("v"), 4).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(f"{r.v:.2f}", f"{r.v:.4f}") for r in rows]
