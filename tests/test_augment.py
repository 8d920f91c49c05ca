"""Kernels against hand-made answers and plain loops, plans by their odds, and that a plan does the same twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gimbal.operators import augment as A
from gimbal.operators import kernels as K


def image(h=13, w=17, c=3, seed=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(float)


def plain(x, kernel):
    k, out = kernel.shape[0] // 2, np.zeros(x.shape)
    wide = np.pad(x, ((k, k), (k, k), (0, 0)), "reflect")
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            out[i, j] = np.einsum("abc,ab->c", wide[i : i + 2 * k + 1, j : j + 2 * k + 1], kernel)
    return out


RNG = np.random.default_rng(1)


@pytest.mark.parametrize("got,kernel", [
    (lambda x: K.box(x, RNG, 5), np.full((5, 5), 1 / 25)),
    (lambda x: K.motion(x, RNG, 3, 0.0, 0.0, 0.99, 0.99), np.eye(3) / 3),
    (lambda x: K.motion(x, RNG, 3, 0.5, 0.5, 0.5, 0.5), np.array([[0, 0, 0], [0, 1.0, 0], [0, 0, 0]])),
    (lambda x: K.sharpen(x, RNG, 0.3, 0.7), np.where(np.arange(9).reshape(3, 3) == 4, 0.7 + 0.3 * 8.7, -0.3)),
    (lambda x: K.gaussian(x, RNG, 3), np.outer([0.23899426, 0.52201147, 0.23899426], [0.23899426, 0.52201147, 0.23899426])),
])
def test_convolutions(got, kernel):
    assert np.allclose(got(image()), plain(image(), kernel), atol=1e-4)


def test_median_is_that_of_the_window():
    x, got = image(), K.median(image(), RNG, 3)
    wide = np.pad(x, ((1, 1), (1, 1), (0, 0)), "edge")
    assert all(got[i, j, c] == np.median(wide[i : i + 3, j : j + 3, c]) for i in range(13) for j in range(17) for c in range(3))


def test_colours_go_round():
    import colorsys

    rgb = image().reshape(-1, 3) / 255
    h, s, v = K.hsv_of(rgb)
    want = np.array([colorsys.rgb_to_hsv(*p) for p in rgb])
    assert np.allclose(np.stack([h, s, v], 1), want) and np.allclose(K.rgb_of(h, s, v), rgb)
    assert np.allclose(K.hue_saturation(image(), RNG, 180, 0, 0), image()) and np.allclose(K.hue_saturation(np.full((1, 1, 3), [255.0, 0, 0]), RNG, 60, 0, 0), [0, 255, 0])


def test_tones():
    x = image()
    assert np.allclose(K.exposure(x, RNG, 0.1, 0.2), x * 1.2 + 25.5) and np.allclose(K.gamma(x, RNG, 200), x * x / 255)
    assert np.allclose(K.grey(x, RNG)[..., 0], x[..., 0] * 0.299 + x[..., 1] * 0.587 + x[..., 2] * 0.114)
    ramp = np.arange(256.0).reshape(16, 16, 1)
    assert (K.equalised(ramp, RNG) == ramp).all() and (K.equalised(ramp * 0 + 7, RNG) == 7).all()
    dull = np.rint(ramp / 4) + 90
    assert K.equalised(dull, RNG).min() == 0 and K.equalised(dull, RNG).max() == 255
    assert K.locally_equalised(image(64, 64, 1) / 8 + 100, RNG, 40).std() > 3 * (image(64, 64, 1) / 8).std()


def test_jpeg_loses_more_at_less_quality():
    smooth = K.gaussian(image(32, 40), RNG, 15)
    loss = [np.abs(K.jpeg(smooth, RNG, q) - smooth).mean() for q in (100, 80, 20)]
    assert loss[0] < 1 < loss[2] and loss[0] < loss[1] < loss[2]
    assert np.allclose(K.jpeg(np.full((9, 5, 1), 77.0), RNG, 50), 77, atol=1)


@pytest.mark.parametrize("way", range(5))
def test_coarsened_keeps_flat_images_and_ramps(way):
    assert np.allclose(K.coarsened(np.full((20, 30, 3), 9.0), RNG, 0.6, way), 9)
    ramp = np.tile(np.arange(64.0)[None, :, None], (8, 1, 1))
    assert np.abs(K.coarsened(ramp, RNG, 0.5, way) - ramp)[:, 4:-4].max() < 1.1
    assert np.allclose(K._resampling(6, 3, "area"), np.repeat(np.eye(3), 2, 1) / 2)


def test_noise_has_its_moments():
    flat = np.full((200, 200, 3), 128.0)
    assert np.var(K.gauss_noise(flat, np.random.default_rng(5), 60)) == pytest.approx(60, rel=0.02)
    f = K.factor_noise(flat, np.random.default_rng(5), 0.85, 1.15) / 128
    assert f.mean() == pytest.approx(1, abs=0.002) and f.min() > 0.849 and f.max() < 1.151
    lit = K.sensor_noise(image(50, 50), np.random.default_rng(5), 0.02, 0.3)
    assert lit.mean() > image(50, 50).mean() and lit.max() <= 255.001
    assert (K.shade(flat, np.random.default_rng(5), 0.5, 21) <= 128.001).all() and K.shade(flat, np.random.default_rng(5), 0.5, 21).min() < 100


@pytest.mark.parametrize("name", list(A.SETS))
@pytest.mark.parametrize("shape", [(1, 1, 3), (8, 8, 1), (33, 50, 3)])
def test_every_set_on_odd_images(spark, name, shape):
    x = image(*shape)
    rows = spark.range(40).select("id", *[F.lit(n).alias(c) for n, c in zip(shape, ("height", "width", "channels"))], F.array(*[F.lit(int(v)) for v in x.ravel()]).alias("pixels") if x.size < 300 else F.lit(x.ravel().astype(int).tolist()).alias("pixels"))
    rows = rows.withColumn("steps", A.named_plan(name, "s", F.col("id")))
    once, twice = ([(r.id, r.pixels) for r in A.augmented(rows.repartition(n)).orderBy("id").collect()] for n in (1, 3))
    assert once == twice and all(len(p) == x.size and 0 <= min(p) and max(p) <= 255 for _, p in once)
    if name == "identity":
        assert all(p == x.ravel().tolist() for _, p in once)


def test_odds_and_ranges(spark):
    rows = spark.range(4000).select(A.named_plan("dark", "s", F.col("id")).alias("steps"))
    one = rows.select(F.inline("steps")).groupBy("op").agg(F.count("*").alias("n"), F.min(F.get("args", F.lit(0))).alias("low"), F.max(F.get("args", F.lit(0))).alias("high")).collect()
    by = {r.op: r for r in one}
    near = lambda op, p: abs(by[op].n / 4000 - 0.75 * p) < 4 * (p / 4000) ** 0.5
    assert near("rain", 0.2) and near("exposure", 0.5) and near("gamma", 0.1) and near("equalised", 0.5 * 0.5 / 1.4) and near("sepia", 0.5 * 0.1 / 1.4)
    assert -10 <= by["rain"].low < by["rain"].high <= 10 and (by["motion"].low, by["motion"].high) == (3, 25)


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, 0, 3, []), (2, None, None, None, None)], "id int, height int, width int, channels int, pixels array<int>")
    got = A.augmented(rows.withColumn("steps", A.named_plan("geocalib", "s", F.col("id")))).orderBy("id").collect()
    assert got[0].pixels == [] and got[1].pixels is None
    assert A.augmented(rows.limit(0).withColumn("steps", A.named_plan("dark", "s", F.col("id")))).count() == 0


def test_tone_chain(spark):
    x = image(10, 10).ravel() / 40
    rows = spark.createDataFrame([(i, x.tolist()) for i in range(300)] + [(-1, []), (-2, None)], "id int, pixels array<double>")
    first = lambda df: np.array(df.where("id = 5").first().pixels)
    want = np.clip(x * 0.8 / np.percentile(x, 90), 0, 1)
    assert np.allclose(first(A.tone_chain(rows, "id")), want, atol=1e-9)
    assert np.allclose(first(A.tone_chain(rows, "id", "gamma", 2.2, bits=8)), np.floor(want ** (1 / 2.2) * 256) / 256)
    swap = [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    assert np.allclose(first(A.tone_chain(rows, "id", balance=swap)).reshape(-1, 3), want.reshape(-1, 3)[:, [1, 0, 2]])
    noisy = A.tone_chain(rows, "id", clip=True, noise=0.04).where("id >= 0").collect()
    middle = (want > 0.2) & (want < 0.8)
    spread = np.array([(np.array(r.pixels) - want)[middle].std() for r in noisy])
    assert spread.max() < 0.048 and spread.mean() == pytest.approx(0.02, abs=0.003)
    turned = first(A.tone_chain(rows, "id", hue=0.1)).reshape(-1, 3)
    assert np.allclose(turned.max(1), want.reshape(-1, 3).max(1)) and not np.allclose(turned, want.reshape(-1, 3))
    odd = {r.id: r.pixels for r in A.tone_chain(rows, "id", hue=0.1, noise=0.1, bits=4).where("id < 0").collect()}
    assert odd == {-1: [], -2: None}
