"""Further queries on camera geometry, estimation, bins and caches, and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import numeric as N
from ..operators import estimate, fields, rasters
from ..operators.metrics import precision_recall, quantile
from ..sources import tables
from .catalog import GRAV, query, r6, table
from .fixtures import GT_SQL, cam_gt

SIZE = 8


def grid(spark, sf_dir):
    """Normalised points of a small grid for every camera."""
    f = C.fov2focal(F.col("vfov"), F.lit(float(SIZE)))
    px = fields.pixels(cam_gt(spark, sf_dir).withColumn("f", f), SIZE, SIZE, "e")
    return px.withColumns({"u": (F.col("x") - SIZE / 2) / F.col("f"), "v": (F.col("y") - SIZE / 2) / F.col("f")})


GRID_SQL = f"""{GT_SQL}, g0 AS (SELECT e, roll, pitch, x, y, {SIZE // 2} / tan(vfov / 2) AS f, -sin(roll) * cos(pitch) AS a, -cos(roll) * cos(pitch) AS b, sin(pitch) AS c
  FROM cam_gt, (SELECT unnest(range({SIZE})) AS x), (SELECT unnest(range({SIZE})) AS y)),
g AS (SELECT *, (x - {SIZE // 2}) / f AS u, (y - {SIZE // 2}) / f AS v FROM g0)"""
# The up direction is an angle here: its derivative is that of atan2.
JAC_SQL = GRID_SQL + """, w AS (SELECT *, a - c * u AS wx, b - c * v AS wy, u * u + v * v + 1 AS r2, u * a + v * b + c AS d FROM g),
t AS (SELECT *, (wx * (sin(roll) * cos(pitch)) + wy * cos(roll) * cos(pitch)) / (wx * wx + wy * wy) AS t_roll,
  (wx * (cos(roll) * sin(pitch) - cos(pitch) * v) - wy * (sin(roll) * sin(pitch) - cos(pitch) * u)) / (wx * wx + wy * wy) AS t_pitch,
  (wx * c * v - wy * c * u) / f / (wx * wx + wy * wy) AS t_f,
  (-u * cos(roll) * cos(pitch) + v * sin(roll) * cos(pitch)) / sqrt(r2) AS s_roll,
  (u * sin(roll) * sin(pitch) + v * cos(roll) * sin(pitch) + cos(pitch)) / sqrt(r2) AS s_pitch,
  (c - d / r2) / f / sqrt(r2) AS s_f, sqrt(wx * wx + wy * wy) AS n FROM w)"""


@query(f"WITH {JAC_SQL} SELECT e, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, " + ", ".join(f"round(-wy / n * t_{k}, 6) AS up_x_{k}, round(wx / n * t_{k}, 6) AS up_y_{k}, round(s_{k}, 6) AS sin_{k}" for k in ("roll", "pitch", "f")) + " FROM t")
def field_jacobian(spark, sf_dir):
    """Derivatives of the field by roll, pitch and focal length."""
    j = fields.jacobian(*[F.col(c) for c in ("u", "v", "roll", "pitch", "f")])
    return grid(spark, sf_dir).select("e", "x", "y", *r6(**j))


@query(f"""WITH {JAC_SQL}, h AS (SELECT e, any_value(f) AS f, sum(t_roll * t_roll + s_roll * s_roll) AS a, sum(t_roll * t_pitch + s_roll * s_pitch) AS b, sum(t_roll * t_f + s_roll * s_f) AS c,
  sum(t_pitch * t_pitch + s_pitch * s_pitch) AS d, sum(t_pitch * t_f + s_pitch * s_f) AS g, sum(t_f * t_f + s_f * s_f) AS i FROM t GROUP BY e),
k AS (SELECT *, a * (d * i - g * g) - b * (b * i - c * g) + c * (b * g - c * d) AS det FROM h),
v AS (SELECT e, f, (d * i - g * g) / det AS rr, (a * i - c * c) / det AS pp, (a * d - b * b) / det AS ff, (c * g - b * i) / det AS rp FROM k)
SELECT e, round(sqrt(rr), 5) AS roll_sd, round(sqrt(pp), 5) AS pitch_sd, round(sqrt((rr + pp + sqrt((rr - pp) * (rr - pp) + 4 * rp * rp)) / 2), 5) AS gravity_sd,
  round(sqrt(ff) / 2, 5) AS focal_sd, round(sqrt(power(4 * {SIZE}e0 / (4 * f * f + {SIZE * SIZE}), 2) * ff / 2), 5) AS vfov_sd FROM v""")
def fit_uncertainty(spark, sf_dir):
    """Deviations of roll, pitch, gravity, focal length and field of view at the true camera."""
    out = estimate.uncertainties(grid(spark, sf_dir), "e", float(SIZE))
    return out.select("e", *[F.round(c, 5).alias(c) for c in out.columns if c != "e"])


@query(f"WITH {GT_SQL} SELECT e, round(roll, 3) + 0 AS roll, round(pitch, 3) + 0 AS pitch, round(vfov, 3) AS vfov FROM cam_gt")
def consensus_fit(spark, sf_dir):
    """Cameras voted for by the pixels of their own fields, from 1,000 hypotheses each."""
    out = estimate.consensus(fields.packed_field(plain(spark, sf_dir), SIZE, SIZE), SIZE, SIZE)
    vfov = C.focal2fov(F.col("f"), F.lit(float(SIZE)))
    return out.select("e", *[(F.round(c, 3) + 0.0).alias(n) for n, c in (("roll", F.col("roll")), ("pitch", F.col("pitch")), ("vfov", vfov))])


def plain(spark, sf_dir):
    return fields.dealt(cam_gt(spark, sf_dir).select("e", "roll", "pitch", "vfov"), "e")


@query(f"WITH {GT_SQL} SELECT e, round(roll, 5) AS roll, round(pitch, 5) AS pitch, round(vfov, 5) AS vfov FROM cam_gt")
def lm_fit_robust(spark, sf_dir):
    """Fit from a heuristic start with Huber's loss, steps on the sphere and confidences, where every seventh pixel is wrong."""
    px = fields.packed_field(plain(spark, sf_dir), 16, 16)
    wrong = F.transform("lat", lambda v, i: F.when(i % 7 == 3, v / 2 - 0.3).otherwise(v))
    conf = F.transform("lat", lambda v, i: F.when(i % 7 == 3, F.lit(0.0)).otherwise(0.5 + (i % 3) / 4))
    px = px.select("e", "up_x", "up_y", wrong.alias("lat"), conf.alias("lat_conf"))
    out = estimate.fit_cameras(px, 16, 16, robust=True, sphere=True, heuristic=True)
    return out.select("e", *[F.round(c, 5).alias(c) for c in ("roll", "pitch", "vfov")])


@query(f"WITH {GT_SQL} SELECT e, round(roll, 5) AS roll, round(pitch, 5) AS pitch, round(vfov, 5) AS vfov, round((e % 9 - 4) / 100e0, 5) AS k1 FROM cam_gt WHERE vfov < radians(80)")
def lm_fit_distorted(spark, sf_dir):
    """Fit cameras with a radial term: all four parameters come back."""
    cams = plain(spark, sf_dir).where(F.col("vfov") < F.radians(F.lit(80))).withColumns({"k1": (F.col("e") % 9 - 4) / 100, "k2": F.lit(0.0)})
    out = estimate.fit_cameras(fields.packed_field(cams, 16, 16, "simple_radial"), 16, 16, lens="simple_radial", steps=60)
    return out.select("e", *[(F.round(c, 5) + 0.0).alias(c) for c in ("roll", "pitch", "vfov", "k1")])


def near(name: str, want, within: float):
    """Whether a fitted value is there and within a bound of the known one."""
    return F.coalesce(F.abs(F.col(name) - want) < within, F.lit(False)).alias(name)


@query(f"WITH {GT_SQL} SELECT e, true AS roll, true AS pitch, true AS vfov, true AS k1, true AS k2 FROM cam_gt WHERE vfov < radians(80)")
def lm_fit_radial(spark, sf_dir):
    """Fit both terms of radial cameras, by confidences, some pixels wrong but without any: the known answer within 1e-4."""
    e = F.col("e")
    cams = plain(spark, sf_dir).where(F.col("vfov") < F.radians(F.lit(80))).withColumns({"k1": (e % 9 - 4) / 100, "k2": (e % 7 - 3) / 200})
    px = fields.packed_field(cams, 16, 16, "radial")
    wrong = F.transform("lat", lambda v, i: F.when(i % 7 == 3, v / 2 - 0.3).otherwise(v))
    conf = F.transform("lat", lambda v, i: F.when(i % 7 == 3, F.lit(0.0)).otherwise(0.5 + (i % 3) / 4))
    out = estimate.fit_cameras(px.select("e", "up_x", "up_y", wrong.alias("lat"), conf.alias("lat_conf")), 16, 16, lens="radial", steps=60)
    want = {c: F.col(f"t_{c}") for c in ("roll", "pitch", "vfov", "k1", "k2")}
    both = out.join(cams.select("e", *[F.col(c).alias(f"t_{c}") for c in want]), "e")
    return both.select("e", *[near(c, t, 1e-4) for c, t in want.items()])


@query(f"WITH {GT_SQL} SELECT e, true AS roll, true AS pitch, true AS vfov, true AS k1 FROM cam_gt WHERE vfov < radians(80)")
def lm_fit_divisional(spark, sf_dir):
    """Fit cameras with a division lens: the known answer within 1e-4."""
    cams = plain(spark, sf_dir).where(F.col("vfov") < F.radians(F.lit(80))).withColumn("k1", (F.col("e") % 9 - 6) / 50)
    out = estimate.fit_cameras(fields.packed_field(cams, 16, 16, "simple_divisional").select("e", "up_x", "up_y", "lat"), 16, 16, lens="simple_divisional", steps=60)
    want = {c: F.col(f"t_{c}") for c in ("roll", "pitch", "vfov", "k1")}
    both = out.join(cams.select("e", *[F.col(c).alias(f"t_{c}") for c in want]), "e")
    return both.select("e", *[near(c, t, 1e-4) for c, t in want.items()])


@query(f"WITH {GT_SQL} SELECT e, true AS roll, true AS pitch, true AS vfov FROM cam_gt")
def gradient_fit(spark, sf_dir):
    """Fits of every camera by a first-order method with each image's own rate: the known answer within 1e-3."""
    cams = plain(spark, sf_dir)
    out = estimate.fit_cameras(cams, SIZE, SIZE, by="gradient", steps=2000, own=True)
    both = out.join(cams.select("e", *[F.col(c).alias(f"t_{c}") for c in ("roll", "pitch", "vfov")]), "e")
    return both.select("e", *[near(c, F.col(f"t_{c}"), 1e-3) for c in ("roll", "pitch", "vfov")])


@query(f"WITH {GT_SQL} SELECT CAST(step AS INTEGER) AS step, count(*) AS n, true AS falls FROM cam_gt, (SELECT unnest(range(11)) AS step) GROUP BY step")
def fit_steps(spark, sf_dir):
    """The log of ten published steps, early stop by tolerances: mean cost of a pixel after each, over all images; it never rises."""
    out = estimate.fit_cameras(fields.packed_field(plain(spark, sf_dir), SIZE, SIZE), SIZE, SIZE, steps=10, tolerances=(1e-8, 1e-8), log=True)
    logged = out.select("e", F.posexplode("costs").alias("step", "cost"), "costs")
    falls = (F.col("step") == 0) | (F.col("cost") <= F.get("costs", F.greatest(F.col("step") - 1, F.lit(0))))
    return logged.groupBy("step").agg(F.count("*").alias("n"), F.bool_and(falls).alias("falls"))


@query(f"WITH {GT_SQL} SELECT e, e % 10 <> 0 AS found, e % 10 <> 0 AS roll, e % 10 <> 0 AS pitch, e % 10 <> 0 AS vfov FROM cam_gt WHERE vfov < radians(80)")
def consensus_outliers(spark, sf_dir):
    """Cameras from fields of which 60 % is wrong, in two stages; triples of the first come from given inliers, and an image without any has no camera."""
    n, e = 12, F.col("e")
    cams = plain(spark, sf_dir).where(F.col("vfov") < F.radians(F.lit(80)))
    px = fields.packed_field(cams, n, n)
    part = lambda i, *more: F.pmod(F.xxhash64(i, e, *more), F.lit(1000))
    turn = lambda c, f: F.transform(c, lambda v, i: F.when(part(i) < 600, f(part(i, F.lit(2)) * C.TURN / 1000)).otherwise(v))
    lost = F.transform("lat", lambda v, i: F.when(part(i) < 600, part(i, F.lit(1)) / 350 - 1.4).otherwise(v))
    # What is given as inliers is right in five of six cases.
    given = F.transform("lat", lambda v, i: (e % 10 != 0) & ((part(i) >= 600) | (part(i) < 80)))
    bad = px.select("e", turn("up_x", F.cos).alias("up_x"), turn("up_y", F.sin).alias("up_y"), lost.alias("lat"), given.alias("inliers"))
    out = estimate.consensus(bad, n, n, hypotheses=100, rounds=4)
    known = estimate.with_inliers(bad).withColumnRenamed("e", "i")
    out = out.withColumn("vfov", C.focal2fov(F.col("f"), F.lit(float(n)))).join(known, e == F.col("i"), "left").drop("i")
    both = out.join(cams.select("e", *[F.col(c).alias(f"t_{c}") for c in ("roll", "pitch", "vfov")]), "e")
    return both.select("e", (F.col("votes") > 0).alias("found"), *[near(c, F.col(f"t_{c}"), 2e-3) for c in ("roll", "pitch", "vfov")])


@query(f"""WITH {GRID_SQL}, q AS (SELECT *, u * cos(roll) + v * sin(roll) AS q0, (-u * sin(roll) + v * cos(roll)) * cos(pitch) + sin(pitch) AS q1,
  (u * sin(roll) - v * cos(roll)) * sin(pitch) + cos(pitch) AS q2 FROM g),
p AS (SELECT e, x, y, view, q0 * cos(view * pi() / 8) - q2 * sin(view * pi() / 8) AS px, q1 AS py, q0 * sin(view * pi() / 8) + q2 * cos(view * pi() / 8) AS pz FROM q, (SELECT unnest(range(16)) AS view))
SELECT e, CAST(view AS INTEGER) AS view, round(avg(sin(atan2(px, pz))), 6) AS lon_sin, round(avg(cos(atan2(px, pz))), 6) AS lon_cos, round(min(lat), 6) AS low, round(max(lat), 6) AS high
  FROM (SELECT *, asin(py / sqrt(px * px + py * py + pz * pz)) AS lat FROM p) GROUP BY e, view""")
def panorama_views(spark, sf_dir):
    """Where the pixels of sixteen views of a panorama look: mean direction and range of latitudes of each view."""
    out = fields.panorama_looks(plain(spark, sf_dir), SIZE, SIZE, [k * math.pi / 8 for k in range(16)])
    return out.select("e", "view", *r6(**{c: F.col(c) for c in ("lon_sin", "lon_cos", "low", "high")}))


@query(f"""WITH {GT_SQL}, f AS (SELECT e, width, height, height / 2e0 / tan(vfov / 2) AS f, (e % 9 - 4) / 10e0 AS k1 FROM cam_gt)
SELECT e, round(CASE WHEN k1 < 0 THEN greatest(f, sqrt(width * width / 4e0 + height * height / 4e0) / (sqrt(1 / (-3 * k1)) * 2 / 3)) ELSE f END, 4) AS f FROM f""")
def valid_focal(spark, sf_dir):
    """Focal lengths raised until the image's corner is inside the distortion's valid radius."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    f = C.valid_focal(C.fov2focal(F.col("vfov"), h), w, h, (F.col("e") % 9 - 4) / 10)
    return cam_gt(spark, sf_dir).select("e", F.round(f, 4).alias("f"))


@query(f"""WITH {GT_SQL}, b AS (SELECT e, CASE WHEN e % 13 = 0 THEN 36 ELSE CAST(round_even((roll / pi() * 180 + 180) / 10, 0) AS INTEGER) END AS b FROM cam_gt)
SELECT e, b AS sector, round(CASE WHEN b = 36 THEN 0 ELSE cos((b * 10e0 - 180) / 180 * pi()) END, 6) AS up_x, round(CASE WHEN b = 36 THEN 0 ELSE sin((b * 10e0 - 180) / 180 * pi()) END, 6) AS up_y FROM b""")
def up_sectors(spark, sf_dir):
    """Directions as sectors and back; every thirteenth is the zero vector."""
    zero = F.col("e") % 13 == 0
    x, y = (F.when(zero, F.lit(0.0)).otherwise(fn("roll")) for fn in (F.cos, F.sin))
    rows = cam_gt(spark, sf_dir).select("e", N.encode_up(x, y, 37).alias("sector"))
    up = N.decode_up(F.col("sector"), 37)
    return rows.select("e", "sector", *r6(up_x=up[0], up_y=up[1]))


@query("""WITH s AS (SELECT user_id, value, count(*) AS n, count(*) FILTER (event_type = 'click') AS p FROM events GROUP BY 1, 2)
SELECT user_id, value, round(sum(p) OVER w / sum(n) OVER w, 6) AS precision, round(sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY user_id), 0), 6) AS recall FROM s WINDOW w AS (PARTITION BY user_id ORDER BY value DESC)""")
def pr_curve(spark, sf_dir):
    """Precision and recall of a score at each of its values, by group."""
    out = precision_recall(table(spark, sf_dir, "events"), ["user_id"], "value", F.col("event_type") == "click", F.floor("value"))
    return out.select("user_id", "value", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""WITH p AS (SELECT event_type, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1)
SELECT event_id, CAST(floor(power(least(value * (0.8e0 / (p90 + 1e-10)), 1), 1 / 2.2e0) * 256) AS INTEGER) AS level FROM events JOIN p USING (event_type)""")
def exposure(spark, sf_dir):
    """Values of an image re-exposed by its 90th percentile, tone mapped and quantised."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    p90 = quantile(e, ["event_type"], F.col("value"), 0.9, "p90")
    level = N.quantise(N.tone_gamma(N.reexpose(F.col("value"), F.col("p90")))) * 256
    return e.join(p90, "event_type").select("event_id", F.round(level).cast("int").alias("level"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 4))), 5) AS total, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def cached_points(spark, sf_dir):
    """Cached predictions looked up by name and brought to each row's scale."""
    e = table(spark, sf_dir, "embeddings")
    cache = e.select(F.col("vec_id").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("keypoints0"))
    rows = e.select(F.col("vec_id").alias("name"), (1 + F.col("vec_id") % 4).alias("scale"))
    out = tables.rescaled(tables.lookup(rows, cache), "keypoints", "scale")
    total = F.aggregate("keypoints0", F.lit(0.0), lambda a, x: a + x)
    return out.select(F.col("name").alias("vec_id"), F.round(total, 5).alias("total"), F.size("keypoints0").alias("n"))


@query(f"""WITH {GT_SQL}, p AS (SELECT e, width AS w, height AS h, height / 2e0 / tan(vfov / 2) AS f, (e % 7 - 3) / 20e0 AS k1, (e % 5 - 2) / 20e0 AS k2 FROM cam_gt),
g AS (SELECT *, (i / 19e0 * (h - 1) - w / 2e0) / f AS u, (j / 19e0 * (w - 1) - h / 2e0) / f AS v FROM p, (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j)),
d AS (SELECT *, u * (1 + k1 * (u * u + v * v)) * f + w / 2e0 AS ax, v * (1 + k1 * (u * u + v * v)) * f + h / 2e0 AS ay, u * (1 + k2 * (u * u + v * v)) * f + w / 2e0 AS bx, v * (1 + k2 * (u * u + v * v)) * f + h / 2e0 AS b_y FROM g),
c AS (SELECT e, CASE WHEN bx BETWEEN -1e-6 AND w - 1 + 1e-6 AND b_y BETWEEN -1e-6 AND h - 1 + 1e-6 THEN sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) END AS err FROM d WHERE ax BETWEEN -1e-6 AND w - 1 + 1e-6 AND ay BETWEEN -1e-6 AND h - 1 + 1e-6)
SELECT e, t AS threshold, round(avg(CASE WHEN err < t THEN 1e0 ELSE 0e0 END), 4) AS share FROM c, (SELECT unnest([0.5e0, 1e0, 3e0, 5e0]) AS t) GROUP BY e, t""")
def pixel_distortion_error(spark, sf_dir):
    """Share of grid points that a wrong distortion term misplaces by less than each threshold."""
    f = C.fov2focal(F.col("vfov"), F.col("height"))
    cams = cam_gt(spark, sf_dir).select("e", "width", "height", f.alias("f"), ((F.col("e") % 7 - 3) / 20).alias("k1"), ((F.col("e") % 5 - 2) / 20).alias("k1_pred"))
    out = fields.pixel_errors(cams, "e", 20, [0.5, 1.0, 3.0, 5.0])
    return out.select("e", "threshold", F.round("share", 4).alias("share"))


@query(f"WITH {GT_SQL} SELECT e, round(roll, 5) AS roll, round(pitch, 5) AS pitch, round(radians(50 + e // 4 % 12 * 5), 5) AS vfov FROM cam_gt")
def lm_fit_shared(spark, sf_dir):
    """Fit batches of four cameras of one field of view each: the known answer comes back."""
    cams = cam_gt(spark, sf_dir).withColumn("batch", F.floor(F.col("e") / 4)).withColumn("vfov", F.radians(50 + F.col("batch") % 12 * 5))
    # Cameras, not their pixels, are brought together.
    cams = fields.dealt(cams.select("e", "batch", "roll", "pitch", "vfov"), "batch").sortWithinPartitions("batch")
    out = estimate.fit_shared_cameras(fields.packed_field(cams, 16, 16), "batch", 16, 16, together=True)
    return out.select("e", *[F.round(c, 5).alias(c) for c in ("roll", "pitch", "vfov")])


@query(f"WITH {GT_SQL} SELECT e, round(roll, 6) AS roll, round(pitch, 6) AS pitch, round(vfov, 6) AS vfov FROM cam_gt")
def lm_fit_focal_prior(spark, sf_dir):
    """Fit roll and pitch where the field of view is known."""
    out = estimate.fit_cameras(fields.packed_field(plain(spark, sf_dir), 16, 16), 16, 16, fixed=("focal",))
    return out.select("e", *r6(roll=F.col("roll"), pitch=F.col("pitch"), vfov=F.col("vfov")))


@query(f"""WITH {GRID_SQL}, k AS (SELECT *, (e % 9 - 4) / 20e0 AS k1, a - c * u AS wx, b - c * v AS wy, u * u + v * v AS r2 FROM g),
d AS (SELECT *, (1 + k1 * r2) * wx + 2 * k1 * (u * wx + v * wy) * u AS dx, (1 + k1 * r2) * wy + 2 * k1 * (u * wx + v * wy) * v AS dy, u * (1 - k1 * r2) AS u1, v * (1 - k1 * r2) AS v1 FROM k)
SELECT e, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(dx / sqrt(dx * dx + dy * dy), 6) AS up_x, round(dy / sqrt(dx * dx + dy * dy), 6) AS up_y,
  round(asin(greatest(-0.999999e0, least(0.999999e0, (u1 * a + v1 * b + c) / sqrt(u1 * u1 + v1 * v1 + 1)))), 6) AS lat FROM d""")
def distorted_field(spark, sf_dir):
    """Fields of cameras with a radial term."""
    cams = cam_gt(spark, sf_dir).withColumns({"k1": (F.col("e") % 9 - 4) / 20, "k2": F.lit(0.0)})
    out = fields.perspective_field(cams, SIZE, SIZE, "simple_radial", "e")
    return out.select("e", "x", "y", *r6(up_x=F.col("up_x"), up_y=F.col("up_y"), lat=F.col("lat")))


@query(f"""WITH {GT_SQL}, g AS (SELECT e, {GRAV}, value % 37 / 100 AS d1, value % 61 / 100 AS d2 FROM cam_gt),
t AS (SELECT *, CASE WHEN d1 = 0 AND d2 = 0 THEN 1e0 ELSE sin(sqrt(d1 * d1 + d2 * d2)) / sqrt(d1 * d1 + d2 * d2) END AS s, cos(sqrt(d1 * d1 + d2 * d2)) AS q FROM g),
h AS (SELECT *, (gx * s * d1 + gy * s * d2 + (gz - 1) * q) / (1 - gz) AS w FROM t)
SELECT e, round(s * d1 - gx * w, 6) AS x, round(s * d2 - gy * w, 6) AS y, round(q - (gz - 1) * w, 6) AS z FROM h""")
def gravity_moves(spark, sf_dir):
    """Gravity moved by a step in its tangent plane."""
    g = C.gravity(F.col("roll"), F.col("pitch"))
    x, y, z = C.sphere_move(g, F.col("value") % 37 / 100, F.col("value") % 61 / 100)
    return cam_gt(spark, sf_dir).select("e", *r6(x=x, y=y, z=z))


@query("""WITH p AS (SELECT user_id, event_id, value % 37 * 10 - 180 AS px, value % 61 * 40 - 1200 AS py FROM events),
r AS (SELECT *, abs(py) / sqrt(px * px + py * py + 1) AS steep, -py * px / 500 AS gx, -py * py / 500 AS gy, -py AS gz FROM p),
n AS (SELECT *, gx / sqrt(gx * gx + gy * gy + gz * gz) AS x, gy / sqrt(gx * gx + gy * gy + gz * gz) AS y, gz / sqrt(gx * gx + gy * gy + gz * gz) AS z FROM r),
a AS (SELECT *, asin(-x / (sqrt(1 - z * z) + 1e-4)) AS r0 FROM n),
f AS (SELECT *, abs(CASE WHEN y >= 0 THEN -r0 - pi() * sign(x) ELSE r0 END) <= pi() / 4 AND abs(asin(z)) <= pi() / 4 AS fits FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fits DESC, CASE WHEN fits THEN steep ELSE 0 END DESC, event_id) AS i FROM f)
SELECT user_id, event_id, round(-sign(py) * px, 6) AS px, round(-sign(py) * py, 6) AS py, -sign(py) * 1e0 AS pz FROM k WHERE i = 1""")
def vertical_vanishing_point(spark, sf_dir):
    """Each owner's best vertical vanishing point."""
    v = F.col("value")
    pts = table(spark, sf_dir, "events").select("user_id", "event_id", (v % 37 * 10 - 180).alias("px"), (v % 61 * 40 - 1200).alias("py"), F.lit(1.0).alias("pz"))
    out = fields.vertical_points(pts, "user_id", "event_id", F.lit(500.0), F.lit(0.0), F.lit(0.0))
    return out.select("user_id", "event_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "pz")


# Embeddings serve as rasters of eight by eight pixels, each with a camera of its own.
VEC_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS a, 4 / tan((20 + (vec_id * 53 % 851) / 10e0) * pi() / 360) AS f, ((vec_id * 37 % 901) / 900e0 - 0.5e0) * pi() / 2 AS roll,
  ((vec_id * 71 % 901) / 900e0 - 0.5e0) * pi() / 2 AS pitch, vec_id % 8 * pi() / 4 AS yaw, (vec_id % 9 - 4) / 20e0 AS k1 FROM embeddings)"""


def rasters_sql(placed: str) -> str:
    """Bilinear samples of v at the places (vec_id, p, sx, sy) of `placed`; pixels outside are zero."""
    at = "CASE WHEN {0} BETWEEN 0 AND 7 AND {1} BETWEEN 0 AND 7 THEN a[CAST({1} * 8 + {0} + 1 AS INTEGER)] ELSE 0e0 END"
    c = [at.format(i, j) for i, j in (("i", "j"), ("(i + 1)", "j"), ("i", "(j + 1)"), ("(i + 1)", "(j + 1)"))]
    return f"""WITH {VEC_SQL}, {placed}, fl AS (SELECT *, floor(sx) AS i, floor(sy) AS j FROM pl)
SELECT vec_id, CAST(p AS INTEGER) AS p, round((({c[0]}) * (1 - (sx - i)) + ({c[1]}) * (sx - i)) * (1 - (sy - j)) + (({c[2]}) * (1 - (sx - i)) + ({c[3]}) * (sx - i)) * (sy - j), 6) AS level FROM fl"""


def vectors(spark, sf_dir):
    i = F.col("vec_id")
    vfov = F.radians(20 + (i * 53 % 851) / 10)
    return table(spark, sf_dir, "embeddings").select(
        i, F.transform("embedding", lambda q: q.cast("double")).alias("a"), C.fov2focal(vfov, F.lit(8.0)).alias("f"), (((i * 37 % 901) / 900 - 0.5) * C.TURN / 4).alias("roll"),
        (((i * 71 % 901) / 900 - 0.5) * C.TURN / 4).alias("pitch"), (i % 8 * C.TURN / 8).alias("yaw"), ((i % 9 - 4) / 20).alias("k1"),
    )


def levels(df, raster):
    return df.select("vec_id", F.posexplode(raster).alias("p", "level")).select("vec_id", "p", F.round("level", 6).alias("level"))


@query(rasters_sql("pl AS (SELECT vec_id, a, p, least(greatest((p % 12 + 0.5e0) * 8 / 12 - 0.5e0, 0), 7) AS sx, least(greatest((p // 12 + 0.5e0) * 8 / 12 - 0.5e0, 0), 7) AS sy FROM v, (SELECT unnest(range(144)) AS p))"))
def raster_resize(spark, sf_dir):
    return levels(vectors(spark, sf_dir), rasters.resize(F.col("a"), 8, 8, (12, 12)))


@query(rasters_sql("""uv AS (SELECT *, (p % 8 - 4) / f AS u, (p // 8 - 4) / f AS w FROM v, (SELECT unnest(range(64)) AS p)),
pl AS (SELECT vec_id, a, p, u * (1 + k1 * (u * u + w * w)) * f + 4 AS sx, w * (1 + k1 * (u * u + w * w)) * f + 4 AS sy FROM uv)"""))
def raster_undistort(spark, sf_dir):
    return levels(vectors(spark, sf_dir), rasters.undistort(F.col("a"), 8, 8, "simple_radial", F.col("f"), F.col("k1"), F.lit(0.0)))


@query(rasters_sql("""uv AS (SELECT *, (p % 8 - 4) / f AS u, (p // 8 - 4) / f AS w FROM v, (SELECT unnest(range(64)) AS p)),
q AS (SELECT *, u * cos(roll) + w * sin(roll) AS q0, (-u * sin(roll) + w * cos(roll)) * cos(pitch) + sin(pitch) AS q1, (u * sin(roll) - w * cos(roll)) * sin(pitch) + cos(pitch) AS q2 FROM uv),
b AS (SELECT *, q0 * cos(yaw) - q2 * sin(yaw) AS bx, q0 * sin(yaw) + q2 * cos(yaw) AS bz FROM q),
pl AS (SELECT vec_id, a, p, (atan2(bx, bz) / (2 * pi()) + 0.5) * 7 AS sx, (atan2(q1, sqrt(bx * bx + bz * bz)) / pi() + 0.5) * 7 AS sy FROM b)"""))
def panorama_sample(spark, sf_dir):
    """A view of each panorama, sampled between its pixels."""
    cam = [F.col(c) for c in ("f", "roll", "pitch", "yaw")]
    return levels(vectors(spark, sf_dir), rasters.panorama_view(F.col("a"), 8, 8, (8, 8), *cam))
