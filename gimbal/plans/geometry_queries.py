"""Queries on camera building, projection, errors, bins, losses and tone maps, and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import numeric as N
from ..operators import evaluation as E
from .catalog import query, r6, table
from .fixtures import GT_SQL, cam_gt

# A camera whose focal length, distortion and scales come from different places, by row.
CAM_SQL = f"""{GT_SQL}, b AS (SELECT e, width * 1e0 AS w, height * 1e0 AS h, roll, pitch, vfov, height / 2e0 / tan(vfov / 2) AS f, (e % 9 - 4) / 20e0 AS d FROM cam_gt),
cam AS (SELECT e, w, h, roll, pitch, f * (1 + e % 3) / 2e0 AS fx, f AS fy, w / 2 AS cx, h / 2 AS cy, CASE e % 3 WHEN 0 THEN d WHEN 1 THEN d * (f / h) * (f / h) ELSE d END AS k1, CASE e % 3 WHEN 0 THEN d / 4 ELSE 0e0 END AS k2 FROM b)"""


def cams(spark, sf_dir):
    """The table of cameras and each one's columns, by three ways of saying its distortion."""
    e = F.col("e")
    rows = cam_gt(spark, sf_dir).withColumns({"w": F.col("width").cast("double"), "h": F.col("height").cast("double"), "d": (e % 9 - 4) / 20})
    w, h, d = F.col("w"), F.col("h"), F.col("d")
    given = {"vfov": F.col("vfov"), "scale_x": (1 + e % 3).cast("double"), "scale_y": F.lit(2.0)}
    ways = [C.build(w, h, given | x) for x in ({"dist": F.array(d, d / 4)}, {"k1_hat": d}, {"k1": d})]
    cam = {k: F.when(e % 3 == 0, ways[0][k]).when(e % 3 == 1, ways[1][k]).otherwise(ways[2][k]) for k in ways[0]}
    return rows, cam


@query(f"""WITH {CAM_SQL} SELECT e, round(2 * atan(h / (2 * fy)), 6) AS vfov, round(2 * atan(w / (2 * fx)), 6) AS hfov, round(k1, 6) AS k1, round(k2, 6) AS k2, round(k1 / ((fy / h) * (fy / h)), 6) AS k1_hat,
  round(fx + cx + fy + cy + 1, 4) AS matrix_sum FROM cam""")
def camera_build(spark, sf_dir):
    """Cameras from field of view, distortion said in three ways, and scales: views, distortion, and the intrinsic matrix added up."""
    rows, cam = cams(spark, sf_dir)
    v, u = C.views(cam)
    total = F.aggregate(C.matrix(cam), F.lit(0.0), lambda a, x: a + x)
    return rows.select("e", *r6(vfov=v, hfov=u, k1=cam["k1"], k2=cam["k2"], k1_hat=C.k1_hat(cam)), F.round(total, 4).alias("matrix_sum"))


@query(f"""WITH {CAM_SQL}, p AS (SELECT *, sin(roll) AS x, sin(pitch) AS y, (e % 7 - 1) / 4e0 AS z FROM cam), n AS (SELECT *, x / greatest(z, 1e-3) AS u, y / greatest(z, 1e-3) AS v FROM p),
q AS (SELECT *, u * (1 + k1 * (u * u + v * v)) * fx + cx AS px, v * (1 + k1 * (u * u + v * v)) * fy + cy AS py FROM n),
o AS (SELECT *, z > 1e-3 AND px BETWEEN 0 AND w - 1 AND py BETWEEN 0 AND h - 1 AS seen, (px - cx) / fx AS a, (py - cy) / fy AS b FROM q)
SELECT e, z > 1e-3 AS before, seen, CASE WHEN seen THEN round(px, 4) END AS px, CASE WHEN seen THEN round(py, 4) END AS py, CASE WHEN seen THEN round(a * (1 - k1 * (a * a + b * b)), 5) END AS u FROM o""")
def projection(spark, sf_dir):
    """Points in the cameras' frames to pixels, which of them are seen, and the pixels back to rays."""
    rows, cam = cams(spark, sf_dir)
    rows = rows.withColumns({"x": F.sin("roll"), "y": F.sin("pitch"), "z": (F.col("e") % 7 - 1) / 4})
    px, py, seen = C.world_to_image(cam, F.col("x"), F.col("y"), F.col("z"))
    rows = rows.withColumns({"px": px, "py": py, "seen": seen, "before": C.project(F.col("x"), F.col("y"), F.col("z"))[2]})
    u, _ = C.image_to_world(cam, F.col("px"), F.col("py"))
    shown = lambda c, n: F.when(F.col("seen"), F.round(c, n))
    return rows.select("e", "before", "seen", shown(F.col("px"), 4).alias("px"), shown(F.col("py"), 4).alias("py"), shown(u, 5).alias("u"))


@query(f"""WITH {CAM_SQL}, s AS (SELECT *, 16e0 * (e % 4) AS px, 8e0 * (e % 5) AS py, 0.5e0 + e % 3 AS sx, 1e0 + e % 2 AS sy FROM cam)
SELECT e, round((w * sx + px - px) / sx, 6) AS w, round(h, 6) AS h, round(cx, 6) AS cx, round(fx, 4) AS fx, round(w * sx + px, 6) AS w_there, round(cx * sx + px / 2, 6) AS cx_there, round(fx * sx, 4) AS fx_there FROM s""")
def scale_crop_undo(spark, sf_dir):
    """Cameras scaled, then cropped or padded, and taken back."""
    rows, cam = cams(spark, sf_dir)
    e = F.col("e")
    px, py, sx, sy = 16.0 * (e % 4), 8.0 * (e % 5), 0.5 + e % 3, 1.0 + e % 2
    there = C.crop_camera(C.scale_camera(cam, sx, sy), px, py)
    back = C.undo(there, px, py, sx, sy)
    return rows.select("e", *r6(w=back["w"], h=back["h"], cx=back["cx"], w_there=there["w"], cx_there=there["cx"]), F.round(back["fx"], 4).alias("fx"), F.round(there["fx"], 4).alias("fx_there"))


@query(f"""WITH {GT_SQL}, f AS (SELECT e, height AS h, height / 2e0 / tan(vfov / 2) AS f, (e % 29 - 14) / 10e0 AS d, (e % 9 - 4) / 4e0 AS k FROM cam_gt)
SELECT e, round(least(greatest(f * exp(d), h / 2e0 / tan(radians(150) / 2)), h / 2e0 / tan(radians(5) / 2)), 4) AS log_step, round(least(greatest(f + d * 400, h / 2e0 / tan(radians(150) / 2)), h / 2e0 / tan(radians(5) / 2)), 4) AS step,
  round(least(greatest(k + d / 10, -0.7e0), 0.7e0), 6) AS radial, round(least(greatest(k * 4 + d, -3e0), 3e0), 6) AS divisional FROM f""")
def parameter_updates(spark, sf_dir):
    """Focal lengths and distortion terms moved by a step, within their limits."""
    e, h = F.col("e"), F.col("height").cast("double")
    f, d, k = C.fov2focal(F.col("vfov"), h), (e % 29 - 14) / 10, (e % 9 - 4) / 4
    return cam_gt(spark, sf_dir).select(
        "e", F.round(C.update_focal(f, h, d), 4).alias("log_step"), F.round(C.update_focal(f, h, d * 400, as_log=False), 4).alias("step"),
        *r6(radial=C.update_distortion(k, d / 10), divisional=C.update_distortion(k * 4, d, "simple_divisional")),
    )


@query(f"""WITH {GT_SQL}, g AS (SELECT e, width, height, height / 2e0 / tan(vfov / 2) AS f, pitch, -sin(roll) * cos(pitch) AS gx, -cos(roll) * cos(pitch) AS gy, sin(pitch) AS gz FROM cam_gt)
SELECT e, round((height / 2e0 - ((0 - width / 2e0) * gx + f * gz) / gy) / height, 6) AS left_share, round((height / 2e0 - ((width - width / 2e0) * gx + f * gz) / gy) / height, 6) AS right_share, round(pitch, 6) AS pitch FROM g""")
def horizon_relative(spark, sf_dir):
    """The horizon's ends as shares of the height, and the pitch by way of its offset."""
    h, f = F.col("height").cast("double"), C.fov2focal(F.col("vfov"), F.col("height"))
    a, b = C.horizon(F.col("roll"), F.col("pitch"), f, F.col("width") / 2, h / 2, F.col("width").cast("double"))
    back = C.rho2pitch(C.pitch2rho(F.col("pitch"), f, h), f, h)
    return cam_gt(spark, sf_dir).select("e", *r6(left_share=a / h, right_share=b / h, pitch=back))


@query(f"""WITH {GT_SQL}, j AS (SELECT e, roll r1, pitch p1, vfov v1, height h, roll + (value % 100) / 500 AS r2, pitch - (value % 37) / 300 AS p2, vfov + (value % 61) / 400 AS v2, (e % 9 - 4) / 20e0 AS k1, (e % 7 - 3) / 20e0 AS k2 FROM cam_gt)
SELECT e, round(abs(r2 / pi() * 180 - r1 / pi() * 180), 6) AS roll_error, round(abs(p2 / pi() * 180 - p1 / pi() * 180), 6) AS pitch_error, round(abs(v2 / pi() * 180 - v1 / pi() * 180), 6) AS vfov_error,
  round(acos(greatest(-1, least(1, sin(r1) * cos(p1) * sin(r2) * cos(p2) + cos(r1) * cos(p1) * cos(r2) * cos(p2) + sin(p1) * sin(p2)))) / pi() * 180, 4) AS gravity_error,
  round(abs(h / 2e0 / tan(v1 / 2) - h / 2e0 / tan(v2 / 2)), 4) AS focal_error, round(abs(h / 2e0 / tan(v1 / 2) - h / 2e0 / tan(v2 / 2)) / (h / 2e0 / tan(v1 / 2)), 6) AS rel_focal_error, round(abs(k2 - k1), 6) AS k1_error FROM j""")
def camera_error_table(spark, sf_dir):
    """All errors between true and predicted cameras."""
    e, v = F.col("e"), F.col("value")
    truth = cam_gt(spark, sf_dir).withColumn("k1", (e % 9 - 4) / 20)
    pred = cam_gt(spark, sf_dir).select("e", (F.col("roll") + v % 100 / 500).alias("roll"), (F.col("pitch") - v % 37 / 300).alias("pitch"), (F.col("vfov") + v % 61 / 400).alias("vfov"), ((e % 7 - 3) / 20).alias("k1"))
    out = E.camera_table(truth, pred, "e")
    four = ("gravity_error", "focal_error")
    return out.select("e", *[F.round(c, 4 if c in four else 6).alias(c) for c in out.columns if c != "e"])


@query(f"""WITH {GT_SQL}, s AS (SELECT e, width + e % 40 AS w, height + e % 50 AS h FROM cam_gt), p AS (SELECT *, (32 - w % 32) % 32 AS pw, (32 - h % 32) % 32 AS ph, w // 32 * 32 - w AS cw FROM s)
SELECT e, CAST(pw // 2 AS INTEGER) AS l, CAST(pw - pw // 2 AS INTEGER) AS r, CAST(ph // 2 AS INTEGER) AS t, CAST(ph - ph // 2 AS INTEGER) AS b, CAST(cw AS INTEGER) AS cut, CAST(floor(cw / 2e0) AS INTEGER) AS cut_left FROM p""")
def multiples(spark, sf_dir):
    """Padding and cuts that bring both sides to multiples of 32."""
    e = F.col("e")
    w, h = (F.col("width") + e % 40).cast("int"), (F.col("height") + e % 50).cast("int")
    pad, cut, half = C.to_multiple(w, h, 32), C.to_multiple(w, h, 32, crop=True, centre=False), C.to_multiple(w, h, 32, crop=True)
    return cam_gt(spark, sf_dir).select("e", *[c.cast("int").alias(n) for c, n in zip((*pad, cut[1], half[0]), ("l", "r", "t", "b", "cut", "cut_left"))])


@query(f"""WITH {GT_SQL}, v AS (SELECT e, [roll, pitch, vfov, 0.1e0 * (e % 5)] AS s FROM cam_gt), m AS (SELECT *, list_max(s) AS top FROM v),
w AS (SELECT *, list_transform(s, lambda x: exp(x - top)) AS q FROM m)
SELECT e, round((q[1] * -3 + q[2] * -1 + q[3] * 1 + q[4] * 3) / (q[1] + q[2] + q[3] + q[4]), 6) AS soft, [-3e0, -1e0, 1e0, 3e0][list_position(s, top)] AS best, round((2 * (s[3] - radians(20)) / (radians(105) - radians(20))) - 1, 6) AS view, round(s[3], 6) AS back FROM w""")
def bin_values(spark, sf_dir):
    """Scores of bins to values, by softmax and by the greatest; a field of view on [-1, 1] and back."""
    rows = cam_gt(spark, sf_dir).withColumn("s", F.array("roll", "pitch", "vfov", 0.1 * (F.col("e") % 5)))
    centres = [-3.0, -1.0, 1.0, 3.0]
    x = C.scaled_view(F.col("vfov"))
    return rows.select("e", F.round(N.soft_argmax(F.col("s"), centres), 6).alias("soft"), N.best_centre(F.col("s"), centres).alias("best"), *r6(view=x, back=C.unscaled_view(x)))


@query("""WITH v AS (SELECT event_id, value / 100 AS x, value AS y FROM events) SELECT event_id, round(CASE WHEN x <= 1 THEN 1e0 ELSE 1 / sqrt(x) END, 6) AS huber_d, round(power(x / 3 + 1, -1.5e0), 6) AS barron_d,
  round(CASE WHEN x / 0.04e0 <= 1 THEN x ELSE (2 * sqrt(x / 0.04e0) - 1) * 0.04e0 END, 6) AS scaled, round(1 - (x * 0.5e0 + (x - 1) * 0.25e0), 6) AS dot, round(least(greatest(log10(y + 1), 0), 2) - 1, 6) AS log_map, round(power(10, least(greatest(log10(x + 1), 0), 2)) - 1, 6) AS log_back,
  round(least(greatest((y * 40 - 5000) / 5000, -1), 1), 6) AS linear, round(y, 6) AS gamma_back, round(least(greatest((x - 5.12e0) / 6, -1), 1), 6) AS ev, round(log10(y + 1) / 2.5e0 - 1, 6) AS lux, round(y, 4) AS lux_back, CAST(floor(least(greatest(127.5e0 * (x / 2 - 1) + 128, 0), 255)) AS INTEGER) AS level, round(2 * (event_id % 256 / 255e0) - 1, 6) AS pixel FROM v""")
def loss_slopes_and_maps(spark, sf_dir):
    """Slopes of robust losses, losses at a scale, tone maps and their inverses, exposure values, and pixel levels."""
    y = F.col("value")
    x = y / 100
    lux = N.illuminance(y)
    return table(spark, sf_dir, "events").select(
        "event_id",
        *r6(
            huber_d=N.huber_slope(x), barron_d=N.barron_slope(x, -1.0), scaled=N.scaled(N.huber, x, 0.2), dot=N.dot_loss([x, x - 1], [F.lit(0.5), F.lit(0.25)]), log_map=N.log_map(y), log_back=N.log_map_back(N.log_map(x)),
            linear=N.linear_map(y * 40), gamma_back=N.gamma_back(N.tone_gamma(y)), ev=N.exposure_value(x), lux=lux, pixel=N.from_level(F.col("event_id") % 256),
        ),
        F.round(N.illuminance_back(lux), 4).alias("lux_back"),
        N.to_level(x / 2 - 1).alias("level"),
    )


@query(f"""WITH {GT_SQL} SELECT e, round(roll * pitch, 6) AS o1, round(pitch * vfov, 6) AS o5, round(pitch * 0.5e0 - vfov * 0.25e0, 6) AS cx, round(vfov * 2 - roll * 0.5e0, 6) AS cy, round(roll * 0.25e0 - pitch * 2, 6) AS cz,
  round((roll * 2 + pitch * 0.25e0 + vfov * 0.5e0) / (sqrt(roll * roll + pitch * pitch + vfov * vfov) * sqrt(4 + 0.0625e0 + 0.25e0)), 6) AS cosine, round(roll / (pi() / 2), 6) AS scaled FROM cam_gt""")
def vector_products(spark, sf_dir):
    """Outer and cross products (that by its matrix), and the cosine of two vectors."""
    a, b = tuple(F.col(c) for c in ("roll", "pitch", "vfov")), tuple(F.lit(x) for x in (2.0, 0.25, 0.5))
    m, o, c = C.skew(a), C.outer(a, a), C.cross(a, b)
    row = lambda i: sum((F.get(m, F.lit(3 * i + j)) * b[j] for j in range(3)), F.lit(0.0))
    at = lambda i: F.get(o, F.lit(i))
    return cam_gt(spark, sf_dir).select("e", *r6(o1=at(1), o5=at(5), cx=c[0], cy=row(1), cz=c[2], cosine=C.cosine(F.array(*a), F.array(*b)), scaled=C.scaled_map(F.col("roll"))))
