"""Camera tables derived from `events`, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

GT_SQL = """cam_gt AS (SELECT event_id AS e, 'img_' || event_id || '.jpg' AS fname,
  ((event_id * 37 % 901) / 900e0 - 0.5e0) * pi() / 2 AS roll, ((event_id * 71 % 901) / 900e0 - 0.5e0) * pi() / 2 AS pitch,
  (20 + (event_id * 53 % 851) / 10e0) * pi() / 180 AS vfov, 640 AS width,
  CASE event_id % 3 WHEN 0 THEN 480 WHEN 1 THEN 640 ELSE 960 END AS height, value FROM events)"""
PRED_SQL = (
    GT_SQL
    + """, cam_pred AS (SELECT e, fname, roll + ((value % 100) / 100 - 0.5e0) * 0.2e0 AS roll, pitch + ((value % 37) / 37 - 0.5e0) * 0.2e0 AS pitch,
  CASE WHEN height > width THEN 2 * atan(tan(vfov / 2) * width / height) ELSE vfov END + ((value % 61) / 61 - 0.5e0) * 0.2e0 AS vfov
  FROM cam_gt WHERE e % 10 <> 0),
outputs AS (SELECT e, CASE WHEN e % 11 = 0 THEN '' WHEN e % 5 = 0 THEN 'run/a.b/img_' || e || '.png' ELSE fname END AS id, CASE WHEN e % 7 = 0 THEN 'No parameters.'
  WHEN e % 13 = 0 THEN printf('They are: %.4f , %.4f  ,  %.4f . ', roll, pitch, vfov) WHEN e % 17 = 0 THEN 'They are: .5000, .2500, .7500.' WHEN e % 19 = 0 THEN 'They are: +1, -2 ,3' ELSE
  printf('The camera parameters (roll, pitch, and field-of-view) are: %.4f, %.4f, %.4f.', roll, pitch, vfov) END AS output_text FROM cam_pred)"""
)


def cam_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("e"),
        F.concat(F.lit("img_"), e.cast("string"), F.lit(".jpg")).alias("fname"),
        (((e * 37 % 901) / 900 - 0.5) * math.pi / 2).alias("roll"),
        (((e * 71 % 901) / 900 - 0.5) * math.pi / 2).alias("pitch"),
        ((20 + (e * 53 % 851) / 10) * math.pi / 180).alias("vfov"),
        F.lit(640).alias("width"),
        F.when(e % 3 == 0, 480).when(e % 3 == 1, 640).otherwise(960).alias("height"),
        "value",
    )


def cam_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cam_gt(spark, sf_dir).where(F.col("e") % 10 != 0)
    off = lambda m: ((F.col("value") % m) / m - 0.5) * 0.2
    crop = F.when(F.col("height") > F.col("width"), 2 * F.atan(F.tan(F.col("vfov") / 2) * F.col("width") / F.col("height"))).otherwise(F.col("vfov"))
    return g.select("e", "fname", (F.col("roll") + off(100)).alias("roll"), (F.col("pitch") + off(37)).alias("pitch"), (crop + off(61)).alias("vfov"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cam_pred(spark, sf_dir)
    e = F.col("e")
    # No numbers, blanks on both sides of commas, bare fractions, whole numbers with signs.
    text = F.when(e % 7 == 0, "No parameters.").when(e % 13 == 0, X.formatted("They are: {} , {}  ,  {} . ", 4, F.col("roll"), F.col("pitch"), F.col("vfov")))
    text = text.when(e % 17 == 0, "They are: .5000, .2500, .7500.").when(e % 19 == 0, "They are: +1, -2 ,3")
    text = text.otherwise(X.sentence(F.col("roll"), F.col("pitch"), F.col("vfov")))
    name = F.when(e % 11 == 0, "").when(e % 5 == 0, F.concat(F.lit("run/a.b/img_"), e.cast("string"), F.lit(".png"))).otherwise(F.col("fname"))
    return p.select("e", name.alias("id"), text.alias("output_text"))


def room_images(cams, key: str, size: int = 256):
    """(key, width, height, pixels): what cameras with roll, pitch, vfov and yaw see of a room whose walls bear a grid, levels 0 to 255, nine rays a pixel."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    def seen(roll, pitch, vfov, yaw):
        g = np.array([-np.sin(roll) * np.cos(pitch), -np.cos(roll) * np.cos(pitch), np.sin(pitch)])
        a = np.cross(g, (0.0, 0.0, 1.0))
        a /= np.linalg.norm(a)
        b = np.cross(g, a)
        world = np.stack([np.cos(yaw) * a + np.sin(yaw) * b, -g, np.cos(yaw) * b - np.sin(yaw) * a])
        at = (np.arange(3 * size) - 1) / 3 - size / 2
        f = size / 2 / np.tan(vfov / 2)
        eye = np.array([0.1, -0.05, 0.07])
        out = np.empty((size, size))
        for top in range(0, size, 16):  # some lines at a time, which a core's cache holds
            rows = at[3 * top : 3 * (top + 16)]
            rays = np.stack(np.broadcast_arrays(at[None] / f, rows[:, None] / f, 1.0), -1) @ world.T
            reach = (np.sign(rays) - eye) / np.where(rays == 0, 1e-12, rays)
            wall = reach.argmin(-1)
            spot = rays * reach.min(-1)[..., None] + eye
            band = ((spot + 1) * 2 % 1 >= 0.4) & ((spot + 1) * 2 % 1 < 0.6)
            dark = np.where(wall == 0, band[..., 1] | band[..., 2], np.where(wall == 1, band[..., 0] | band[..., 2], band[..., 0] | band[..., 1]))
            level = np.where(dark, 40.0, 200.0 - 30 * wall)
            out[top : top + 16] = level.reshape(len(rows) // 3, 3, size, 3).mean((1, 3))
        return out

    def run(batches):
        for batch in batches:
            values = zip(*(batch.column(k).to_pylist() for k in range(1, 5)))
            for i, v in enumerate(values):
                pixels = pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), pa.array(seen(*v).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([size], pa.int32()), pa.array([size], pa.int32()), pixels], names=[key, "width", "height", "pixels"])

    schema = T.StructType([cams.schema[key], T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.DoubleType()))])
    return cams.select(key, "roll", "pitch", "vfov", "yaw").mapInArrow(run, schema)
