"""Queries on sampling, filters, sources and sets, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import text as X
from ..operators import rasters
from ..operators import sampling as S
from ..sources import tables
from .catalog import UNIT, query, r6, table
from .fixtures import GT_SQL, PRED_SQL, cam_gt, cam_pred, outputs


def unit_sql(*parts: str) -> str:
    return UNIT.format(", ".join(parts))


# The normal distribution by its series, and its quantile by Newton's steps from the uniform value: not the coefficients that the operator has.
def normal_sql(x: str) -> str:
    terms = " + ".join(f"power({x}, {2 * n + 1}) * {1 / _odd(n)!r}" for n in range(40))
    return f"(0.5e0 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * ({terms}))"


def _odd(n: int) -> float:
    out = 1.0
    for k in range(1, 2 * n + 2, 2):
        out *= k
    return out


NEWTON = "z - (" + normal_sql("z") + " - q) / (exp(-z * z / 2) / sqrt(2 * pi()))"
STEPS = "n0 AS (SELECT event_id, q, CAST((q - 0.5e0) * 2.5e0 AS DOUBLE) AS z FROM u)" + "".join(f", n{i + 1} AS (SELECT event_id, q, {NEWTON} AS z FROM n{i})" for i in range(9))


@query(f"""WITH u AS (SELECT event_id, 0.5e0 + ({unit_sql("'k1'", 'event_id')} - 0.5e0) * 0.95449973610364158e0 AS q FROM events), {STEPS}
SELECT e.event_id, round(0.07e0 * z, 5) AS k1_hat, round(1.2e0 + 0.5e0 * {unit_sql("'resize'", 'e.event_id')}, 6) AS resize_factor, 640e0 AS shape FROM events e JOIN n9 USING (event_id)""")
def parameter_draws(spark, sf_dir):
    """Parameters from fixed, uniform and truncated normal distributions."""
    k = F.col("event_id")
    dists = {"k1": {"type": "truncnorm", "a": -2.0, "b": 2.0, "scale": 0.07}, "resize": {"type": "uniform", "loc": 1.2, "scale": 0.5}, "shape": {"type": "fix", "value": 640}}
    got = {n: S.draw(d, n, k) for n, d in dists.items()}
    return table(spark, sf_dir, "events").select(k, F.round(got["k1"], 5).alias("k1_hat"), F.round(got["resize"], 6).alias("resize_factor"), got["shape"].alias("shape"))


@query(f"""WITH {PRED_SQL} SELECT e, CASE WHEN {unit_sql("'motion'", 'e')} < 0.5 AND output_text LIKE 'The camera%' THEN output_text ELSE 'Scene. ' || output_text END AS caption FROM outputs""")
def mixed_captions(spark, sf_dir):
    """Half of the captions are cut to the sentence on the camera."""
    o = outputs(spark, sf_dir)
    return o.select("e", S.mixed_caption(F.concat(F.lit("Scene. "), F.col("output_text")), 0.5, "motion", F.col("e")).alias("caption"))


@query(f"""WITH {GT_SQL}, a AS (SELECT e, width AS w, height AS h, CAST(floor({unit_sql("'crop'", 'e')} * (abs(width - height) + 1)) AS INTEGER) AS spot,
  (2 * {unit_sql("'cam'", 'e', "'roll'")} - 1) * 0.6 AS r, (2 * {unit_sql("'cam'", 'e', "'pitch'")} - 1) * 0.6 AS p, (2 * {unit_sql("'cam'", 'e', "'yaw'")} - 1) * 0.6 AS y FROM cam_gt)
SELECT e, CASE WHEN w > h THEN spot ELSE 0 END AS x0, CASE WHEN w > h THEN 0 ELSE spot END AS y0, least(w, h) AS side, round(r, 6) AS roll, round(p, 6) AS pitch, round(CASE WHEN y < 0 THEN 2 * y + 2 * pi() ELSE 2 * y END, 6) AS yaw FROM a""")
def crops_and_walks(spark, sf_dir):
    """A square cut out of each image, and a camera to turn to."""
    e = F.col("e")
    x0, y0, side = S.square_crop(F.col("width"), F.col("height"), "crop", e)
    roll, pitch, yaw = S.camera_walk(0.6, "cam", e)
    return cam_gt(spark, sf_dir).select("e", x0.alias("x0"), y0.alias("y0"), side.alias("side"), *r6(roll=roll, pitch=pitch, yaw=yaw))


@query("SELECT CAST(i AS BIGINT) AS position, CAST(i % 37 AS BIGINT) AS index FROM (SELECT unnest(range(999)) AS i)")
def loop_sampler(spark, sf_dir):
    """Whole rounds over 37 rows within 1,000 positions."""
    size, index = S.looped(1000, 37)
    return spark.range(size).select(F.col("id").alias("position"), index(F.col("id")).alias("index"))


@query("""WITH c AS (SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, sum(n) OVER (ORDER BY source) AS e FROM c)
SELECT source, n, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST((16 * 8 + 16 * 8 + 4 * 1) // 17 AS INTEGER) AS mean_batch FROM w""")
def source_offsets(spark, sf_dir):
    """Where each source's rows lie in the concatenation, and the average batch."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    mean = S.mean_batch({"a": 16, "b": 16, "c": 4}, {"a": 8, "b": 8, "c": 1})
    return S.offsets(counts, "source", "n").select("source", "n", "start", "end", F.lit(mean).alias("mean_batch"))


@query(f"""WITH {PRED_SQL} SELECT source, weight, count(*) AS n, count(roll) AS with_roll, count(output_text) AS with_text FROM (SELECT 'cameras' AS source, 8 AS weight, roll, NULL AS output_text FROM cam_gt UNION ALL SELECT 'captions', 1, NULL, output_text FROM outputs) GROUP BY 1, 2""")
def task_mixture(spark, sf_dir):
    """Sources with other columns and weights in one table."""
    both = S.mixture({"cameras": (cam_gt(spark, sf_dir), 8), "captions": (outputs(spark, sf_dir), 1)})
    return both.groupBy("source", "weight").agg(F.count("*").alias("n"), F.count("roll").alias("with_roll"), F.count("output_text").alias("with_text"))


@query("SELECT vec_id // 16 AS batch, array_to_string(list(CAST(vec_id AS VARCHAR) ORDER BY vec_id), ',') AS ids, array_to_string(list(CAST(label AS VARCHAR) ORDER BY vec_id), ',') AS labels FROM embeddings WHERE vec_id % 11 <> 0 GROUP BY 1")
def collated(spark, sf_dir):
    """Batches with an array of each column; empty samples are dropped and arrays of one batch have one size."""
    v = table(spark, sf_dir, "embeddings").withColumns({"batch": F.floor(F.col("vec_id") / 16), "key": F.when(F.col("vec_id") % 11 != 0, F.col("vec_id"))})
    out = S.collate(v.select("batch", "key", "vec_id", "label", "embedding"), "batch", "key", ["vec_id", "label", "embedding"], sized="embedding")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("batch", text("vec_id").alias("ids"), text("label").alias("labels"))


@query(f"""WITH {PRED_SQL}, k AS (SELECT g.e, g.e % 3 <> 0 AS here, p.e IS NOT NULL AS there FROM cam_gt g LEFT JOIN cam_pred p ON g.e = p.e) SELECT e, CASE WHEN here AND there THEN 'both' WHEN here THEN 'left' ELSE 'right' END AS side FROM k WHERE here OR there""")
def key_sets(spark, sf_dir):
    """Keys of two tables: in both, missing from the right one, or from the left."""
    left, right = cam_gt(spark, sf_dir).where("e % 3 <> 0").select("e"), cam_pred(spark, sf_dir).select("e")
    parts = [(left.intersect(right), "both"), (left.subtract(right), "left"), (right.subtract(left), "right")]
    out = None
    for df, side in parts:
        df = df.withColumn("side", F.lit(side))
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.02 THEN 1e0 ELSE 0e0 END)) / 64, 6) AS dark FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.02 THEN 1e0 ELSE 0e0 END)) / 64 < 0.12")
def dark_pixels(spark, sf_dir):
    """Images that keep below a share of black pixels; here of values next to zero."""
    v = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.02, F.lit(0.0)).otherwise(F.abs(x).cast("double")))
    share = rasters.black_share([v])
    return table(spark, sf_dir, "embeddings").withColumn("dark", share).where("dark < 0.12").select("vec_id", F.round("dark", 6).alias("dark"))


@query("SELECT vec_id, CAST(p AS INTEGER) AS p, round(CAST(embedding[CAST(p // 16 % 8 * 8 + p % 8 + 1 AS INTEGER)] AS DOUBLE) * (1 + p // 8 % 2), 6) AS level FROM embeddings, (SELECT unnest(range(128)) AS p)")
def tiles(spark, sf_dir):
    """Two images side by side in one."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    grid = rasters.tiled([v, F.transform(v, lambda x: x * 2)], 8, 8, 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(grid).alias("p", "level")).select("vec_id", "p", F.round("level", 6).alias("level"))


@query(f"""WITH {GT_SQL} SELECT e, 'out/' || e % 8 || '/' || 'img_' || e || '.pt' AS target FROM cam_gt WHERE e % 4 <> 0 AND e % 9 <> 0""")
def incremental_skip(spark, sf_dir):
    """Outputs still to be written: visible JSON files without a result."""
    e = F.col("e")
    name = F.concat(F.when(e % 9 == 0, F.lit(".")).otherwise(F.lit("")), F.lit("img_"), e.cast("string"), F.when(e % 2 == 0, F.lit(".JSON")).otherwise(F.lit(".json")))
    files = cam_gt(spark, sf_dir).select("e", name.alias("name")).where(X.is_json(F.col("name")) & ~F.startswith("name", F.lit(".")))
    todo = files.select("e", F.concat(F.lit("out/"), (e % 8).cast("string"), F.lit("/"), X.stem(F.col("name"), "pt")).alias("target"))
    return tables.pending(todo, todo.where("e % 4 = 0").select("target"), "target")


@query(f"""WITH {GT_SQL} SELECT e, printf('%.1f', width * 1e0) || ',' || printf('%.1f', height * 1e0) || ',' || printf('%.4f', height / 2e0 / tan(vfov / 2)) AS head, 8 AS n FROM cam_gt""")
def camera_vectors(spark, sf_dir):
    """Cameras as arrays in the fixed order of their parameters, mapped as a nested batch of one, and taken out again."""
    f = C.fov2focal(F.col("vfov"), F.col("height"))
    vector = tables.camera_vector({"w": F.col("width"), "h": F.col("height"), "fx": f, "fy": f, "cx": F.col("width") / 2, "cy": F.col("height") / 2, "k1": F.lit(0.0), "k2": F.lit(0.0)})
    rows = cam_gt(spark, sf_dir).select("e", tables.batched(vector).alias("b"))
    rows = tables.mapped(rows, lambda x: x * 1.0, ["b"]).select("e", tables.unbatched(F.col("b")).alias("v"))
    v = F.col("v")
    return rows.select("e", F.concat_ws(",", F.format_string("%.1f", v[0]), F.format_string("%.1f", v[1]), F.format_string("%.4f", v[2])).alias("head"), F.size(v).alias("n"))
