"""Queries that write files and read them again, and their DuckDB SQL. Each run takes fresh folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as C
from ..operators import evaluation as E
from ..operators import fields, reports
from ..operators.store import folder
from ..sources import tables
from .catalog import ERR_SQL, query, r6, table
from .fixtures import GT_SQL, PRED_SQL, cam_gt, cam_pred, outputs


@query(f"WITH {GT_SQL} SELECT e, CASE WHEN e % 2 = 0 THEN 'even' ELSE 'odd' END AS source, e % 8 || '/' || fname AS image, e % 8 || '/img_' || e || '.json' AS annotation FROM cam_gt")
def manifest_union(spark, sf_dir):
    """Two manifests of JSON arrays, written, read and put together."""
    e = F.col("e")
    at = F.concat((e % 8).cast("string"), F.lit("/"))
    rows = cam_gt(spark, sf_dir).select("e", F.concat(at, "fname").alias("image"), F.concat(at, F.lit("img_"), e.cast("string"), F.lit(".json")).alias("annotation"))
    parts = []
    for k, name in enumerate(("even", "odd")):
        path = folder(spark, "manifest")
        tables.write_arrays(rows.where(e % 2 == k), F.floor(e / 500), path)
        parts.append(tables.manifest(spark, path, name, "*.txt"))
    out = tables.union(parts)
    number = F.regexp_extract("annotation", "img_([0-9]+)", 1).cast("long")
    return out.select(number.alias("e"), "source", "image", "annotation")


@query(f"WITH {PRED_SQL} SELECT e, id IS NULL OR id = '' AS without_id, length(output_text) AS n FROM outputs")
def output_files(spark, sf_dir):
    """Model outputs as JSON arrays in files, read back."""
    path = folder(spark, "outputs")
    o = outputs(spark, sf_dir)
    tables.write_arrays(o.select("e", "id", F.concat(F.col("e").cast("string"), F.lit("|"), "output_text").alias("output_text")), F.floor(F.col("e") / 500), path)
    got = tables.model_outputs(spark, path)
    text = F.col("output_text")
    return got.select(F.substring_index(text, "|", 1).cast("long").alias("e"), (F.coalesce("id", F.lit("")) == "").alias("without_id"), F.length(F.substring_index(text, "|", -1)).cast("long").alias("n"))


@query("SELECT event_id AS iter, round(value, 6) AS loss FROM events")
def log_lines(spark, sf_dir):
    """A training log of JSON lines, read back."""
    path = folder(spark, "log")
    table(spark, sf_dir, "events").select(F.col("event_id").alias("iter"), F.col("value").alias("loss")).write.json(path)
    return tables.jsonl(spark, path).select("iter", F.round("loss", 6).alias("loss"))


@query(f"WITH {ERR_SQL} SELECT pr.fname, round(roll, 6) AS roll, round(pitch, 6) AS pitch, round(640 / 2e0 / tan(vfov / 2), 3) AS f, 320e0 AS px, 0e0 AS k1 FROM pr")
def prediction_files(spark, sf_dir):
    """Predictions as CSV with six decimals, some columns read back with their defaults."""
    path = folder(spark, "predictions")
    p = E.predictions(outputs(spark, sf_dir)).withColumns({"width": F.lit(640), "height": F.lit(640)})
    tables.write_predictions(p, path)
    return tables.projected(spark, path, ["fname", "roll", "pitch", "f", "px", "k1"]).select("fname", "roll", "pitch", F.round("f", 3).alias("f"), "px", "k1")


@query(f"""WITH {GT_SQL}, p AS (SELECT e, (x - 4) / (4 / tan(vfov / 2)) AS u, (y - 4) / (4 / tan(vfov / 2)) AS v, -sin(roll) * cos(pitch) AS a, -cos(roll) * cos(pitch) AS b, sin(pitch) AS c FROM cam_gt, (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS y))
SELECT 'img_' || e || '.jpg' AS name, CAST(e % 8 AS INTEGER) AS folder, CAST(192 AS INTEGER) AS n, round(avg(asin(greatest(-0.999999e0, least(0.999999e0, (u * a + v * b + c) / sqrt(u * u + v * v + 1))))), 4) AS lat FROM p GROUP BY e""")
def map_files(spark, sf_dir):
    """Camera maps written as a tree of folders, single precision, and read back."""
    path = folder(spark, "maps")
    px = fields.packed_field(cam_gt(spark, sf_dir).select("e", F.col("fname").alias("name"), "roll", "pitch", "vfov"), 8, 8)
    packed = F.concat("up_x", "up_y", "lat").cast("array<float>")
    maps = px.select("name", F.lit(8).alias("w"), F.lit(8).alias("h"), packed.alias("map"), (F.col("e") % 8).cast("int").alias("folder"))
    tables.write_by(maps, "folder", path)
    got = spark.read.parquet(path)
    lat = F.slice("map", 129, 64)
    return got.select("name", "folder", F.size("map").alias("n"), F.round(fields.packed_mean(F.transform(lat, lambda x: x.cast("double"))), 4).alias("lat"))


@query(f"WITH {GT_SQL} SELECT CASE WHEN e % 10 = 0 THEN 'test' WHEN e % 10 = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, round(avg(vfov), 6) AS vfov FROM cam_gt GROUP BY 1")
def split_files(spark, sf_dir):
    """Metadata as CSV by split, and what each split holds."""
    path, e = folder(spark, "splits"), F.col("e")
    split = F.when(e % 10 == 0, "test").when(e % 10 == 1, "val").otherwise("train")
    tables.write_by(cam_gt(spark, sf_dir).select("fname", "roll", "pitch", "vfov", "width", "height", split.alias("split")), "split", path, "csv")
    got = spark.read.schema("fname string, roll double, pitch double, vfov double, width int, height int, split string").option("header", True).csv(path)
    return got.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("vfov"), 6).alias("vfov"))


@query(f"WITH {PRED_SQL} SELECT fname AS name, round(CAST(vfov AS FLOAT), 4) AS vfov FROM cam_pred")
def export_files(spark, sf_dir):
    """Predictions exported by name in single precision, with a callback; an optional column that lacks is left out."""
    path = folder(spark, "export")
    p = cam_pred(spark, sf_dir).withColumnRenamed("fname", "name")
    tables.export(p, path, ["vfov"], ["uncertainty"], half=True, callback=lambda df: df.drop("e"))
    return spark.read.parquet(path).select("name", F.round(F.col("vfov").cast("double"), 4).alias("vfov"))


@query("SELECT event_type AS name, CAST(2 * count(*) AS BIGINT) AS n, round(2 * sum(value), 4) AS total FROM events GROUP BY 1")
def scalar_log(spark, sf_dir):
    """A log of scalars, appended to twice."""
    path = folder(spark, "scalars")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")
    for _ in range(2):
        reports.log_scalars(e, path)
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {ERR_SQL}, m AS (SELECT 'mean_' || metric AS name, round(avg(e), 3) AS v FROM lg GROUP BY metric UNION ALL SELECT 'median_' || metric, round(quantile_cont(e, 0.5), 3) FROM lg GROUP BY metric) SELECT printf('%s: %.4f', name, v) AS line FROM m")
def report_files(spark, sf_dir):
    """Detailed results as CSV, and the report as lines of text."""
    from .catalog import eval_errors

    path, e = folder(spark, "details"), eval_errors(spark, sf_dir).select("fname", *E.ERRORS)
    reports.write_details(e, reports.report(e, "fname", []), path)
    return spark.read.text(f"{path}/summary").select(F.col("value").alias("line"))


@query(f"WITH {GT_SQL} SELECT CAST(e % 4 AS BIGINT) AS part, CAST(1 AS BIGINT) AS files, true AS sized FROM cam_gt GROUP BY 1, 2, 3")
def file_listing(spark, sf_dir):
    """Visible files of a tree; those that begin with a dot or an underscore are none."""
    path = folder(spark, "tree")
    g = cam_gt(spark, sf_dir).select("fname", (F.col("e") % 4).alias("part")).repartition(4, "part")
    tables.write_by(g, "part", path)
    got = tables.files(spark, path, "*.parquet")
    part = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long")
    return got.groupBy(part.alias("part")).agg(F.count("*").alias("files"), (F.min("size") > 0).alias("sized"))
