"""Queries of archives, caption files, mergeable counts, pixel errors at the published grid and nested batches, and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import text as X
from ..operators import conversations as V
from ..operators import fields, reports, states
from ..operators import sampling as S
from ..operators.store import folder
from ..sources import archives, blobs, tables
from .catalog import query, r6, table
from .fixtures import GT_SQL, PRED_SQL, cam_gt, outputs


@query("SELECT doc_id, 'pages/' || doc_id % 100 || '/' || doc_id || '.png' AS image, length(trim(coalesce(text, ''), ' \t\n\v\f\r')) > 0 AS written, sha256(coalesce(text, '')) AS digest FROM documents")
def archive_captions(spark, sf_dir):
    """A manifest and a caption of each document as members of archives: indexed, read by range, and looked up by name."""
    path, i = folder(spark, "archives"), F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.lit("captions/"), (i % 100).cast("string"), F.lit("/"), i.cast("string"), F.lit(".json"))
    image = F.concat(F.lit("pages/"), (i % 100).cast("string"), F.lit("/"), i.cast("string"), F.lit(".png"))
    captions = docs.select(name.alias("name"), F.to_json(F.struct(F.col("text").alias("caption"))).cast("binary").alias("content"))
    row = F.to_json(F.struct(image.alias("image"), name.alias("annotation")))
    lists = docs.groupBy(F.floor(i / 1000).alias("k")).agg(F.concat_ws("\n", F.collect_list(row)).alias("rows"))  # a thousand short rows each
    manifests = lists.select(F.format_string("manifest/%d.jsonl", "k").alias("name"), F.col("rows").cast("binary").alias("content"))
    archives.write_archives(captions.unionByName(manifests), path, 8)
    index = archives.index(spark, path, folder(spark, "index"))
    read = lambda start: archives.members(index.where(F.startswith("name", F.lit(start)))).select("name", F.decode("content", "utf-8").alias("text"))
    manifest = read("manifest/").select(F.explode(F.split("text", "\n")).alias("row")).select(F.from_json("row", tables.MANIFEST).alias("m")).select("m.image", "m.annotation")
    found = read("captions/").select(F.col("name").alias("annotation"), F.from_json("text", "caption string")["caption"].alias("caption"))
    both = manifest.join(found, "annotation")
    number = F.regexp_extract("annotation", "/([0-9]+)[.]json$", 1).cast("long")
    return both.select(number.alias("doc_id"), "image", (F.length(X.strip(F.col("caption"))) > 0).alias("written"), F.sha2("caption", 256).alias("digest"))


@query("SELECT s_suppkey, s_suppkey % 4 || '/' || s_suppkey || '.json' AS annotation, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name || ' of ' || s_nationkey END AS text FROM supplier")
def caption_files(spark, sf_dir):
    """A caption of each supplier as a JSON file in a tree of folders, read back by its path; every tenth has no caption, the others blanks around it."""
    path, k = folder(spark, "captions"), F.col("s_suppkey")
    name = F.concat((k % 4).cast("string"), F.lit("/"), k.cast("string"), F.lit(".json"))
    text = F.concat(F.lit(" \n"), "s_name", F.lit(" of "), F.col("s_nationkey").cast("string"), F.lit("\t"))
    content = F.when(k % 10 == 0, F.lit('{"title": "none"}')).otherwise(F.to_json(F.struct(text.alias("caption"))))
    blobs.write_files(table(spark, sf_dir, "supplier").select(name.alias("name"), content.cast("binary").alias("content")), path)
    got = tables.captions(spark, path)
    return got.select(F.regexp_extract("annotation", "/([0-9]+)[.]", 1).cast("long").alias("s_suppkey"), "annotation", "text")


_SPLIT = "CASE WHEN e % 10 = 0 THEN 'test' WHEN e % 10 = 1 THEN 'val' ELSE 'train' END"


@query(f"""WITH {GT_SQL}, v AS (SELECT {_SPLIT} AS split, 'roll' AS name, roll / pi() * 180 AS v, -45e0 AS low, 45e0 AS high FROM cam_gt UNION ALL SELECT {_SPLIT}, 'pitch', pitch / pi() * 180, -45e0, 45e0 FROM cam_gt UNION ALL SELECT {_SPLIT}, 'vfov', vfov / pi() * 180, 20e0, 105e0 FROM cam_gt),
b AS (SELECT split, name, CAST(CASE WHEN v < low THEN -1 WHEN v > high THEN 100 ELSE least(floor((v - low) / ((high - low) / 100)), 99) END AS INTEGER) AS bin, low, (high - low) / 100 AS width FROM v)
SELECT split, name, bin, round(CASE WHEN bin >= 0 THEN low + bin * width END, 6) AS low, round(CASE WHEN bin < 100 THEN low + (bin + 1) * width END, 6) AS high, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY split, name, bin, low, width""")
def split_histograms(spark, sf_dir):
    """Roll, pitch and field of view in 100 bins by split: counts of three batches, one of them written twice, merged."""
    path, e = folder(spark, "histograms"), F.col("e")
    split = F.when(e % 10 == 0, "test").when(e % 10 == 1, "val").otherwise("train")
    g = cam_gt(spark, sf_dir).select("e", split.alias("split"), *[C.rad2deg(F.col(c)).alias(c) for c in ("roll", "pitch", "vfov")])
    values = {"roll": (-45.0, 45.0), "pitch": (-45.0, 45.0), "vfov": (20.0, 105.0)}
    for batch in (0, 1, 2, 1):
        states.append(states.histograms(g.where(e % 3 == batch), ["split"], values), path, batch)
    out = states.edges(states.merged(spark, path), values)
    return out.select("split", "name", "bin", *r6(low=F.col("low"), high=F.col("high")), "n")


@query("""WITH s AS (SELECT user_id % 4 AS source, CAST(floor(least(greatest(value / 400, 0), 1) * 126) AS BIGINT) AS k, CAST(event_type = 'error' AS BIGINT) AS p FROM events),
b AS (SELECT source, k, count(*) AS n, sum(p) AS p FROM s GROUP BY source, k), t AS (SELECT unnest(range(127)) AS t), g AS (SELECT DISTINCT source FROM s)
SELECT g.source, round(t / 126e0, 6) AS threshold, round(sum(CASE WHEN k >= t THEN p END) / CAST(sum(CASE WHEN k >= t THEN n END) AS DOUBLE), 6) AS precision, round(coalesce(sum(CASE WHEN k >= t THEN p END), 0) / CAST(nullif(sum(p), 0) AS DOUBLE), 6) AS recall
FROM g JOIN b ON b.source = g.source, t GROUP BY g.source, t""")
def recall_log(spark, sf_dir):
    """Precision and recall at 127 thresholds by source, from counts of four batches."""
    path = folder(spark, "curves")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("source"), (F.col("value") / 400).alias("score"), (F.col("event_type") == "error").alias("label"))
    for batch in range(4):
        states.append(states.scores(e.where(F.col("event_id") % 4 == batch), ["source"], "score", F.col("label")), path, batch)
    out = states.curve(states.merged(spark, path), ["source"])
    return out.select("source", *r6(threshold=F.col("threshold"), precision=F.col("precision"), recall=F.col("recall")))


_GRID = 500


@query(f"""WITH c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 480 WHEN 1 THEN 640 ELSE 960 END AS h, 640 AS w, 200e0 + s_suppkey * 53 % 701 AS f, (s_suppkey % 7 - 3) / 20e0 AS k, 200e0 + s_suppkey * 53 % 701 + (s_suppkey % 5 - 2) AS f2, (s_suppkey % 7 - 3) / 20e0 + (s_suppkey % 9 - 4) / 400e0 AS k2 FROM supplier),
g AS (SELECT *, (i / {_GRID - 1}e0 * (h - 1) - w / 2e0) / f AS u, (j / {_GRID - 1}e0 * (w - 1) - h / 2e0) / f AS v FROM c, (SELECT unnest(range({_GRID})) AS i), (SELECT unnest(range({_GRID})) AS j)),
d AS (SELECT s_suppkey, w, h, u * (1 + k * (u * u + v * v)) * f + w / 2e0 AS ax, v * (1 + k * (u * u + v * v)) * f + h / 2e0 AS ay, u * (1 + k2 * (u * u + v * v)) * f2 + w / 2e0 AS px, v * (1 + k2 * (u * u + v * v)) * f2 + h / 2e0 AS py, u * (1 + k2 * (u * u + v * v)) * f + w / 2e0 AS qx, v * (1 + k2 * (u * u + v * v)) * f + h / 2e0 AS qy FROM g),
m AS (SELECT s_suppkey, CASE WHEN px BETWEEN -1e-6 AND w - 1 + 1e-6 AND py BETWEEN -1e-6 AND h - 1 + 1e-6 THEN sqrt((ax - px) * (ax - px) + (ay - py) * (ay - py)) END AS p, CASE WHEN qx BETWEEN -1e-6 AND w - 1 + 1e-6 AND qy BETWEEN -1e-6 AND h - 1 + 1e-6 THEN sqrt((ax - qx) * (ax - qx) + (ay - qy) * (ay - qy)) END AS q FROM d WHERE ax BETWEEN -1e-6 AND w - 1 + 1e-6 AND ay BETWEEN -1e-6 AND h - 1 + 1e-6),
s AS (SELECT s_suppkey, count(*) AS n, {", ".join(f"count(CASE WHEN {c} < {t} THEN 1 END) AS {c}{i}" for c in "pq" for i, t in enumerate(("0.5e0", "1e0", "3e0", "5e0")))} FROM m GROUP BY s_suppkey)
{" UNION ALL ".join(f"SELECT s_suppkey, {t} AS threshold, round(p{i} / CAST(n AS DOUBLE), 4) AS projection, round(q{i} / CAST(n AS DOUBLE), 4) AS distortion FROM s" for i, t in enumerate(("0.5e0", "1e0", "3e0", "5e0")))}""")
def pixel_grid_errors(spark, sf_dir):
    """Shares of the published grid's 500 x 500 points that a camera for each supplier misplaces by less than each threshold, by its whole projection and by distortion alone."""
    k = F.col("s_suppkey")
    f, term = 200.0 + k * 53 % 701, (k % 7 - 3) / 20
    cams = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(640).alias("width"), F.when(k % 3 == 0, 480).when(k % 3 == 1, 640).otherwise(960).alias("height"), f.alias("f"), term.alias("k1"), (f + (k % 5 - 2)).alias("f_pred"), (term + (k % 9 - 4) / 400).alias("k1_pred"))
    cams = fields.dealt(cams, "s_suppkey")
    out = fields.pixel_errors(cams, "s_suppkey", _GRID, [0.5, 1.0, 3.0, 5.0], None)
    return out.select("s_suppkey", "threshold", *[F.round(c, 4).alias(c) for c in ("projection", "distortion")])


@query(f"WITH {PRED_SQL} SELECT e, '<image>' || chr(10) || 'Describe the camera.' AS asked, output_text AS answer, CAST(4 + 1 + 3 + (e % 2) + len(list_filter(regexp_split_to_array(output_text, '\\s+'), lambda w: w <> '')) + 1 AS INTEGER) AS n_ids FROM outputs")
def image_conversations(spark, sf_dir):
    """Conversations of an image with a prompt and the answer, and how many tokens they have; odd ones are asked a word more."""
    e = F.col("e")
    rows = outputs(spark, sf_dir)
    turns = V.image_turn(F.lit("Describe the camera."), F.col("output_text"))
    longer = V.image_turn(F.lit("Now describe the camera."), F.col("output_text"))
    ids = V.encode(F.when(e % 2 == 1, longer).otherwise(turns), V.word_ids, 1, 2, image_length=4)
    return rows.select("e", turns[0]["input"].alias("asked"), turns[0]["output"].alias("answer"), F.size(ids["input_ids"]).alias("n_ids"))


@query(f"WITH {GT_SQL} SELECT e, printf('The camera parameters (roll, pitch, and field-of-view) are: %.4f, %.4f, %.4f. The deviation of the camera yaw angle is %.4f.', roll, pitch, vfov, (e % 1001) / 1000e0 * 2 * pi()) AS text FROM cam_gt")
def yaw_sentence(spark, sf_dir):
    """The sentence of a camera that has turned aside."""
    yaw = F.col("e") % 1001 / 1000 * 2 * math.pi
    return cam_gt(spark, sf_dir).select("e", X.sentence(F.col("roll"), F.col("pitch"), F.col("vfov"), yaw).alias("text"))


@query("SELECT vec_id, round(2 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + 64, 5) AS total, 2 * (vec_id % 7) + 1e0 AS deep, 'v' || vec_id AS name, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 2 * (vec_id % 3) + 1e0 END AS inside FROM embeddings")
def nested_map(spark, sf_dir):
    """Every number of a nested batch doubled and one added: in arrays of arrays, maps of structs and structs that are null; names stay."""
    i = F.col("vec_id")
    halves = F.array(F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")))
    inner = F.struct((i % 7).cast("double").alias("x"), F.concat(F.lit("v"), i.cast("string")).alias("name"))
    outer = F.when(i % 5 != 0, F.struct((i % 3).cast("double").alias("y")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", halves.alias("a"), F.create_map(F.lit("k"), inner).alias("m"), outer.alias("s"))
    got = tables.mapped(rows, lambda x: x * 2 + 1, ["a", "m", "s"])
    total = F.aggregate(F.flatten("a"), F.lit(0.0), lambda t, x: t + x)
    return got.select("vec_id", F.round(total, 5).alias("total"), F.col("m")["k"]["x"].alias("deep"), F.col("m")["k"]["name"].alias("name"), F.col("s.y").alias("inside"))


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT position, event_id, s_suppkey FROM p, n JOIN s ON s.i = p.position % n.n WHERE position < (SELECT count(*) FROM events) // n.n * n.n""")
def looped_rows(spark, sf_dir):
    """Rows of `supplier` again and again beside those of `events`, whole rounds only."""
    from ..operators.ranking import ranked

    ev = ranked(table(spark, sf_dir, "events").select("event_id"), [], None, [F.col("event_id")], "r").select("event_id", (F.col("r") - 1).alias("position"))
    sup = ranked(table(spark, sf_dir, "supplier").select("s_suppkey"), [], None, [F.col("s_suppkey")], "r").select("s_suppkey", (F.col("r") - 1).alias("i"))
    total, loop = ev.count(), sup.count()
    size, index = S.looped(total, loop)
    return ev.where(F.col("position") < size).withColumn("i", index(F.col("position"))).join(sup, "i").select("position", "event_id", "s_suppkey")


@query("SELECT vec_id, CAST(vec_id % 6 = 0 AS BOOLEAN) AS missing, 3 AS n_columns, CAST(2 AS INTEGER) AS n_flat FROM embeddings")
def reloaded_results(spark, sf_dir):
    """Detailed results saved and loaded again: NaN comes back, arrays of arrays are left out."""
    path, i = folder(spark, "results"), F.col("vec_id")
    value = F.when(i % 6 == 0, F.lit(float("nan"))).otherwise(i.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", value.alias("roll_error"), F.slice("embedding", 1, 2).alias("flat"), F.array(F.col("embedding")).alias("deep"))
    reports.save(reports.report(rows, "vec_id", []), rows, path)
    got = reports.load(spark, path)[1]
    return got.select("vec_id", F.isnan("roll_error").alias("missing"), F.lit(len(got.columns)).alias("n_columns"), F.size("flat").alias("n_flat"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def cached_paths(spark, sf_dir):
    """Cached predictions, looked up by a path that a template makes of each row, in a tree of folders."""
    path, i = folder(spark, "cache"), F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", (i % 8).alias("scene"), F.transform("embedding", lambda x: x.cast("double")).alias("points"))
    key = X.fill("{scene}/{vec_id}.npy", {"scene": F.col("scene"), "vec_id": i})
    blobs.write_files(blobs.encoded_tensors(e.withColumn("name", key), (64,), ["points"], "float64"), path)
    cache = blobs.tensor_files(spark, path).select("name", "values")
    out = tables.lookup(e.select("vec_id", key.alias("name")), cache)
    return out.select("vec_id", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
