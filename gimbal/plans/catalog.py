"""Registry of the engine's queries and their DuckDB SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import numeric as N
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import fields as P
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators.estimate import fit_cameras
from ..operators.ranking import ranked
from ..operators.store import written
from ..streaming.events import windowed
from .fixtures import GT_SQL, PRED_SQL, cam_gt, cam_pred, outputs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(**columns):
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eval_errors(spark, sf_dir):
    return E.errors(cam_gt(spark, sf_dir), E.predictions(outputs(spark, sf_dir)))


def long_errors(spark, sf_dir):
    """(metric, e), parsed and joined once: counts, ends and points are read from it."""
    return written(M.long_form(eval_errors(spark, sf_dir).select("fname", *E.ERRORS), ["fname"], E.ERRORS).select("metric", "e"), "errors")


# The grammar: an optional sign, digits, and (lenient: always) a point and digits; three of them, blanks allowed around the commas.
_DEC, _NUM, _SEP = r"([+-]?\d+\.\d+)", r"([+-]?\d+(?:\.\d+)?)", r"\s*,\s*"
_LENIENT, _BASE = _SEP.join([_DEC] * 3), r"are:\s*" + _SEP.join([_NUM] * 3) + r"[\.\s]*$"
_ANSWER = r"<answer>\s*" + _SEP.join([_NUM] * 3) + r"\s*</answer>"
ERR_SQL = (
    PRED_SQL
    + rf""", x AS (SELECT regexp_replace(regexp_replace(id, '^.*/', ''), '\.[^.]*$', '') || '.jpg' AS fname, regexp_matches(output_text, '{_LENIENT}') AS hit,
  regexp_extract(output_text, '{_LENIENT}', ['a','b','c']) AS m FROM outputs WHERE id <> ''),
pr AS (SELECT fname, round(CASE WHEN hit THEN TRY_CAST(m.a AS DOUBLE) ELSE 0 END, 6) AS roll, round(CASE WHEN hit THEN TRY_CAST(m.b AS DOUBLE) ELSE 0 END, 6) AS pitch,
  round(CASE WHEN hit THEN TRY_CAST(m.c AS DOUBLE) ELSE 0.9163 END, 6) AS vfov FROM x),
er AS (SELECT g.fname, abs(pr.roll / pi() * 180 - g.roll / pi() * 180) AS roll_error, abs(pr.pitch / pi() * 180 - g.pitch / pi() * 180) AS pitch_error,
  abs(CASE WHEN height > width THEN 2 * atan(tan(pr.vfov / 2) * height / width) ELSE pr.vfov END / pi() * 180 - g.vfov / pi() * 180) AS vfov_error
  FROM cam_gt g JOIN pr ON g.fname = pr.fname),
lg AS (SELECT 'roll_error' AS metric, roll_error AS e FROM er UNION ALL SELECT 'pitch_error', pitch_error FROM er UNION ALL SELECT 'vfov_error', vfov_error FROM er)"""
)
AUC_SQL = """, rk AS (SELECT metric, e, row_number() OVER (PARTITION BY metric ORDER BY e) AS i, count(*) OVER (PARTITION BY metric) AS n,
  lag(e) OVER (PARTITION BY metric ORDER BY e) AS p FROM lg),
s AS (SELECT metric, avg(CASE WHEN e <= 1 THEN 1e0 ELSE 0e0 END) AS s FROM lg GROUP BY metric),
th AS (SELECT unnest([1e0, 5e0, 10e0]) AS threshold),
ar AS (SELECT metric, threshold, sum((e - greatest(coalesce(p, 1), 1)) * (2 * i - 1) / (2e0 * n)) AS a, max(e) AS le, max(i) / CAST(max(n) AS DOUBLE) AS lr
  FROM rk, th WHERE e > 1 AND e <= threshold GROUP BY metric, threshold),
au AS (SELECT s.metric, th.threshold, round((s + coalesce(a, 0) + (th.threshold - coalesce(le, 1)) * coalesce(lr, s)) / th.threshold, 4) AS auc
  FROM s CROSS JOIN th LEFT JOIN ar ON ar.metric = s.metric AND ar.threshold = th.threshold)"""


@query(f"WITH {ERR_SQL}{AUC_SQL} SELECT lg.metric, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median, max(a1.auc) AS auc_1, max(a5.auc) AS auc_5, max(a10.auc) AS auc_10 FROM lg JOIN au a1 ON lg.metric = a1.metric AND a1.threshold = 1 JOIN au a5 ON lg.metric = a5.metric AND a5.threshold = 5 JOIN au a10 ON lg.metric = a10.metric AND a10.threshold = 10 GROUP BY lg.metric")
def und_eval_summary(spark, sf_dir):
    """Parse model outputs, join them to the ground truth, and summarise the errors."""
    long = long_errors(spark, sf_dir)
    stats = M.summary(long, 6)
    areas = M.auc(long, [1.0, 5.0, 10.0]).groupBy("metric").agg(*[F.max(F.when(F.col("threshold") == t, F.col("auc"))).alias(f"auc_{t}") for t in (1, 5, 10)])
    return stats.join(areas, "metric")


@query(f"WITH {ERR_SQL} SELECT fname, round(roll_error, 6) AS roll_error, round(pitch_error, 6) AS pitch_error, round(vfov_error, 6) AS vfov_error FROM er")
def und_eval_detail(spark, sf_dir):
    e = eval_errors(spark, sf_dir)
    return e.select("fname", *r6(**{c: F.col(c) for c in E.ERRORS}))


@query(f"WITH {ERR_SQL}{AUC_SQL} SELECT metric, threshold, auc FROM au")
def auc_by_threshold(spark, sf_dir):
    return M.auc(long_errors(spark, sf_dir), [1.0, 5.0, 10.0])


@query(f"WITH {ERR_SQL} SELECT metric, t AS threshold, round(avg(CASE WHEN e < t THEN 1e0 ELSE 0e0 END), 6) AS recall FROM lg, (SELECT unnest([1e0, 3e0, 5e0, 10e0]) AS t) GROUP BY metric, t")
def recall_at(spark, sf_dir):
    out = M.recall_at(M.long_form(eval_errors(spark, sf_dir), ["fname"], E.ERRORS), [1.0, 3.0, 5.0, 10.0])
    return out.select("metric", "threshold", F.round("recall", 6).alias("recall"))


@query("SELECT event_type, round(quantile_cont(CASE WHEN event_id % 5 <> 0 THEN value END, 0.05), 6) AS q05, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS mean, round(quantile_cont(CASE WHEN event_id % 5 = 0 THEN 1e9 ELSE value END, 0.5), 6) AS median_miss FROM events GROUP BY event_type")
def nan_statistics(spark, sf_dir):
    """Quantile and mean that skip NaN, and a median in which NaN is a miss (here a large number)."""
    e = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    miss = F.when(M.as_miss(e) == M.INF, F.lit(1e9)).otherwise(e)
    rows, by = table(spark, sf_dir, "events"), ["event_type"]
    out = rows.groupBy(*by).agg(F.round(F.avg(M.finite(e)), 6).alias("mean"))
    for name, value, q in (("q05", M.finite(e), 0.05), ("median_miss", miss, 0.5)):
        out = M.matched(out, M.quantile(rows, by, value, q, name), by, "left")
    return out.select("event_type", *r6(q05=F.col("q05")), "mean", *r6(median_miss=F.col("median_miss")))


@query("SELECT event_type AS category, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS weighted, round(quantile_disc(value, 0.5), 6) AS lower_median, count(*) AS n FROM events GROUP BY event_type")
def weighted_category_mean(spark, sf_dir):
    w = 1 + F.col("user_id") % 3
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "category")
    means = rows.groupBy("category").agg(F.round(M.weighted_mean(F.col("value"), w), 6).alias("weighted"), F.count("*").alias("n"))
    out = M.matched(means, M.quantile(rows, ["category"], F.col("value"), 0.5, "lower_median", lower=True), ["category"], "left")
    return out.select("category", "weighted", *r6(lower_median=F.col("lower_median")), "n")


@query("SELECT event_id AS iter, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def loss_rolling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("iter"), "value", F.lit(1).alias("g"))
    rows = ranked(rows, ["g"], F.floor(F.col("iter") / 1000), [F.col("iter")], "i")  # ids may have gaps
    out = M.rolling_mean(rows, "i", "value", 100, 1000)
    return out.select("iter", F.round("rolling", 6).alias("rolling"))


@query("SELECT event_id, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS recall FROM events")
def error_cdf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = ranked(e.select("event_id", "event_type", "value"), ["event_type"], None, [F.col("value"), F.col("event_id")], "i", "n")
    return out.select("event_id", F.round(F.col("i") / F.col("n"), 6).alias("recall"))


def three_sql(pattern: str, text: str, rows: str) -> str:
    cols = ", ".join(f"CASE WHEN hit THEN round(CAST(m.{c} AS DOUBLE), 6) END AS {n}" for c, n in zip("abc", ("roll", "pitch", "vfov")))
    return f"SELECT e, {cols} FROM (SELECT e, regexp_matches({text}, '{pattern}') AS hit, regexp_extract({text}, '{pattern}', ['a','b','c']) AS m FROM {rows})"


def three(text, pattern):
    return r6(**dict(zip(("roll", "pitch", "vfov"), X.triple(text, pattern))))


@query(f"WITH {PRED_SQL} {three_sql(_BASE, 'output_text', 'outputs')}")
def parse_base(spark, sf_dir):
    """The three numbers of a plain caption, whole or with decimals; null where there are none."""
    return outputs(spark, sf_dir).select("e", *three(F.col("output_text"), X.BASE))


COT_SQL = PRED_SQL + """, cot AS (SELECT e, '<think>  look' || chr(10) || 'up ' || e || chr(160) || chr(12288) || '</think><answer>' || CASE WHEN e % 3 = 0 THEN printf('%.4f ,%.4f , %.4f ', roll, pitch, vfov)
  WHEN e % 13 = 0 THEN '.5, 1, 2' ELSE printf('%.4f, %.4f, %.4f', roll, pitch, vfov) END || '</answer>' AS text FROM cam_pred)"""


def cot(spark, sf_dir):
    p, e = cam_pred(spark, sf_dir), F.col("e")
    numbers = F.when(e % 3 == 0, F.format_string("%.4f ,%.4f , %.4f ", "roll", "pitch", "vfov")).when(e % 13 == 0, ".5, 1, 2").otherwise(F.format_string("%.4f, %.4f, %.4f", "roll", "pitch", "vfov"))
    return p.select("e", F.concat(F.lit("<think>  look\nup "), e.cast("string"), F.lit("\u00a0\u3000</think><answer>"), numbers, F.lit("</answer>")).alias("text"))


@query(f"WITH {COT_SQL} SELECT t.*, 'look' || chr(10) || 'up ' || e AS thought FROM ({three_sql(_ANSWER, 'text', 'cot')}) t")
def parse_thinking(spark, sf_dir):
    """The thoughts, stripped, and the three numbers of the answer."""
    t = F.col("text")
    return cot(spark, sf_dir).select("e", X.think(t).alias("thought"), *three(t, X.ANSWER))


@query(f"WITH {PRED_SQL} SELECT e, CASE WHEN output_text LIKE 'The camera%' THEN output_text ELSE 'Scene. ' || output_text END AS sentence, 'Scene. ' || output_text AS merged FROM outputs")
def camera_sentence(spark, sf_dir):
    """The sentence on the camera alone, or the whole caption without one."""
    full = F.concat(F.lit("Scene. "), F.col("output_text"))
    return outputs(spark, sf_dir).select("e", X.camera_sentence(full).alias("sentence"), full.alias("merged"))


@query("SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pages")
def path_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.stem(F.col("url")).alias("stem"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.caption'), '') AS caption FROM events")
def json_field(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", X.json_text(p, "k").alias("k"), X.json_text(p, "caption").alias("caption"))


@query(f"WITH {GT_SQL} SELECT e FROM cam_gt WHERE e % 10 = 0")
def missing_predictions(spark, sf_dir):
    return cam_gt(spark, sf_dir).join(cam_pred(spark, sf_dir), "fname", "left_anti").select("e")


@query(f"WITH {PRED_SQL} SELECT g.e, CASE WHEN g.e % 4 = 0 THEN 'present' WHEN p.e IS NOT NULL THEN 'copy' ELSE 'missing' END AS action FROM cam_gt g LEFT JOIN cam_pred p ON g.fname = p.fname")
def split_copy_plan(spark, sf_dir):
    """Present already, to be copied from the source, or in neither."""
    want = cam_gt(spark, sf_dir).select("e", "fname")
    here = want.where("e % 4 = 0").select("fname")
    rest = want.join(here, "fname", "left_anti")
    source = cam_pred(spark, sf_dir).select("fname")
    parts = [(want.join(here, "fname", "left_semi"), "present"), (rest.join(source, "fname", "left_semi"), "copy"), (rest.join(source, "fname", "left_anti"), "missing")]
    out = None
    for df, name in parts:
        df = df.select("e", F.lit(name).alias("action"))
        out = df if out is None else out.unionByName(df)
    return out


@query(f"WITH {PRED_SQL} SELECT a.e, b.e AS partner FROM (SELECT e, row_number() OVER (ORDER BY fname) AS i FROM cam_gt) a JOIN (SELECT e, row_number() OVER (ORDER BY fname) AS i FROM cam_pred) b ON a.i = b.i")
def zip_join(spark, sf_dir):
    """Pair two lists by position in the order of their names."""

    def numbered(df, name):
        return ranked(df.select(F.col("e").alias(name), "fname", F.lit(1).alias("g")), ["g"], None, [F.col("fname")], "i").select(name, "i")

    return numbered(cam_gt(spark, sf_dir), "e").join(numbered(cam_pred(spark, sf_dir), "partner"), "i").drop("i")


@query(f"WITH {GT_SQL} SELECT e, width > 80 AND height > 80 AND width * 1e0 / height > 0.1 AND width * 1e0 / height < 10 AS valid, width <= 512 AND height <= 512 AND width % 32 = 0 AND height % 32 = 0 AS sized FROM cam_gt")
def image_valid(spark, sf_dir):
    """Validity of images by size and shape, and whether they have been brought to the training size."""
    w, h = F.col("width"), F.col("height")
    ratio = w / h
    valid = (w > 80) & (h > 80) & (ratio > 0.1) & (ratio < 10)
    return cam_gt(spark, sf_dir).select("e", valid.alias("valid"), ((w <= 512) & (h <= 512) & (w % 32 == 0) & (h % 32 == 0)).alias("sized"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM documents)) WHERE i BETWEEN 5 AND 9) GROUP BY source")
def folder_slice(spark, sf_dir):
    """Rows of the fifth to the ninth folder in the order of names; folders are sources here."""
    docs = table(spark, sf_dir, "documents").select("source")
    names = docs.where("source IS NOT NULL").distinct().orderBy("source").offset(4).limit(5)
    return docs.join(names, "source", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {GT_SQL} SELECT e, CAST(CASE WHEN width >= height THEN 512 ELSE ceil(width * (512e0 / greatest(width, height)) / 32) * 32 END AS INTEGER) AS w, CAST(CASE WHEN height >= width THEN 512 ELSE ceil(height * (512e0 / greatest(width, height)) / 32) * 32 END AS INTEGER) AS h, CAST(width * 320 // least(width, height) AS INTEGER) AS sw, CAST(height * 320 // least(width, height) AS INTEGER) AS sh, CAST((width - least(width, height)) // 2 AS INTEGER) AS crop_left, CAST((height - least(width, height)) // 2 AS INTEGER) AS crop_top FROM cam_gt")
def size_plans(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    d, s, c = C.dynamic_size(w, h), C.resize_plan(w, h, 320), C.centre_crop(w, h)
    return cam_gt(spark, sf_dir).select("e", d[0].alias("w"), d[1].alias("h"), s[0].alias("sw"), s[1].alias("sh"), c[0].alias("crop_left"), c[1].alias("crop_top"))


HASH = "sha256(concat_ws('|', {}))"
UNIT = "(('0x' || substr(" + HASH + ", 1, 8))::BIGINT / 4294967296e0)"


@query(f"SELECT event_id, CAST((row_number() OVER (ORDER BY {HASH.format(chr(39) + 'run' + chr(39) + ', event_id')}, event_id) - 1) % 8 AS BIGINT) AS shard FROM events")
def shard_rows(spark, sf_dir):
    return S.shard(table(spark, sf_dir, "events"), "event_id", 8, "run").select("event_id", F.col("shard").cast("long").alias("shard"))


@query(f"WITH p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format(chr(39) + 'mix' + chr(39) + ', event_id')}, event_id) AS pos, CASE event_type WHEN 'click' THEN 8 WHEN 'view' THEN 8 ELSE 1 END AS r FROM events) SELECT event_id, CAST((pos - 1) // 16 AS BIGINT) AS batch, CAST((pos - 1) // 16 // r AS BIGINT) AS cycle, CAST((pos - 1) // 16 % r AS BIGINT) AS slot FROM p")
def batch_schedule(spark, sf_dir):
    """Sources are the event types; all but two repeat once a cycle."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    repeats = {"click": 8, "view": 8}
    out = S.batches(e, "event_type", "event_id", {}, repeats, "mix", size=16, repeat=1)
    return out.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("batch", "cycle", "slot")])


@query(f"SELECT event_id, {UNIT.format(chr(39) + 'drop' + chr(39) + ', event_id')} < 0.1 AS dropped, list_extract(['a', 'b', 'c', 'd'], CAST(floor({UNIT.format(chr(39) + 'prompt' + chr(39) + ', event_id')} * 4) + 1 AS BIGINT)) AS prompt, round(-45 + 90 * {UNIT.format(chr(39) + 'roll' + chr(39) + ', event_id')}, 6) AS roll_deg FROM events")
def sampling(spark, sf_dir):
    """Text dropped at random, a prompt chosen from a list, and a uniform parameter."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k, (S.unit("drop", k) < 0.1).alias("dropped"), S.choose(["a", "b", "c", "d"], "prompt", k).alias("prompt"), F.round(-45 + 90 * S.unit("roll", k), 6).alias("roll_deg")
    )


@query("SELECT event_id // 16 AS batch, event_type, count(*) AS n, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY event_id), ',') AS members FROM events GROUP BY 1, 2")
def task_batches(spark, sf_dir):
    """Rows of a batch collected by task type."""
    e = table(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 16))
    return e.groupBy("batch", "event_type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("members"))


@query(f"WITH {GT_SQL} SELECT e, CAST(yaw AS INTEGER) AS view, round(yaw * 22.5e0, 6) AS yaw_deg FROM cam_gt, (SELECT unnest(range(16)) AS yaw)")
def view_plan(spark, sf_dir):
    g = cam_gt(spark, sf_dir)
    return g.select("e", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("view")).withColumn("yaw_deg", F.round(F.col("view") * 22.5, 6))


TURN_SQL = "t AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)"


@query(f"WITH {TURN_SQL}, u AS (SELECT conv_id, turn, len(w) AS n, role = 'assistant' AS own, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t) SELECT conv_id, turn, CAST(n AS BIGINT) AS n_ids, CAST(CASE WHEN own THEN n ELSE 0 END AS BIGINT) AS n_labels, before IS NULL OR before = 'assistant' AS needs_bos, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS BIGINT) AS start FROM u")
def conv_labels(spark, sf_dir):
    """Ids and unmasked labels of each turn, by a white-space tokenizer; a turn after an answer begins anew."""
    t = table(spark, sf_dir, "conversations")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("role").over(w)
    t = t.withColumn("n_ids", n)
    return t.select("conv_id", "turn", "n_ids", F.when(F.col("role") == "assistant", F.col("n_ids")).otherwise(0).alias("n_labels"), (before.isNull() | (before == "assistant")).alias("needs_bos"), (F.sum("n_ids").over(w) - F.col("n_ids")).alias("start"))


@query(f"WITH {TURN_SQL} SELECT conv_id, turn, CAST(greatest(0, 64 - len(w)) AS BIGINT) AS padding, array_to_string(w[1:8], ' ') AS head, array_to_string(w[greatest(1, len(w) - 7):], ' ') AS tail FROM t")
def pad_truncate(spark, sf_dir):
    """Left padding to 64 ids, and cuts from the right and from the left to 8."""
    w = F.col("w")
    t = table(spark, sf_dir, "conversations").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    tail = F.slice(w, F.greatest(F.lit(1), F.size(w) - 7), F.lit(8))
    return t.select("conv_id", "turn", F.greatest(F.lit(0), 64 - F.size(w)).cast("long").alias("padding"), F.array_join(F.slice(w, 1, 8), " ").alias("head"), F.array_join(tail, " ").alias("tail"))


GRAV = "-sin(roll) * cos(pitch) AS gx, -cos(roll) * cos(pitch) AS gy, sin(pitch) AS gz"


@query(f"WITH {GT_SQL}, g AS (SELECT e, vfov, height, pitch, {GRAV} FROM cam_gt), f AS (SELECT *, height / 2e0 / tan(vfov / 2) AS f FROM g) SELECT e, round(f, 6) AS f, round(2 * atan(height / (2 * f)), 6) AS vfov, round(tan(pitch) * f / height, 6) AS rho, round(CASE WHEN gy >= 0 THEN -asin(-gx / (sqrt(1 - gz * gz) + 1e-4)) - pi() * sign(gx) ELSE asin(-gx / (sqrt(1 - gz * gz) + 1e-4)) END, 6) AS roll, round(asin(gz), 6) AS pitch FROM f")
def camera_round_trips(spark, sf_dir):
    h = F.col("height")
    g = cam_gt(spark, sf_dir).withColumn("f", C.fov2focal(F.col("vfov"), h))
    roll, pitch = C.roll_pitch(*C.gravity(F.col("roll"), F.col("pitch")))
    return g.select("e", *r6(f=F.col("f"), vfov=C.focal2fov(F.col("f"), h), rho=C.pitch2rho(F.col("pitch"), F.col("f"), h), roll=roll, pitch=pitch))


R2 = "(x * x + y * y)"
DIST_SQL = f"d AS (SELECT e, roll / 2 AS x, pitch / 2 AS y, (e % 21 - 10) / 50e0 AS k1, (e % 11 - 5) / 100e0 AS k2 FROM cam_gt)"


@query(f"WITH {GT_SQL}, {DIST_SQL} SELECT e, round(1 + k1 * {R2}, 6) AS simple, round(1 + k1 * {R2} + k2 * {R2} * {R2}, 6) AS radial, round(CASE WHEN k1 * {R2} = 0 THEN 1 ELSE (1 - sqrt(greatest(1 - 4 * k1 * {R2}, 0))) / (2 * k1 * {R2}) END, 6) AS divisional, round(1 - k1 * {R2} + (3 * k1 * k1 - k2) * {R2} * {R2}, 6) AS back_radial, round(1 / (1 + k1 * {R2}), 6) AS back_divisional FROM d")
def distort_models(spark, sf_dir):
    e = F.col("e")
    d = cam_gt(spark, sf_dir).select("e", (F.col("roll") / 2).alias("x"), (F.col("pitch") / 2).alias("y"), ((e % 21 - 10) / 50).alias("k1"), ((e % 11 - 5) / 100).alias("k2"))
    a = [F.col(c) for c in ("x", "y", "k1", "k2")]
    return d.select("e", *r6(simple=C.distortion("simple_radial", *a), radial=C.distortion("radial", *a), divisional=C.distortion("simple_divisional", *a), back_radial=C.undistortion("radial", *a), back_divisional=C.undistortion("simple_divisional", *a)))


@query(f"WITH {GT_SQL}, f AS (SELECT *, height / 2e0 / tan(vfov / 2) AS f FROM cam_gt) SELECT e, round(f * 0.5, 6) AS f, round((width - 64) * 0.5e0, 6) AS w, round((width / 2e0 - 32) * 0.5, 6) AS cx FROM f")
def scale_crop(spark, sf_dir):
    f = C.fov2focal(F.col("vfov"), F.col("height"))
    cam = {"w": F.col("width"), "h": F.col("height"), "fx": f, "fy": f, "cx": F.col("width") / 2, "cy": F.col("height") / 2}
    out = C.scale_camera(C.crop_camera(cam, F.lit(-64), F.lit(-64)), F.lit(0.5), F.lit(0.5))
    return cam_gt(spark, sf_dir).select("e", *r6(f=out["fx"], w=out["w"], cx=out["cx"]))


@query(f"WITH {GT_SQL}, g AS (SELECT e, width, height, height / 2e0 / tan(vfov / 2) AS f, {GRAV} FROM cam_gt) SELECT e, round(height / 2e0 - ((0 - width / 2e0) * gx + f * gz) / gy, 4) AS y_left, round(height / 2e0 - ((width - width / 2e0) * gx + f * gz) / gy, 4) AS y_right FROM g")
def horizon(spark, sf_dir):
    g = cam_gt(spark, sf_dir)
    a, b = C.horizon(F.col("roll"), F.col("pitch"), C.fov2focal(F.col("vfov"), F.col("height")), F.col("width") / 2, F.col("height") / 2, F.col("width"))
    return g.select("e", F.round(a, 4).alias("y_left"), F.round(b, 4).alias("y_right"))


@query(f"WITH {PRED_SQL}, j AS (SELECT g.e, g.roll AS r1, g.pitch AS p1, p.roll AS r2, p.pitch AS p2, g.vfov AS v1, p.vfov AS v2, g.height AS h FROM cam_gt g JOIN cam_pred p ON g.e = p.e) SELECT e, round(acos(greatest(-1, least(1, sin(r1) * cos(p1) * sin(r2) * cos(p2) + cos(r1) * cos(p1) * cos(r2) * cos(p2) + sin(p1) * sin(p2)))) / pi() * 180, 4) AS gravity_error, round(abs(h / 2e0 / tan(v1 / 2) - h / 2e0 / tan(v2 / 2)) / (h / 2e0 / tan(v1 / 2)), 6) AS focal_error FROM j")
def camera_errors(spark, sf_dir):
    p = cam_pred(spark, sf_dir).select("e", *[F.col(c).alias(f"{c}2") for c in ("roll", "pitch", "vfov")])
    j = cam_gt(spark, sf_dir).join(p, "e")
    angle = C.gravity_angle(C.gravity(F.col("roll"), F.col("pitch")), C.gravity(F.col("roll2"), F.col("pitch2")))
    f1, f2 = C.fov2focal(F.col("vfov"), F.col("height")), C.fov2focal(F.col("vfov2"), F.col("height"))
    return j.select("e", F.round(angle, 4).alias("gravity_error"), F.round(F.abs(f1 - f2) / f1, 6).alias("focal_error"))


def field_sql(n: int) -> str:
    return f"""{GT_SQL}, px AS (SELECT e, x, y, (x - {n // 2}) / ({n // 2} / tan(vfov / 2)) AS u, (y - {n // 2}) / ({n // 2} / tan(vfov / 2)) AS v, {GRAV}
  FROM cam_gt, (SELECT unnest(range({n})) AS x), (SELECT unnest(range({n})) AS y)),
fl AS (SELECT e, x, y, (gx - gz * u) / sqrt((gx - gz * u) * (gx - gz * u) + (gy - gz * v) * (gy - gz * v)) AS up_x, (gy - gz * v) / sqrt((gx - gz * u) * (gx - gz * u) + (gy - gz * v) * (gy - gz * v)) AS up_y,
  asin(greatest(-0.999999e0, least(0.999999e0, (u * gx + v * gy + gz) / sqrt(u * u + v * v + 1)))) AS lat FROM px)"""


def field(spark, sf_dir, size):
    """The field of every camera on a grid of size x size pixels."""
    return P.perspective_field(cam_gt(spark, sf_dir), size, size, key="e")


@query(f"WITH {field_sql(32)} SELECT e, CAST(y AS INTEGER) AS y, round(sum(up_x * (x + 1)) / 32, 5) AS up_x, round(sum(up_y * (x + 1)) / 32, 5) AS up_y, round(sum(lat * (x + 1)) / 32, 5) AS lat FROM fl GROUP BY e, y")
def perspective_field(spark, sf_dir):
    """The field of every camera at 32 x 32 pixels, each image line as its values weighted by their place."""
    lines = P.field_lines(P.dealt(cam_gt(spark, sf_dir).select("e", "roll", "pitch", "vfov"), "e"), 32, 32)
    out = lines.select("e", F.posexplode(F.arrays_zip("up_x", "up_y", "lat")).alias("y", "v"))
    return out.select("e", "y", *[F.round(F.col(f"v.{c}"), 5).alias(c) for c in ("up_x", "up_y", "lat")])


def pair_sql(n: int) -> str:
    """Pixels of true and predicted cameras, with confidences."""
    one = lambda t: f"SELECT e, x, y, (gx - gz * u) / n AS up_x, (gy - gz * v) / n AS up_y, lat FROM (SELECT e, x, y, u, v, gx, gy, gz, sqrt((gx - gz * u) * (gx - gz * u) + (gy - gz * v) * (gy - gz * v)) AS n, asin(greatest(-0.999999e0, least(0.999999e0, (u * gx + v * gy + gz) / sqrt(u * u + v * v + 1)))) AS lat FROM (SELECT e, x, y, (x - {n // 2}) / ({n // 2} / tan(vfov / 2)) AS u, (y - {n // 2}) / ({n // 2} / tan(vfov / 2)) AS v, {GRAV} FROM {t}, (SELECT unnest(range({n})) AS x), (SELECT unnest(range({n})) AS y)))"
    return f"""{PRED_SQL}, a AS ({one('cam_pred')}), b AS ({one('cam_gt')}),
er AS (SELECT a.e, acos(greatest(-1, least(1, a.up_x * b.up_x + a.up_y * b.up_y))) / pi() * 180 AS up, abs(a.lat - b.lat) / pi() * 180 AS lat, (1 + (a.x + 2 * a.y + a.e) % 5) / 6e0 AS c FROM a JOIN b ON a.e = b.e AND a.x = b.x AND a.y = b.y)"""


@query(f"""WITH {pair_sql(16)} SELECT e, round(avg(up), 5) AS up_error, round(quantile_disc(up, 0.5), 5) AS up_med_error, round(avg(CASE WHEN up < 5 THEN 1e0 ELSE 0e0 END), 6) AS up_recall, round(sum(up * c) / sum(c), 5) AS up_weighted,
  round(avg(lat), 5) AS lat_error, round(quantile_disc(lat, 0.5), 5) AS lat_med_error, round(avg(CASE WHEN lat < 5 THEN 1e0 ELSE 0e0 END), 6) AS lat_recall, round(sum(lat * lat * c) / sum(c), 4) AS lat_loss FROM er GROUP BY e""")
def field_error(spark, sf_dir):
    """Predicted fields against the true ones by image: mean, lower median, recall, mean by confidence, and a loss by normalised confidence."""
    n = 16
    true = cam_gt(spark, sf_dir).select("e", *[F.col(c).alias(f"{c}2") for c in ("roll", "pitch", "vfov")])
    both = cam_pred(spark, sf_dir).select("e", "roll", "pitch", "vfov").join(true, "e")

    def confidence(rows):
        p = np.arange(n * n)
        return (1 + (p % n + 2 * (p // n) + rows["e"].to_numpy()[:, None]) % 5) / 6

    err = P.field_errors(P.dealt(both, "e"), n, n, 5.0, confidence)
    five = ("up_error", "up_med_error", "up_weighted", "lat_error", "lat_med_error")
    return err.select("e", *[F.round(c, 5).alias(c) for c in five], F.round("lat_loss", 4).alias("lat_loss"), *r6(up_recall=F.col("up_recall"), lat_recall=F.col("lat_recall")))


@query(f"""WITH {PRED_SQL}, t AS ({three_sql(_BASE, 'output_text', 'outputs')}), p AS (SELECT e, roll, pitch, vfov, x, y, (x - 16) / (16 / tan(vfov / 2)) AS u, (y - 16) / (16 / tan(vfov / 2)) AS v, {GRAV} FROM t, (SELECT unnest(range(32)) AS x), (SELECT unnest(range(32)) AS y) WHERE roll IS NOT NULL)
SELECT e, round(avg((gx - gz * u) / sqrt((gx - gz * u) * (gx - gz * u) + (gy - gz * v) * (gy - gz * v))), 5) AS up_x, round(avg((gy - gz * v) / sqrt((gx - gz * u) * (gx - gz * u) + (gy - gz * v) * (gy - gz * v))), 5) AS up_y,
  round(avg(asin(greatest(-0.999999e0, least(0.999999e0, (u * gx + v * gy + gz) / sqrt(u * u + v * v + 1))))), 5) AS lat FROM p GROUP BY e""")
def camera_map(spark, sf_dir):
    """Captions to camera maps, here of 32 x 32 pixels: the mean of each channel. Captions without parameters have none."""
    o = outputs(spark, sf_dir)
    maps = P.field_means(P.caption_cameras(P.dealt(o.select("e", "output_text"), "e"), "output_text", strict=False).where("roll IS NOT NULL"), 32, 32)
    return maps.select("e", *[F.round(c, 5).alias(c) for c in ("up_x", "up_y", "lat")])


@query("SELECT event_id, CAST(len(list_filter(list_transform(range(11), lambda i: -5 + i * 50e0), lambda b: b < value)) - 1 AS INTEGER) AS bin, CAST(least(greatest(ceil((value - 90 + 90) / 18) - 1, 0), 9) AS INTEGER) AS lat_bin FROM events")
def bin_encode(spark, sf_dir):
    _, edges = N.centres_and_edges(20.0, 470.0, 10)
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", N.bucketize(v, edges).alias("bin"), N.encode_latitude(v - 90, 10).alias("lat_bin"))


@query("WITH v AS (SELECT event_id, value / 100 AS x FROM events) SELECT event_id, round(CASE WHEN x <= 1 THEN x ELSE 2 * sqrt(x) - 1 END, 6) AS huber, round(3e0 / -1 * (power(x / 3 + 1, -0.5e0) - 1) * 2, 6) AS barron, round(0.007e0 * 0.007e0 / 2 * ln(1 + x / (0.007e0 * 0.007e0)), 6) AS cauchy, round(power(x, 1 / 2.2e0), 6) AS gamma, round((ln(x + 1e-4) - ln(1e-4)) / (ln(1 + 1e-4) - ln(1e-4)), 6) AS log_map FROM v")
def losses_and_tone_maps(spark, sf_dir):
    x = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", *r6(huber=N.huber(x), barron=N.barron(x, -1.0), cauchy=N.cauchy(x), gamma=N.tone_gamma(x), log_map=N.tone_log(x)))


@query(f"WITH {GT_SQL} SELECT e, round(roll, 6) AS roll, round(pitch, 6) AS pitch, round(vfov, 6) AS vfov FROM cam_gt")
def lm_fit(spark, sf_dir):
    """Fit cameras to their own fields of 32 x 32 pixels: the known answer comes back."""
    cams = P.dealt(cam_gt(spark, sf_dir).select("e", "roll", "pitch", "vfov"), "e")
    return fit_cameras(cams, 32, 32, own=True).select("e", *r6(roll=F.col("roll"), pitch=F.col("pitch"), vfov=F.col("vfov")))


@query(f"WITH {GT_SQL} SELECT 'roll' AS parameter, CAST(floor((roll / pi() * 180 + 45) / 0.9) AS BIGINT) AS bin, count(*) AS n FROM cam_gt GROUP BY 1, 2 UNION ALL SELECT 'vfov', CAST(floor((vfov / pi() * 180 - 20) / 0.9) AS BIGINT), count(*) FROM cam_gt GROUP BY 1, 2")
def param_histogram(spark, sf_dir):
    g = cam_gt(spark, sf_dir)
    deg = lambda c, low: F.floor((C.rad2deg(F.col(c)) - low) / 0.9)
    long = g.select(F.inline(F.array(F.struct(F.lit("roll").alias("parameter"), deg("roll", -45).alias("bin")), F.struct(F.lit("vfov").alias("parameter"), deg("vfov", 20).alias("bin")))))
    return long.groupBy("parameter", "bin").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT user_id, event_id, event_type = 'error' AS interrupted, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) SELECT user_id, event_id FROM c WHERE i = 1 OR (i <= 5 AND NOT interrupted)")
def checkpoint_keep(spark, sf_dir):
    """The newest five of each owner; an interrupted one only if it is the newest."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    c = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w)).where("i <= 5")  # which Spark also applies before the shuffle
    return c.where((F.col("i") == 1) | ((F.col("i") <= 5) & (F.col("event_type") != "error"))).select("user_id", "event_id")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Counts and sums by hour and type, as the streaming job has them (an extension)."""
    out = windowed(table(spark, sf_dir, "events"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
