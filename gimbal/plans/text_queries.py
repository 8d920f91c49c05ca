"""Queries on conversations, captions, names and reports, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import conversations as V
from ..operators import evaluation as E
from ..operators import reports
from ..operators import tokens as T
from ..operators.store import written
from .catalog import AUC_SQL, ERR_SQL, eval_errors, query, r6, table
from .fixtures import PRED_SQL, outputs

ID_SQL = "list_transform(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''), lambda w: ascii(w) * 100 + length(w) % 100)"
JOIN = "array_to_string({}, ',')"


def joined(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def turns(spark, sf_dir):
    """Answers are outputs; every fifth carries no loss, every fourth turn has no end, even ones are followed by a separator."""
    t = F.col("turn")
    own = F.col("role") == "assistant"
    text = F.when(t == 0, F.concat(F.lit(f"{V.IMAGE_MARK}\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    turn = F.struct(F.when(~own, text).alias("input"), F.when(own, text).alias("output"), (t % 5 != 3).alias("l"), (t % 4 != 1).alias("e"), F.when(t % 2 == 0, "---").otherwise("").alias("s"))
    return V.collected(table(spark, sf_dir, "conversations"), "conv_id", "turn", turn)


TURNS_SQL = f"""r AS (SELECT conv_id, turn, role = 'assistant' AS own, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, CASE WHEN turn = 0 THEN list_concat(list_transform(range(6), lambda i: CASE WHEN own THEN -300 ELSE -200 END), {ID_SQL.format('text')}) ELSE {ID_SQL.format('text')} END AS w FROM r),
b AS (SELECT *, coalesce(last_value(CASE WHEN own THEN turn % 4 <> 1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS lead FROM p),
k AS (SELECT conv_id, turn, own, CASE WHEN lead THEN [1] ELSE [] END AS bos, w, CASE WHEN own AND turn % 4 <> 1 THEN [2] ELSE [] END AS eos, CASE WHEN own AND turn % 2 = 0 THEN {ID_SQL.format("'---'")} ELSE [] END AS sep FROM b),
l AS (SELECT conv_id, turn, list_concat(bos, w, eos, sep) AS ids, list_concat(list_transform(bos, lambda x: -100), CASE WHEN own AND turn % 5 <> 3 THEN list_concat(w, eos) ELSE list_transform(list_concat(w, eos), lambda x: -100) END, list_transform(sep, lambda x: -100)) AS labels FROM k),
c AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(labels ORDER BY turn)) AS labels FROM l GROUP BY conv_id)"""


@query(f"WITH {TURNS_SQL} SELECT conv_id, {JOIN.format('ids')} AS input_ids, {JOIN.format('labels')} AS labels, {JOIN.format('labels[greatest(1, len(labels) - 15):]')} AS last_labels FROM c")
def conversation_arrays(spark, sf_dir):
    """Input ids and labels of whole conversations, and the labels cut to the last sixteen."""
    rows = turns(spark, sf_dir).select("conv_id", V.encode(F.col("turns"), V.word_ids, 1, 2, image_length=6).alias("x"))
    return rows.select("conv_id", joined(F.col("x.input_ids")).alias("input_ids"), joined(F.col("x.labels")).alias("labels"), joined(V.truncated(F.col("x.labels"), 16, "left")).alias("last_labels"))


END = 50_256


@query("""WITH r AS (SELECT conv_id, turn, role = 'assistant' AS own, coalesce(text, '') AS text FROM conversations),
b AS (SELECT *, coalesce(last_value(CASE WHEN own THEN turn % 4 <> 1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS lead FROM r),
k AS (SELECT conv_id, turn, own, CASE WHEN lead THEN '<|endoftext|>' ELSE '' END AS bos, CASE WHEN turn = 0 THEN repeat('<image>', 6) || chr(10) ELSE '' END || text AS w,
  CASE WHEN own AND turn % 4 <> 1 THEN '<|endoftext|>' ELSE '' END AS eos, CASE WHEN own AND turn % 2 = 0 THEN '---' ELSE '' END AS sep FROM b)
SELECT conv_id, string_agg(bos || w || eos || sep, '' ORDER BY turn) AS input_text, string_agg(CASE WHEN own AND turn % 5 <> 3 THEN w || eos ELSE '' END, '' ORDER BY turn) AS label_text, true AS aligned, true AS shorter FROM k GROUP BY conv_id""")
def conversation_tokens(spark, sf_dir):
    """Whole conversations as ids of a published byte-pair vocabulary, and the texts that the ids and the labels stand for."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = turns(spark, sf_dir).withColumn("known", T.ids_of(V.pieces(F.col("turns")), path))
    rows = rows.select("conv_id", V.encode(F.col("turns"), lambda t: F.col("known")[t], END, END, image_length=6).alias("x"))
    ids, labels = F.col("x.input_ids"), F.col("x.labels")
    names = {V.IGNORE: "", V.IMAGE_IN: V.IMAGE_MARK, V.IMAGE_OUT: V.IMAGE_MARK, V.QUERY: V.QUERY_MARK}
    got = rows.select("conv_id", T.text_of(ids, path, names).alias("input_text"), T.text_of(labels, path, names).alias("label_text"), (F.size(ids) == F.size(labels)).alias("aligned"), F.size(ids).alias("n"))
    return got.select("conv_id", "input_text", "label_text", "aligned", (F.col("n") < F.octet_length("input_text")).alias("shorter"))


@query(f"""WITH {TURNS_SQL}, h AS (SELECT conv_id, ids[1:24] AS ids, labels[1:24] AS labels FROM c) SELECT conv_id,
  {JOIN.format('list_concat(list_transform(range(24 - len(ids)), lambda i: 0), ids)')} AS input_ids, {JOIN.format('list_concat(list_transform(range(24 - len(labels)), lambda i: -100), labels)')} AS labels,
  CAST(len(ids) AS INTEGER) AS n_seen, {JOIN.format('list_transform(range(24), lambda i: greatest(i - (24 - len(ids)), 0))')} AS position_ids,
  {JOIN.format("list_filter(list_transform(range(len(labels) - 1), lambda i: CASE WHEN labels[CAST(i + 2 AS INTEGER)] >= 0 THEN i || ':' || labels[CAST(i + 2 AS INTEGER)] END), lambda x: x IS NOT NULL)")} AS next_tokens FROM h""")
def padded_batch(spark, sf_dir):
    """Conversations cut to 24 tokens and padded on the left, with mask, positions, and the next tokens that carry loss."""
    x = turns(spark, sf_dir).select("conv_id", V.encode(F.col("turns"), V.word_ids, 1, 2, image_length=6, max_length=24).alias("x"))
    ids, labels = F.col("x.input_ids"), F.col("x.labels")
    seen = F.size(F.filter(V.mask(ids, 24), lambda m: m))
    pairs = F.transform(V.next_tokens(labels), lambda p: F.concat_ws(":", p["at"].cast("string"), p["label"].cast("string")))
    return x.select(
        "conv_id", joined(V.padded(ids, 24, 0)).alias("input_ids"), joined(V.padded(labels, 24, V.IGNORE)).alias("labels"), seen.alias("n_seen"), joined(V.positions(ids, 24)).alias("position_ids"), F.array_join(pairs, ",").alias("next_tokens")
    )


@query("""SELECT conv_id, turn, '<|im_start|>user' || chr(10) || '<|vision_start|>' || repeat('<|image_pad|>', CAST(turn + 1 AS INTEGER)) || '<|vision_end|>' || chr(10) || 'Generate a target image given an initial view: ' || t || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS cross_view,
  '<|im_start|>user' || chr(10) || 'Generate an image: ' || t || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS generation FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def chat_prompts(spark, sf_dir):
    """Prompts in the chat format, with and without an image."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.image_prompt("cross_view", t, (F.col("turn") + 1).cast("int")).alias("cross_view"), X.chat("instruction", X.chat("generation", t)).alias("generation"))


@query(f"WITH {PRED_SQL} SELECT e, printf('%s, roll-%.2f', id, roll) AS path, 'The deviation of the camera yaw angle is ' || CASE e % 4 WHEN 0 THEN '1.5710' WHEN 1 THEN '3.1416' WHEN 2 THEN '4.7120' ELSE 'unknown' END || '.' AS yaw, CASE WHEN e % 3 = 0 THEN e ELSE -1 END AS category, lower(id) LIKE '%.json' AS is_json FROM outputs JOIN cam_pred USING (e)")
def names_and_templates(spark, sf_dir):
    """Path templates, places as yaw, category labels, and the extension test."""
    from .fixtures import cam_pred

    rows = outputs(spark, sf_dir).join(cam_pred(spark, sf_dir).select("e", "roll"), "e")
    e = F.col("e")
    place = F.when(e % 4 == 0, "Left").when(e % 4 == 1, "behind").when(e % 4 == 2, "right").otherwise("up")
    yaw = X.fill("The deviation of the camera yaw angle is {yaw}.", {"yaw": F.coalesce(X.place_yaw(place), F.lit("unknown"))})
    label = F.when(e % 3 == 0, e.cast("string")).otherwise(F.concat(F.lit("c"), e.cast("string")))
    path = X.fill("{id}, roll-{roll}", {"id": F.col("id"), "roll": X.fixed(F.col("roll"), 2)})
    return rows.select("e", path.alias("path"), yaw.alias("yaw"), F.coalesce(X.category(label), F.lit(-1)).alias("category"), X.is_json(F.col("id")).alias("is_json"))


@query(f"WITH {PRED_SQL} SELECT e, CASE WHEN e % 6 = 0 THEN output_text ELSE output_text || ' looks ' || e END AS merged, 'img_' || e || '.json' AS annotation FROM outputs")
def caption_merge(spark, sf_dir):
    """A caption and the thoughts on it, looked up by one key in two tables; the second may have no tags."""
    o, e = outputs(spark, sf_dir), F.col("e")
    name = F.concat(F.lit("img_"), e.cast("string"), F.lit(".json"))
    manifest = o.select("e", name.alias("annotation"))
    base = o.select(name.alias("annotation"), F.col("output_text").alias("text"))
    thought = F.when(e % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("<think> looks "), e.cast("string"), F.lit("\n</think>x")))
    cot = o.select(name.alias("annotation"), thought.alias("cot"))
    both = manifest.join(base, "annotation").join(cot, "annotation")
    return both.select("e", F.when(F.col("cot") == "", F.col("text")).otherwise(X.merged(F.col("text"), F.col("cot"))).alias("merged"), "annotation")


REPORT_SQL = f"""WITH {ERR_SQL}{AUC_SQL} SELECT 'mean_' || metric AS name, round(avg(e), 3) AS value FROM lg GROUP BY metric UNION ALL SELECT 'median_' || metric, round(quantile_cont(e, 0.5), 3) FROM lg GROUP BY metric
UNION ALL SELECT 'auc_' || metric || '@' || CAST(threshold AS INTEGER), round(auc, 3) FROM au"""


@query(REPORT_SQL)
def evaluation_report(spark, sf_dir):
    """Every summarised metric of the detailed results by name, saved and loaded again; other columns are left out."""
    from ..operators.store import folder

    e = written(eval_errors(spark, sf_dir).select("fname", "width", "vfov", *E.ERRORS), "results")
    path = folder(spark, "evaluation")
    reports.save(reports.report(e, "fname", [1.0, 5.0, 10.0]), e, path)
    return reports.load(spark, path)[0]


@query(f"WITH {ERR_SQL}, d AS (SELECT fname, roll_error, pitch_error, CAST(substr(fname, 5, length(fname) - 8) AS BIGINT) % 3 AS m FROM er), q AS (SELECT fname, m, roll_error * (1 + m) AS a FROM d UNION ALL SELECT fname, 9, roll_error FROM d) SELECT q.fname, q.m AS model, round(q.a - y.a, 6) AS roll_error FROM q JOIN q y ON q.fname = y.fname AND y.m = 9")
def model_difference(spark, sf_dir):
    """Errors of models less those of a reference model on the same samples."""
    d = eval_errors(spark, sf_dir).select("fname", "roll_error")
    m = F.substr("fname", F.lit(5), F.length("fname") - 8).cast("long") % 3
    rows = d.select("fname", m.alias("model"), (F.col("roll_error") * (1 + m)).alias("roll_error")).union(d.select("fname", F.lit(9).cast("long"), "roll_error"))
    out = reports.against(rows, "fname", "model", 9, ["roll_error"])
    return out.select("fname", "model", *r6(roll_error=F.col("roll_error")))


@query("SELECT event_type AS category, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS mean, round(avg(CASE WHEN event_id % 5 <> 0 THEN value ELSE 0 END), 6) AS mean_zero, count(*) AS n FROM events GROUP BY 1")
def category_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    out = reports.by_category(e, "category", "v")
    return out.select("category", *r6(mean=F.col("mean"), mean_zero=F.col("mean_zero")), "n")


@query("""WITH g AS (SELECT event_id, event_id // 50 AS run, value, lag(value) OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS before FROM events),
w AS (SELECT *, max(value) OVER v AS worst, count(value) OVER v AS n FROM g WINDOW v AS (PARTITION BY run ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(value - before, 6) AS change, coalesce(abs(value - before) <= 5 + 0.1e0 * abs(before), false) AS stop, coalesce(n = 3 AND value >= worst, false) AS stalled FROM w""")
def convergence(spark, sf_dir):
    """Steps of runs that have come to rest, or have not improved on any of the last three."""
    log = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 50).alias("run"), "value")
    out = reports.converged(log, "run", "event_id", "value", 5.0, 0.1)
    return out.select("event_id", F.round("change", 6).alias("change"), "stop", "stalled")
