"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS

#: Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on are as with at by this from or an be "
    "de la le et les des en un une du est que qui pour dans pas par sur au "
    "der die das und den von zu mit ist ein eine auf für im nicht dem auch als "
    "el los las y del se con su al es para una"
).split()


@dataclass(frozen=True)
class Rule:
    """`metric` must lie in [low, high]; a missing bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The table. Base rules decide `base_failed`; the others can only add rejections.
BASE_RULES = (Rule("too_short", "n_words", low=50), Rule("repetitive", "pct_repeat", high=50.0))
RULES = (
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("few_stop_words", "stop_ratio", low=0.02),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("word_length", "mean_word", low=1.5, high=20.0),
)


def _passes(rule: Rule):
    test = F.lit(True)
    if rule.low is not None:
        test = test & (F.col(rule.metric) >= rule.low)
    if rule.high is not None:
        test = test & (F.col(rule.metric) <= rule.high)
    return test


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per input row: the id, counts, ratios, `failed` (names of failed rules), `base_failed` and `kept`.

    Null text has no words and no lines, so it fails `too_short`. Repeated rows and null ids are
    scored like any other row; further input columns are not read. A window repeated in the text is
    found by its 64-bit hash; sorting the hashes of one text keeps the work n log n for any length.
    """
    w = F.col("_g_words")
    s1 = docs.select(
        F.col(id_col).alias("_g_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_g_text"),
    ).select(
        "_g_id",
        "_g_text",
        F.filter(F.split("_g_text", f"{BLANK_CLASS}+", -1), lambda x: x != "").alias("_g_words"),
        F.filter(F.split("_g_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_g_lines"),
    )
    s2 = s1.select(
        "_g_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace("_g_text", f"{BLANK_CLASS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_g_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_g_text", r"\P{Lu}+", "")).alias("_g_upper"),
        F.length(F.regexp_replace("_g_text", r"\P{L}+", "")).alias("_g_letters"),
        F.size("_g_lines").alias("_g_nl"),
        (F.size("_g_lines") - F.size(F.array_distinct("_g_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("_g_stop"),
        F.when(
            F.size(w) >= 3,
            F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_g_grams"),
    )
    g, ordered, hits = F.col("_g_grams"), F.col("_g_ordered"), F.col("_g_hits")
    s3 = s2.withColumn(
        "_g_ordered",
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    s4 = s3.withColumn(
        "_g_hits",
        F.sort_array(
            F.transform(
                F.filter(
                    ordered,
                    lambda x, k: F.coalesce(
                        (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
                        (x["h"] == F.get(ordered, k - 1)["h"]),
                        (x["h"] == F.get(ordered, k + 1)["h"]),
                        F.lit(False),
                    ),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(hits, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(hits, k - 1)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    s5 = s4.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    n = F.greatest(F.col("n_words"), F.lit(1))
    s6 = s5.withColumns(
        {
            "pct_repeat": 100 * F.col("n_repeat_words") / n,
            "symbols_per_word": F.col("n_symbols") / n,
            "stop_ratio": F.col("_g_stop") / n,
            "upper_ratio": F.col("_g_upper") / F.greatest(F.col("_g_letters"), F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_g_nl"), F.lit(1)),
            "mean_word": F.col("word_chars") / n,
        }
    )
    failed = F.filter(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | ~_passes(r)
    metrics = ["symbols_per_word", "stop_ratio", "upper_ratio", "dup_line_ratio", "mean_word"]
    return s6.select(
        F.col("_g_id").alias(id_col),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base_failed.alias("base_failed"),
        (F.size(failed) == 0).alias("kept"),
        failed.alias("failed"),
        *metrics,
    )
