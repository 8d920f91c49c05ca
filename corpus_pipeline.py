"""A corpus pipeline of five stages: each takes the documents that the stage before it kept.

All but the last return the columns of `documents`. Nothing here hides an import error: without the operators'
package there is no pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gimbal.llm import decontaminate as decontamination
from gimbal.llm import toxicity as tox
from gimbal.llm.common import materialise, read, temporary
from gimbal.llm.components import components
from gimbal.llm.jaccard import near_copies
from gimbal.llm.line_dedup import line_dedup
from gimbal.llm.packing import best_fit_packing
from gimbal.llm.simhash import near_duplicates


def _without(docs: DataFrame, flag: str, names: list[str], mark: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Documents that `mark` doesn't flag, with their own columns, also where these are named like its outputs."""
    own = {c: f"_g_own_{c}" for c in docs.columns if c in names}
    marked = mark(docs.withColumnsRenamed(own), [own.get(c, c) for c in docs.columns])
    return marked.where(~F.col(flag)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't call toxic. It learns from the stage's own input and the labels.

    A null or empty text has no words and stays; repeated rows are judged alike; an empty table stays empty.
    """
    model = tox.train(docs, read(spark, sf_dir, "labels"))
    return _without(docs, "toxic", tox.OUT.names, lambda df, keep: tox.toxicity(df, model, keep=keep))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that at least three of them share removed, except in the largest id; `n_chars` follows the text.

    A null text is one empty line, and stays. Repeated rows of an id are one document, whose lines go or stay together.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least id.

    SimHashes of 5-word shingles link rows that differ in two bits at most. Texts of a Jaccard similarity of 0.8 or more of these shingles
    are linked too, as most of them differ in more bits. Every row counts by itself: rows without an id come after
    those with one, and rows that share an id don't stand for each other. An empty table stays empty.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_g_key", F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("other"), *columns).alias("y")))
    with temporary(spark) as held:
        prints = near_duplicates(keyed, "_g_key", shingle=5).select(F.col("_g_key").alias("_g_k"), F.xxhash64(F.lit("simhash"), "component_id").alias("a")).distinct()
        copies = near_copies(keyed, ["doc_id", "_g_key"])
        rows = copies.join(prints, F.col("_g_key") == F.col("_g_k")).select("doc_id", "_g_key", "a", F.xxhash64(F.lit("jaccard"), "group").alias("b"))
        rows = materialise(rows, "groups")
        roots = components(rows.select("a", "b")).select(F.bitwise_not("node").alias("r"), "root")
        least = rows.join(roots, F.bitwise_not("a") == F.col("r")).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_g_key")).alias("o"))
        kept = materialise(least.select(F.col("o.doc_id").alias("_g_id"), F.col("o._g_key").alias("_g_kept")), "kept")
        repeated = bool(rows.groupBy("doc_id", "_g_key").count().where("count > 1").limit(1).count())
        held.remove(kept.written)
    out = keyed.join(kept, (F.col("_g_key") == F.col("_g_kept")) & F.col("doc_id").eqNullSafe(F.col("_g_id")), "left_semi").drop("_g_key")
    return out.dropDuplicates() if repeated else out  # exact repeats of a kept row


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; a null text has none, repeated rows go together, and an empty table stays empty."""
    bench = read(spark, sf_dir, "benchmark")
    return _without(docs, "contaminated", decontamination.OUT.names, lambda df, keep: decontamination.decontaminate(df, bench, keep=keep))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in training sequences; a null text is one piece, and an empty table gives none.

    Repeated rows are packed each by itself, and pieces of equal length may change places.
    """
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", drop_common_lines),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL has no ordinal regression, tokenizer or XXH64; the tests hold every stage against a plain definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's output written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
