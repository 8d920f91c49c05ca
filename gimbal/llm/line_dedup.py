"""Line deduplication with DataFrame functions only.

Lines are exploded with their positions, hashed to 128 bits, written once, and counted by distinct documents.
Dropped positions come back to their document, which is reassembled from the slices between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, materialise


def _keys(text: Column) -> Column:
    """Normalised lines of a text: A-Z lower-cased, blanks stripped at both ends."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Drop lines whose key is long enough and occurs in `min_docs` documents, except in the largest id that holds it.

    Returns the input's columns with `text_col` rewritten, and `n_lines`, `n_dropped` (long).
    Null or empty text is one empty line. A null id counts as no document and never keeps a common line.
    Rows that share an id are one document for counting, and each row is rewritten by itself.
    Repeated rows stay repeated. Input columns named `n_lines` or `n_dropped` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = docs.withColumns({"_g_text": text, "_g_hash": F.xxhash64(text)})
    lines = (
        doc.select(F.col(id_col).alias("_g_id"), "_g_hash", F.posexplode(_keys(F.col("_g_text"))).alias("_g_pos", "_g_key"))
        .where(F.char_length("_g_key") >= min_chars)
        .select("_g_id", "_g_hash", "_g_pos", F.xxhash64("_g_key").alias("_g_k1"), F.xxhash64(F.lit("#"), "_g_key").alias("_g_k2"))
    )
    lines = materialise(lines, "lines")  # hashed once: they are counted, then joined
    common = (
        lines.groupBy("_g_k1", "_g_k2")
        .agg(F.count_distinct("_g_id").alias("_g_n"), F.max("_g_id").alias("_g_keep"))
        .where(F.col("_g_n") >= min_docs)
        .select(F.bitwise_not("_g_k1").alias("_g_c1"), F.bitwise_not("_g_k2").alias("_g_c2"), "_g_keep")
    )
    # Joined on the complements: both sides are dealt anew, and Spark can split the rows of a very common line.
    same = (F.bitwise_not("_g_k1") == F.col("_g_c1")) & (F.bitwise_not("_g_k2") == F.col("_g_c2"))
    dropped = (
        lines.join(common, same)
        .where(~F.col("_g_id").eqNullSafe(F.col("_g_keep")))
        .groupBy(F.col("_g_id").alias("_g_did"), F.col("_g_hash").alias("_g_dhash"))
        .agg(F.array_sort(F.collect_set("_g_pos")).alias("_g_drop"))
    )
    joined = doc.join(
        dropped, F.col(id_col).eqNullSafe(F.col("_g_did")) & (F.col("_g_hash") == F.col("_g_dhash")), "left"
    ).withColumn("_g_lines", F.split("_g_text", "\n", -1))
    kept = F.flatten(
        F.zip_with(
            F.concat(F.array(F.lit(-1)), F.col("_g_drop")),
            F.concat(F.col("_g_drop"), F.array(F.size("_g_lines"))),
            lambda a, b: F.slice(F.col("_g_lines"), a + 2, b - a - 1),
        )
    )
    own = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    out = joined.select(
        *[F.col(f"`{c}`") for c in own],
        F.when(F.col("_g_drop").isNull(), F.col("_g_text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.size("_g_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_g_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    order = [c for c in docs.columns if c in own or c == text_col]
    return out.select(*[F.col(f"`{c}`") for c in order], "n_lines", "n_dropped")
