"""Spelling variants: words one edit apart, by asymmetric chunks.

A word contributes two disjoint chunks, its halves; a word of the same length, or one letter longer, contributes the grams that such
a chunk can equal: those at the chunk's place, or shifted by one. One edit leaves one of the two chunks whole, so that chunk and gram are a
join key, and every pair that meets is verified.

Where many words share a chunk, both sides go on: what a shared chunk leaves free of a word differs by one edit again, and is cut in
two likewise. The key then is all that lies before and behind the free letters. In the end one letter is free, or none, and whoever
meets is a pair; so no list of words that merely share a frequent chunk is ever multiplied out, and no pair is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Maximal runs of these letters are words (a fixed pattern); a run in PRIME loses a letter, by its hash.
LETTERS, PRIME = "([A-Za-z\\u00C0-\\u00FF]+)", 199
#: Words that share a chunk are compared with each gram's word, up to so many.
MOST_SHARED = 32


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): the words of whole texts, with the letters that the hash of id and word takes away.

    A null id counts as empty in the hash. Null texts have no words.
    """
    run = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(LETTERS), F.lit(1))).alias("run")
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), run)
    runs = runs.where(F.length("run") >= min_chars).select("id", ascii_lower(F.col("run")).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = h.select(F.when(F.pmod("h", F.lit(PRIME)) == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame, most_shared: int = MOST_SHARED) -> DataFrame:
    """(a, na, b, nb): every pair of distinct words (word, n) that one inserted, deleted or replaced letter turns into each other, once.

    A row of a level is a word with `free` letters from place `at` on; where `longer` is 1 it stands as the longer word of a pair, with
    one letter more free than the shorter one.
    """
    start = F.array(*[F.struct(F.lit(k).alias("longer"), F.lit(0).alias("at"), (F.length("word") - k).alias("free")) for k in (0, 1)])
    rows = words.select("word", "n", F.inline(start))
    out = None
    while rows is not None:
        half = F.floor(F.col("free") / 2).cast("int")
        # The chunk before or behind the cut is kept; with a single free letter, it is the one on either side of an inserted one.
        before = F.struct((F.col("at") + F.greatest(half, F.lit(1))).alias("at"), (F.col("free") - F.greatest(half, F.lit(1))).alias("free"))
        behind = F.struct("at", half.alias("free"))
        rows = rows.select("word", "n", "longer", F.explode(F.array(before, behind)).alias("s")).select("word", "n", "longer", "s.*")
        ends = F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + F.col("free") + F.col("longer") + 1, F.length("word"))
        rows = rows.withColumn("key", F.xxhash64(*ends, "free"))  # other words of the same hash are met too, and refused
        shorter = F.sum(1 - F.col("longer"))
        shared = rows.groupBy("key").agg(shorter.alias("shared"), F.count("*").alias("c")).where("shared > 0 AND c > 1")
        shared = shared.select(F.bitwise_not("key").alias("k"), "shared")
        # Joined on another form of the key, so that both sides are dealt anew and a hot key's rows can be split among tasks.
        rows = materialise(rows.join(shared, F.bitwise_not("key") == F.col("k")).drop("k"), "chunks")
        crowded = F.col("shared") > most_shared
        x = rows.where("longer = 0").select(F.bitwise_not("key").alias("k"), F.col("word").alias("a"), F.col("n").alias("na"))
        meet = (F.bitwise_not("key") == F.col("k")) & ((F.col("longer") == 1) | (F.col("a") < F.col("word")))
        ready = ~crowded | (F.col("free") == 0) | ((F.col("free") == 1) & (F.col("longer") == 0))
        pairs = rows.where(ready).join(x, meet).where(F.levenshtein("a", "word", 1) == 1)
        pairs = materialise(pairs.select("a", "na", F.col("word").alias("b"), F.col("n").alias("nb")), "near")
        out = pairs if out is None else out.union(pairs)
        rows = rows.where(crowded & (F.col("free") > 0)).select("word", "n", "longer", "at", "free")
        rows = rows if rows.limit(1).count() else None
    return out.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word of (word, form) with the last form that forms lead to; there must be no ring of forms."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("next")).hint("merge")
        step = now.join(ahead, F.col("root") == F.col("w"), "left")
        step = materialise(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, times: int = 5, most_shared: int = MOST_SHARED
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have `min_chars` letters and `min_count` occurrences at least. A word's form is the most frequent of its near words (of equal
    ones the least) if it occurs `times` as often, else null; `root` follows the forms to the last. Rows count as often as they occur,
    null and empty texts have no words, and a table without words gives none. Columns other than the two named are not read.
    """
    words = materialise(vocabulary(docs, id_col, text_col, min_chars, min_count), "vocabulary")
    pairs = near_words(words, most_shared)
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("v"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = F.min(F.struct((-F.col("m")).alias("m"), "v")).alias("best")
    near = both.groupBy("w").agg(F.count("*").alias("n_near"), best).select("w", "n_near", F.col("best.v").alias("v"), (-F.col("best.m")).alias("m"))
    own = words.join(near, F.col("word") == F.col("w"), "left")
    often = F.col("m") >= times * F.col("n")
    own = own.select("word", F.when(often, F.col("v")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("m")).alias("form_n"))
    own = materialise(own, "forms")
    last = roots(own.where(F.col("form").isNotNull())).withColumnRenamed("word", "w")
    out = own.join(last.hint("merge"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
