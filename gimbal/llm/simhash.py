"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is a ring of `segments` parts. If two fingerprints differ in at most t bits, some
part starts a chain in which the first l parts differ in at most l*t/segments bits, for every l. Chains must
therefore begin with ceil(segments/t)-1 equal parts: these are the join key. The following parts are
tested against their growing budgets before the full Hamming distance. Keys with many holders take more parts.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialise
from .components import components

#: Pairs are listed within a bucket of up to this many fingerprints; in larger ones the chain's key grows by a part.
PAIR_BUCKET = 32

_FP = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text: A-Z lower-cased, blank-separated words, repeats included."""
    words = text.encode().lower().split()  # bytes: splits at the six ASCII blanks, lower-cases A-Z only
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams = [join(words)]
    else:
        grams = map(join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        block = h[at : at + (1 << 15)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """`keep` columns and `fp` (long). Null text has no words, and so the fingerprint zero."""

    def make():
        return lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]}

    return map_text(docs, text_col, keep or ["doc_id"], _FP, make)


def _rotate(fp: Column, n: int) -> Column:
    return fp if n == 0 else F.shiftleft(fp, 64 - n).bitwiseOR(F.shiftrightunsigned(fp, n))


def _part_key(rot: Column, i: Column, length: int, width: int) -> Column:
    """The first `length` parts of a ring that starts at part i, and i itself, as one number."""
    mask = (1 << (length * width)) - 1
    return rot.bitwiseAND(F.lit(_signed(mask))) + F.shiftleft(i.cast("long"), length * width)


def links(fps: DataFrame, max_bits: int = 2, segments: int = 8, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct `fp` within `max_bits` bits.

    A chain begins with equal parts. Fingerprints that share this key are compared in a list of up to `pair_bucket`; a key
    with more holders makes its chains longer by one part: each fingerprint is held under its own longer key, and looks up
    the keys that the chain's budget allows, one bit apart at most. The last but one part leaves 2 ** (64 / segments)
    holders at most, so lists are bounded without leaving a pair out.
    """
    width = 64 // segments
    if not 1 <= max_bits <= 2 or 64 % segments or math.ceil(segments / max_bits) - 1 < 1 or width > 8:
        raise ValueError("max_bits must be 1 or 2, and segments divide 64 into parts of 8 bits at most with a chain of one equal part at least")
    lead = math.ceil(segments / max_bits) - 1

    def viable(x: Column, y: Column) -> Column:
        """The full distance, and the budget of every prefix of the chain."""
        diff = x.bitwiseXOR(y)
        test = F.bit_count(diff) <= max_bits
        for n in range(segments - 1, lead, -1):
            test = (F.bit_count(diff.bitwiseAND(F.lit((1 << (n * width)) - 1))) <= (n * max_bits) // segments) & test
        return test

    chains = F.array(*[F.struct(F.lit(i).alias("i"), _rotate(F.col("fp"), i * width).alias("rot")) for i in range(segments)])
    rows, out = fps.select(F.inline(chains)), None
    for n in range(lead, segments):
        key, final = _part_key(F.col("rot"), F.col("i"), n, width), n == segments - 1
        held = rows.withColumn("key", key)
        sizes = held.groupBy("key").agg(F.count("*").alias("n")).select(F.bitwise_not("key").alias("k"), "n")
        if n == lead:  # a key of one holder has no pair
            sizes = sizes.where("n > 1")
        # Joined on another form of the key, so that both sides are dealt anew and a hot key's rows can be split among tasks.
        sized = held.join(sizes, F.bitwise_not("key") == F.col("k")).select("i", "rot", "key", "n")
        sized = materialise(sized, "chains")
        lists = (sized if final else sized.where(F.col("n") <= pair_bucket)).groupBy("key").agg(F.collect_list("rot").alias("rots"))
        if n == lead:
            rots = F.col("rots")
            later = lambda x, at: F.transform(F.filter(F.slice(rots, at + 2, F.size(rots)), lambda y: viable(x, y)), lambda y: F.struct(x.alias("x"), y.alias("y")))
            found = lists.select(F.shiftright("key", lead * width).cast("int").alias("i"), F.inline(F.flatten(F.transform(rots, later))))
        else:
            # Keys that differ from a row's own in the parts after the lead, by one bit if the budget has one.
            flips = [0, *[1 << b for b in range(lead * width, n * width)]] if (n * max_bits) // segments else [0]
            near = F.array(*[F.col("rot").bitwiseXOR(F.lit(_signed(f))) for f in flips])
            asks = rows.select("i", "rot", F.explode(near).alias("at")).select("i", "rot", _part_key(F.col("at"), F.col("i"), n, width).alias("key"))
            met = asks.join(lists.select(F.bitwise_not("key").alias("k"), "rots"), F.bitwise_not("key") == F.col("k"))
            found = met.select("i", F.col("rot").alias("x"), F.explode(F.filter("rots", lambda y: viable(F.col("rot"), y))).alias("y")).where("x != y")
        back = F.lit(64) - F.col("i") * width
        unrotate = lambda c: F.when(F.col("i") == 0, F.col(c)).otherwise(_turn(F.col(c), back))
        edges = found.select(unrotate("x").alias("a"), unrotate("y").alias("b"))
        out = edges if out is None else out.union(edges)
        rows = sized.where(F.col("n") > pair_bucket).select("i", "rot")
        if final or not rows.limit(1).count():
            return out
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _turn(c: Column, n: Column) -> Column:
    """Rotate right by a column of 1 to 63 bits."""
    low = F.call_function("shiftrightunsigned", c, n)
    high = F.call_function("shiftleft", c, F.lit(64) - n)
    return high.bitwiseOR(low)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, segments: int = 8
) -> DataFrame:
    """One row per input row: the id, `fingerprint` (16 hex digits) and `component_id`, the least id reachable by links.

    Equal fingerprints are linked too; texts without words share the fingerprint zero. Null ids are never a
    component's id unless it has no other. Repeated rows stay repeated. Links are sought between distinct fingerprints only,
    so groups of copies of any size cost one row each.
    """
    marked = materialise(fingerprints(docs, text_col, [id_col], shingle), "simhash")
    fps = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "fingerprints")
    roots = materialise(components(links(fps.select("fp"), max_bits, segments)), "roots")
    named = roots.join(fps, F.col("node") == F.col("fp"))
    least = named.groupBy("root").agg(F.min("first").alias("least")).select(F.bitwise_not("root").alias("r"), "least")
    group = roots.join(least, F.bitwise_not("root") == F.col("r")).select("node", "least")
    of = fps.join(group, F.col("fp") == F.col("node"), "left").select(
        F.bitwise_not("fp").alias("f"), F.coalesce("least", "first").alias("component_id")
    )
    return marked.join(of, F.bitwise_not("fp") == F.col("f")).select(
        F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
