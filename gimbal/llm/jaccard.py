"""Near-duplicates by exact Jaccard similarity of word shingles, found through a prefix filter.

If the shingles of all texts are put in one order, two sets of similarity t or more share one of their first
n - ceil(t * n) + 1 shingles. These prefixes are the join key; sizes and places in the order cut pairs that can't reach
the similarity, and every pair left is verified on the whole sets. Any order finds all pairs: shingles that are common in a sample
come last, so that a frequent passage is no key unless a text consists of little else.

In a bucket of many texts each is first compared with three of them, then those not yet linked with more of them drawn by hash, round by
round. Once these links are contracted, only texts outside a bucket's main component are compared with all of other components, each pair
in one bucket only. So a large group of near copies doesn't cost its square, and no pair is left out.

Rows that can't have a partner are held back before a shuffle by a bitmap of bounded size; a full bitmap would only
let more of them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, map_text, materialise, maybe, temporary
from .components import components

#: Pairs are listed at once within a bucket of up to this many sets.
PAIR_BUCKET = 32
#: Sets that tell which shingles are common (expected: so many, or this share of all), times that make one common, and the most such shingles.
SAMPLE, SHARE, COMMON, MOST = 5_000, 0.001, 3, 100_000
#: Partners drawn from a bucket in each round.
ROUNDS = (48,)

_PREFIX = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
_ROWS = "key long, node long, n int, i int"


def shingles(text: str, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles: A-Z lower-cased, blank-separated; a shorter text is one shingle."""
    words = text.encode().lower().split()  # bytes: splits at the six ASCII blanks, lower-cases A-Z only
    if not words:
        return np.zeros(0, np.int64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    grams = [join(words)] if len(words) < shingle else map(join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter((digest(g, seed) for g in grams), np.uint64).view(np.int64))


def _node(of: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(of.tobytes()) - (1 << 63)


def _common(docs: DataFrame, text_col: str, rid: Column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of rows, drawn by hash, holds COMMON times or more, and how often. The sample grows with the rows."""
    share = min(1.0, max(SHARE, SAMPLE / max(1, docs.count())))
    some = docs.where(F.pmod(rid, F.lit(1 << 30)) < int(share * (1 << 30)))
    fields = T.StructType([T.StructField("sh", T.ArrayType(T.LongType()))])
    seen = map_text(some, text_col, [], fields, lambda: lambda texts: {"sh": [shingles(t, shingle) for t in texts]})
    often = seen.select(F.explode("sh").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    often = often.orderBy(F.desc("n"), "key").limit(MOST).toArrow().sort_by("key")
    return often["key"].to_numpy(), often["n"].to_numpy()


def _prefixes(docs: DataFrame, text_col: str, keep: list[str], shingle: int, least: float, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """`keep` columns, `node` (hash of the set), its size `n`, and `keys`, its first shingles in the order. Null text has no words."""

    def first(of: np.ndarray) -> np.ndarray:
        if not len(of):
            return of
        times = np.zeros(len(of), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, of), len(common) - 1)
            times = np.where(common[at] == of, counts[at], 0)
        return of[np.argsort(times, kind="stable")][: len(of) - int(np.ceil(least * len(of) - 1e-9)) + 1]

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            sets = [shingles(t, shingle) for t in texts]
            return {"node": [_node(x) for x in sets], "n": [len(x) for x in sets], "keys": [first(x) for x in sets]}

        return work

    return map_text(docs, text_col, keep, _PREFIX, make)


def _shared(firsts: DataFrame) -> DataFrame:
    """(key, node, n, i): prefix shingles that two sets or more hold, with their place in each."""
    used = firsts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
    used = materialise(used.where("c > 1").select("key"), "used")
    bits = firsts.sparkSession.sparkContext.broadcast(bitmap(used, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            flat, size = keys.flatten().to_numpy(zero_copy_only=False), keys.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            hit = maybe(bits.value, flat)
            row = row[hit]
            columns = [flat[hit], batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], place[hit].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "i"])

    rows = firsts.select("node", "n", "keys").mapInArrow(run, _ROWS)
    # Joined on another form of the key, so that both sides are dealt anew and a hot key's rows can be split among tasks.
    other = used.select(F.bitwise_not("key").alias("k")).hint("merge")
    return materialise(rows.join(other, F.bitwise_not("key") == F.col("k"), "left_semi").distinct(), "shared")


@dataclass
class Sets:
    """Where the sets of nodes come from: the documents, and the row (hash of its key) that stands for each node."""

    docs: DataFrame
    text_col: str
    rid: Column
    rows: DataFrame  # node, rid
    shingle: int

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, sh) of `nodes` (n, complements): the sets anew from the texts. Texts of other rows aren't hashed."""
        wanted = materialise(self.rows.join(nodes.distinct().hint("merge"), F.bitwise_not("node") == F.col("n"), "left_semi").select("rid"), "wanted")
        bits, shingle = self.docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "rid")), self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.flatnonzero(maybe(bits.value, batch.column(0).to_numpy()))
                for at in range(0, len(hit), 512):
                    sets = [shingles(t or "", shingle) for t in batch.column(1).take(pa.array(hit[at : at + 512])).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "sh"])

        return self.docs.select(self.rid.alias("rid"), self.text_col).mapInArrow(run, "node long, sh array<long>").dropDuplicates(["node"])


def _in_reach(least: float, places: bool = True) -> Column:
    """Whether two sets of sizes n and n2 can be that similar if they meet first at places i and i2 of the order."""
    n, m = F.col("n"), F.col("n2")
    sizes = (n >= least * m - 1e-9) & (m >= least * n - 1e-9)
    return sizes & (F.least(n - F.col("i"), m - F.col("i2")) * (1 + least) >= least * (n + m) - 1e-9) if places else sizes


def _enough(keys: Column, least: float) -> Column:
    """Whether two sets of sizes n and n2 that share so many prefix keys can be that similar.

    All but n - overlap shingles of a set are shared, also of those in its prefix; where the prefix ends first in the
    order, these are in the other prefix too.
    """
    n, m = F.col("n"), F.col("n2")
    overlap = F.ceil(least / (1 + least) * (n + m) - 1e-9)
    need = lambda k: k - F.ceil(least * k - 1e-9) + 1 - (k - overlap)
    return F.size(keys) >= F.least(need(n), need(m))


def _pairs(left: DataFrame, right: DataFrame, least: float, also: Column) -> DataFrame:
    """(a, b) that share a key and can still reach the similarity; columns are those of the prefixes, `key2` and so on at the right."""
    other = right.withColumnsRenamed({c: f"{c}2" for c in right.columns})
    out = left.join(other, (F.col("key") == F.col("key2")) & also & _in_reach(least))
    return out.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _likely(pairs: DataFrame, keyed: DataFrame, least: float) -> DataFrame:
    """The pairs whose prefixes share enough keys. `keyed` has (node, n, keys)."""
    a = keyed.select(F.bitwise_not("node").alias("na"), "n", "keys").hint("merge")
    b = keyed.select(F.bitwise_not("node").alias("nb"), F.col("n").alias("n2"), F.col("keys").alias("keys2")).hint("merge")
    out = pairs.join(a, F.bitwise_not("a") == F.col("na")).join(b, F.bitwise_not("b") == F.col("nb"))
    return out.where(_enough(F.array_intersect("keys", "keys2"), least)).select("a", "b")


def _verified(pairs: DataFrame, sets: Sets, least: float) -> DataFrame:
    """The pairs whose whole sets, of 64-bit hashes, are as similar as that."""
    pairs = materialise(pairs, "pairs")
    held = sets.of(pairs.select(F.bitwise_not("a").alias("n")).union(pairs.select(F.bitwise_not("b"))))
    out = pairs.join(held.select(F.col("node").alias("a"), F.col("sh").alias("sa")).hint("merge"), "a")
    # Many pairs may have one pivot: dealt anew, so that its rows can be split.
    other = held.select(F.bitwise_not("node").alias("nb"), F.col("sh").alias("sb")).hint("merge")
    out = out.join(other, F.bitwise_not("b") == F.col("nb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return materialise(out.where(both * (1 + least) >= least * (F.size("sa") + F.size("sb")) - 1e-9).select("a", "b"), "links")


def _rooted(large: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Rows of buckets that hold more than one component, with each set's `root` and the bucket's `main` one; none if there are none."""
    roots = materialise(components(edges), "roots").select(F.bitwise_not("node").alias("r"), "root")
    at = large.join(roots.hint("merge"), F.bitwise_not("node") == F.col("r"), "left").withColumn("root", F.coalesce("root", "node")).drop("r")
    at = materialise(at, "rooted")
    main = at.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select(F.bitwise_not("key").alias("k"), "main")
    mixed = materialise(at.join(main.hint("merge"), F.bitwise_not("key") == F.col("k")).drop("k"), "mixed")
    return mixed if mixed.limit(1).count() else None


def links(shared: DataFrame, sets: Sets, least: float = 0.8, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct sets of similarity `least` or more."""
    member = F.struct("node", "n", "i")
    sizes = shared.groupBy("key").agg(
        F.count("*").alias("held"), F.min(member).alias("p0"), F.max(member).alias("p1"), F.min_by(member, F.xxhash64("key", "node")).alias("p2")
    )
    sizes = materialise(sizes.withColumn("k", F.bitwise_not("key")).drop("key"), "sizes")
    sized = shared.join(sizes.select("k", "held").hint("merge"), F.bitwise_not("key") == F.col("k")).drop("k")
    small = sized.where(F.col("held") <= pair_bucket).drop("held")
    large = materialise(sized.where(F.col("held") > pair_bucket), "large")
    pivots = sizes.where(F.col("held") > pair_bucket).select(F.bitwise_not("k").alias("key"), F.explode(F.array("p0", "p1", "p2")).alias("p"))
    pivots = pivots.select("key", "p.*").distinct()
    near = _pairs(small, small, least, F.col("node") < F.col("node2"))
    near = near.union(_pairs(large.drop("held"), pivots, least, F.col("node") != F.col("node2"))).distinct()
    keyed = shared.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("i", "key"))).alias("keys"))
    keyed = materialise(keyed.select("node", "n", F.col("keys.key").alias("keys")), "keys")
    edges = _verified(_likely(near, keyed, least), sets, least)
    if not large.limit(1).count():
        return edges
    # A pair is met in the first key that both share among those of mixed buckets. Were there an earlier one, its bucket would have
    # compared or linked them; so the places in the order bound the pair there.
    first = F.element_at(F.array_intersect("own", "own2"), 1) == F.col("key")
    for number, draws in enumerate((*ROUNDS, None)):
        mixed = _rooted(large, edges)
        if mixed is None:
            return edges
        own = mixed.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "key"))).alias("own"))
        own = own.join(keyed.select(F.bitwise_not("node").alias("c"), "keys").hint("merge"), F.bitwise_not("node") == F.col("c"))
        own = own.select(F.bitwise_not("node").alias("r"), F.col("own.key").alias("own"), "keys")
        rows = materialise(mixed.join(own.hint("merge"), F.bitwise_not("node") == F.col("r")).drop("r"), "mixed")
        left, right, where = rows.where("root != main").drop("held"), rows.drop("held"), F.col("root") != F.col("root2")
        if draws is None:  # all that is left: pairs of different components, one of them outside the bucket's main one
            where = where & ((F.col("root2") == F.col("main2")) | (F.col("node") < F.col("node2"))) & first & _in_reach(least)
        else:  # each set outside the main component asks in one of its buckets, among members drawn by hash
            left = left.withColumn("x", F.xxhash64(F.lit(number), "key", "node"))
            least_x = left.groupBy("node").agg(F.min("x").alias("y")).select(F.bitwise_not("node").alias("r"), "y")
            left = left.join(least_x.hint("merge"), (F.bitwise_not("node") == F.col("r")) & (F.col("x") == F.col("y"))).drop("r", "x", "y")
            right = rows.where(F.pmod(F.xxhash64(F.lit(number), "node", "key"), F.col("held")) < draws).drop("held")
            where = where & _in_reach(least, places=False)
        other = right.withColumnsRenamed({c: f"{c}2" for c in right.columns})
        met = left.join(other, (F.col("key") == F.col("key2")) & where & _enough(F.array_intersect("keys", "keys2"), least))
        pairs = met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        edges = edges.union(_verified(pairs, sets, least))
    return edges


def near_copies(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 5, least: float = 0.8, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """One row per input row: the `keep` columns and `group`, the same for all texts that links of similarity `least` connect.

    Equal sets are linked, also empty ones. Repeated rows stay repeated, null values of `keep` are values, and an empty table gives none.
    """
    rid = F.xxhash64(*[F.col(f"`{c}`") for c in keep])
    with temporary(docs.sparkSession) as held:
        firsts = materialise(_prefixes(docs, text_col, keep, shingle, least, *_common(docs, text_col, rid, shingle)), "prefixes")
        shared = _shared(firsts)
        sets = Sets(docs, text_col, rid, firsts.groupBy("node").agg(F.min(rid).alias("rid")), shingle)
        roots = components(links(shared, sets, least, pair_bucket)).select(F.bitwise_not("node").alias("r"), "root")
        out = firsts.drop("keys", "n").join(roots.hint("merge"), F.bitwise_not("node") == F.col("r"), "left")
        out = materialise(out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("root", "node").alias("group")), "groups")
        held.remove(out.written)
    return out
