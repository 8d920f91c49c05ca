"""Benchmark decontamination: a broadcast hash set of test n-grams against every token window.

The set is a sorted array of 64-bit window hashes beside the items' words, against which every hit is verified: under
40 bytes per benchmark word, and the text itself. It is broadcast while the benchmark's words and characters are within checked
bounds, and so under 70 MB; beyond them the hashed windows of both sides are joined.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, map_text, materialise

WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same class on UTF-8 bytes: every byte of a character above 0x7F is above 0x7F.
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The broadcast path is taken up to so many words and characters of benchmark text.
BROADCAST_WORDS, BROADCAST_CHARS = 1_500_000, 8_000_000
#: A worker's cache of word hashes is emptied at this many entries.
CACHE_ENTRIES = 400_000
#: Odd factor of a window's places, modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def words_of(text: str) -> list[bytes]:
    return _WORD_BYTES.findall(text.encode().lower())


class _Hashes(dict):
    """64-bit hash of a word."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h
        return h


def windows(words: list[bytes], get, widths: list[int]) -> dict[int, np.ndarray]:
    """The hash of every window, by width: its words' hashes times powers of FACTOR, added up modulo 2^64."""
    h = np.fromiter(map(get, words), np.uint64, len(words))
    out, total = {}, h
    for k in range(1, min(max(widths, default=0), len(words)) + 1):
        if k > 1:
            total = total[:-1] + h[k - 1 :] * np.uint64(pow(FACTOR, k - 1, 1 << 64))
        if k in widths:
            out[k] = total
    return out


@dataclass
class Table:
    """Distinct windows of one width, by hash: where the text of each stands, and which items hold it."""

    hashes: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    holders: np.ndarray


@dataclass
class Index:
    names: list[str] = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)  # an item's words, joined by single spaces
    tables: dict[int, Table] = field(default_factory=dict)
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << 21, np.uint8))  # a bit for each 24-bit prefix of a hash

    @property
    def nbytes(self) -> int:
        return self.seen.nbytes + sum(map(len, self.texts)) + sum(a.nbytes for t in self.tables.values() for a in vars(t).values())

    def scan(self, words: list[bytes], get) -> tuple[int, list[str]]:
        """Words inside occurring windows, and the items that these belong to."""
        cover, found = None, set()
        for k, w in windows(words, get, list(self.tables)).items():
            t = self.tables[k]
            maybe = np.flatnonzero(self.seen[w >> np.uint64(43)] >> ((w >> np.uint64(40)) & np.uint64(7)).astype(np.uint8) & 1)
            at = np.searchsorted(t.hashes, w[maybe])
            same = t.hashes[np.minimum(at, len(t.hashes) - 1)] == w[maybe]
            entries = set()
            for s, e in zip(maybe[same].tolist(), at[same].tolist()):
                gram = b" ".join(words[s : s + k])
                while e < len(t.hashes) and t.hashes[e] == w[s]:
                    if self.texts[t.text[e]][t.begin[e] : t.end[e]] == gram:
                        if cover is None:
                            cover = np.zeros(len(words), bool)
                        cover[s : s + k] = True
                        entries.add(e)
                    e += 1
            for e in entries:
                found.update(t.holders[t.first[e] : t.first[e + 1]].tolist())
        return (0 if cover is None else int(cover.sum())), sorted(self.names[i] for i in found)


def build_index(items: list[tuple[str, str | None]], width: int) -> Index:
    """The index of (item id as text, text); rows that share an id are one item."""
    index, get = Index(), _Hashes().__getitem__
    numbers: dict[str, int] = {}
    parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
    owner = []
    for item, text in items:
        words = words_of(text or "")
        k = min(width, len(words))
        if not k:
            continue
        owner.append(numbers.setdefault(item, len(numbers)))
        ends = np.cumsum(np.fromiter(map(len, words), np.int32, len(words)) + 1, dtype=np.int32) - 1
        begins = np.r_[np.int32(0), ends[:-1] + 1]
        n = len(words) - k + 1
        parts.setdefault(k, []).append((windows(words, get, [k])[k], np.full(n, len(index.texts), np.int32), begins[:n], ends[k - 1 :]))
        index.texts.append(b" ".join(words))
    index.names = list(numbers)
    for k, got in sorted(parts.items()):
        h, text, begin, end = map(np.concatenate, zip(*got))
        order = np.argsort(h, kind="stable")
        h, text, begin, end = h[order], text[order], begin[order], end[order]
        keep, first, holders = [], [0], []
        edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]).tolist()
        for a, b in zip(edges, edges[1:]):
            held: dict[bytes, tuple[int, set[int]]] = {}  # by text: windows may collide
            for i in range(a, b):
                held.setdefault(index.texts[text[i]][begin[i] : end[i]], (i, set()))[1].add(owner[text[i]])
            for i, who in held.values():
                keep.append(i)
                holders += sorted(who)
                first.append(len(holders))
        pick = np.array(keep)
        index.tables[k] = Table(h[pick], text[pick], begin[pick], end[pick], np.array(first, np.int32), np.array(holders, np.int32))
        np.bitwise_or.at(index.seen, h >> np.uint64(43), np.uint8(1) << ((h >> np.uint64(40)) & np.uint64(7)).astype(np.uint8))
    return index


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    keep: list[str] | None = None,
    broadcast_words: int = BROADCAST_WORDS,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Per input row: `keep` columns (default: the id) and n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty text has no words and is never contaminated. Items with a null id or no words are skipped;
    rows that share an item id are one item. Rows that share a document id are scanned one by one.
    Input columns with an output's name are replaced. An empty benchmark leaves every document clean.
    """
    keep = keep or [id_col]
    bench = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    n_words, n_chars = bench.agg(F.sum(F.size(_words(F.col("text")))), F.sum(F.octet_length("text"))).first()
    if (n_words or 0) > broadcast_words or (n_chars or 0) > broadcast_chars:
        return _joined(docs, bench, id_col, text_col, width, keep)
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(build_index([(r.item, r.text) for r in bench.collect()], width))

    def make():
        held, get = index.value, _Hashes().__getitem__

        def work(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in OUT}
            for text in texts:
                words = words_of(text)
                n_hit, items = held.scan(words, get)
                row = (len(words), n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0)
                for f, v in zip(OUT, row):
                    out[f.name].append(v)
            return out

        return work

    return map_text(docs, text_col, keep, OUT, make)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_CLASS), F.lit(0))


def _joined(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, width: int, keep: list[str]) -> DataFrame:
    """The same rows for a benchmark of any size: hashed windows of both sides meet in a join, and hits are verified.

    Rows with the same text share their result, and a window that many items share is one row until the hits are known.
    """
    keep = [c for c in keep if c not in OUT.names]

    def spread(df: DataFrame, k) -> DataFrame:
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>"))
        return df.select("*", F.inline(F.transform(starts, lambda s: F.struct(s.alias("s"), F.xxhash64(F.slice(F.col("w"), s + 1, k)).alias("h")))))

    gram = lambda k: F.array_join(F.slice("w", F.col("s") + 1, k), " ")
    items = bench.select("item", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(width)))
    test = materialise(spread(items, F.col("k")).select("k", "h", gram(F.col("k")).alias("g"), "item").distinct(), "items")
    known = test.select(F.bitwise_not("h").alias("t"), F.col("k").alias("tk"), "g").distinct()
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # `width` rows at most
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], _words(F.col(text_col)).alias("w")).withColumn("_g_key", F.sha2(F.array_join("w", " "), 256))
    texts = rows.select("_g_key", "w").dropDuplicates(["_g_key"])
    hits = None
    for k in lengths:
        # Windows travel as hashes only; the words of a text come back to those that hit.
        there = known.where(F.col("tk") == k).select("t").distinct()
        part = spread(texts, F.lit(k)).select("_g_key", "s", "h").join(there, F.bitwise_not("h") == F.col("t"), "left_semi").withColumn("k", F.lit(k))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = texts.select("_g_key", F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("k")).limit(0)
    back = texts.withColumnRenamed("_g_key", "_g_back")
    hits = hits.join(back, F.col("_g_key") == F.col("_g_back")).select("_g_key", "s", "k", "h", F.array_join(F.slice("w", F.col("s") + 1, F.col("k")), " ").alias("gram"))
    same = (F.bitwise_not("h") == F.col("t")) & (F.col("k") == F.col("tk")) & (F.col("gram") == F.col("g"))
    hits = materialise(hits.join(known, same).select("_g_key", "s", "k", "h", "g"), "hits")
    covered = hits.select("_g_key", F.explode(F.sequence("s", F.col("s") + F.col("k") - 1)).alias("p")).distinct().groupBy("_g_key").agg(F.count("*").alias("n_hit"))
    named = hits.select("_g_key", "k", "h", "g").distinct().join(test, ["k", "h", "g"]).select("_g_key", "item").distinct()
    named = named.groupBy("_g_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    got = covered.join(named, "_g_key").withColumnRenamed("_g_key", "_g_hit")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(got, F.col("_g_key") == F.col("_g_hit"), "left").select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("w").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
