"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every place in a text starts a suffix, of which at most the first `longest` words of its piece matter. Suffixes are routed by their two
leading words, so that all suffixes that begin alike meet in one task; there pointers to them are sorted by one word after the
other, and each partition whose words equal the pivot is a phrase: its size is the count. Partitions that hold less than `least`
are abandoned, with all longer phrases in them.

What can't be frequent is left out before anything is routed: words that aren't frequent themselves, and pairs and triples whose hash
cell isn't (a bitmap each, of a size that doesn't grow with the input: a full one lets more through, and never less). Equal suffixes of
a block of texts are added up; those of a bucket of routes travel as lists in one row. Leading pairs with very many suffixes are routed by the whole suffix; their tasks give
partial counts, which are added up afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, materialise, maybe

#: Ends of pieces become one of them; case is folded for A-Z alone.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_END = b"."
#: Bytes of text that are worked on at once, suffixes that are sorted at once, and rows of a partition that is finished by a plain sort.
BLOCK_BYTES, SORT_ROWS, SMALL = 6_000_000, 1_000_000, 256
#: Cells of the pair counts: a bitmap of 2 MB.
CELLS = 1 << 24
#: A worker's caches of word hashes: languages at once, and entries of each, at which they are emptied.
MOST_CACHES, CACHE_ENTRIES = 16, 200_000
#: Odd factor that mixes two words' hashes, modulo 2^64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Suffixes of a leading pair beyond which it is routed by whole suffixes: a quarter of a mean task's, within these limits.
HOT = (100_000, 4_000_000)


def words_of(data: bytes) -> list[bytes]:
    """The words of UTF-8 text, and `.` wherever a piece ends."""
    return data.translate(_TABLE).replace(_END, b" . ").split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of some texts of one language at a time; rows are (lang, text)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES, prepend=0, append=-1))
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            by: dict[str, list[bytes]] = {}
            part = batch.slice(lo, hi - lo)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                yield lang, words_of(_END.join(texts))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and for all words of a language together a row without a word."""
    for lang, words in _blocks(batches):
        n = Counter(words)
        n.pop(_END, None)
        if n:
            text = pa.array([*n, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text)), text, pa.array([*n.values(), n.total()], pa.int64())], names=["lang", "word", "n"])


class _Known(dict):
    """Hash of a word that may be frequent in a language; 0 for others and ends of pieces."""

    def __init__(self, lang: str, bits: bytes):
        super().__init__()
        self.lead, self.bits, self.mask = lang.encode() + b"\n", bits, len(bits) * 8 - 1
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.lead + word, 42)
        at = h & self.mask
        h = ((h if h < 1 << 63 else h - (1 << 64)) or 1) if self.bits[at >> 3] >> (at & 7) & 1 else 0
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            self[_END] = 0
        self[word] = h
        return h


class _Spans:
    """Which runs of words may be frequent in a block: hashes of m neighbouring words, and whether the bitmaps of 2 to m words have them."""

    def __init__(self, frequent: np.ndarray, usual: list[np.ndarray], cells: int):
        self.bits, self.usual, self.cells, self.known = frequent.tobytes(), usual, cells, {}

    def __call__(self, lang: str, words: list[bytes], longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For m from 2 to `longest`: the mixed hash of m words from each place on, and whether all parts that have a bitmap may be frequent."""
        if lang not in self.known:
            if len(self.known) >= MOST_CACHES:
                self.known.clear()
            self.known[lang] = _Known(lang, self.bits)
        h = np.fromiter(map(self.known[lang].__getitem__, words), np.int64, len(words))
        mixed, on, out = h.view(np.uint64), h != 0, []
        for m in range(2, longest + 1):
            mixed = (mixed[:-1] * FACTOR + h[m - 1 :].view(np.uint64)) * FACTOR
            on = on[:-1] & on[1:]
            if m - 2 < len(self.usual):
                at = np.flatnonzero(on)
                on[at] = maybe(self.usual[m - 2], _cell(mixed[at], self.cells))
            out.append((mixed.view(np.int64), on))
        return out


def _cell(mixed: np.ndarray, cells: int) -> np.ndarray:
    return (mixed.view(np.uint64) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def multikey_counts(keys: list[np.ndarray], weight: np.ndarray, least: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes of rows that weigh `least` or more: a row that has it, its last column, and the weight of all rows that have it.

    `keys` are a row's words as numbers, column by column, -1 after its end. Pointers to rows are parted by the median of three in
    the column in hand into smaller, equal and larger ones. The equal ones go on to the next column, the others stay at theirs;
    parts below `least` are abandoned. What is left in parts of up to `small` rows is sorted at the end, all at once.
    """
    order, stack, out, late = np.arange(len(weight)), [(0, len(weight), 0)], [], []
    while stack:
        lo, hi, d = stack.pop()
        part = order[lo:hi]
        if hi == lo or weight[part].sum() < least:
            continue
        if hi - lo <= small:
            late.append((lo, hi, d))
            continue
        k = keys[d][part]
        pivot = np.sort(k[[0, len(k) // 2, -1]])[1]
        less, more = k < pivot, k > pivot
        same = part[~(less | more)]
        smaller, larger = part[less], part[more]
        order[lo:hi] = np.concatenate([smaller, same, larger])
        stack += [(lo, lo + len(smaller), d), (hi - len(larger), hi, d)]
        if pivot >= 0 and (n := weight[same].sum()) >= least:
            out.append((same[0], d, n))
            if d + 1 < len(keys):
                stack.append((lo + len(smaller), hi - len(larger), d + 1))
    found = [np.array(out, np.int64).reshape(-1, 3)]
    if late:
        size = np.array([hi - lo for lo, hi, _ in late])
        rows = np.concatenate([order[lo:hi] for lo, hi, _ in late])
        part, depth = np.repeat(np.arange(len(late)), size), np.repeat([d for *_, d in late], size)
        sort = np.lexsort([*(k[rows] for k in keys[::-1]), part])
        rows, part, depth = rows[sort], part[sort], depth[sort]
        new = np.diff(part, prepend=-1) != 0
        for d, k in enumerate(keys):
            k = k[rows]
            new = new | (np.diff(k, prepend=-2) != 0)
            first = np.flatnonzero(new)
            n = np.add.reduceat(weight[rows], first)
            hit = (n >= least) & (k[first] >= 0) & (depth[first] <= d)
            found.append(np.stack([rows[first[hit]], np.full(hit.sum(), d), n[hit]], 1))
    return tuple(np.concatenate(found).T)


def _count_phrases(batches: list[pa.RecordBatch], longest: int, least: int) -> pa.RecordBatch | None:
    """(lang, phrase, a) of some buckets' suffixes (bucket, lang, hot, suffix, n; the last three are lists)."""
    flat = [[b.column(1).take(pc.list_parent_indices(b.column(2))), *(b.column(i).flatten() for i in (2, 3, 4))] for b in batches]
    table = pa.table([pa.chunked_array(c) for c in zip(*flat)], names=["lang", "hot", "suffix", "n"])
    langs = table["lang"].combine_chunks().dictionary_encode()
    split = pc.split_pattern(table["suffix"], " ").combine_chunks()
    coded = split.flatten().dictionary_encode()
    size = split.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    codes = np.append(coded.indices.to_numpy(), -1).astype(np.int32)
    keys = [langs.indices.to_numpy(), *(codes[np.where(i < size, start + i, len(codes) - 1)] for i in range(longest))]
    weight, hot = table["n"].to_numpy(), table["hot"].to_numpy()
    found = []
    for rows, floor in ((np.flatnonzero(~hot), least), (np.flatnonzero(hot), 1)):
        row, last, n = multikey_counts([k[rows] for k in keys], weight[rows], floor)
        row, last, n = (x[last >= 2] for x in (rows[row], last, n))
        found.append((row, last, n))
    row, last, n = (np.concatenate(x) for x in zip(*found))
    if not len(row):
        return None
    words = coded.dictionary.to_pylist()
    text = [" ".join([words[c] for c in codes[a : a + m]]) for a, m in zip(start[row].tolist(), last.tolist())]
    lang = langs.dictionary.take(pa.array(keys[0][row]))
    return pa.RecordBatch.from_arrays([lang, pa.array(text, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "a"])


def phrase_counts(texts: DataFrame, frequent: DataFrame, longest: int = 5, least: int = 100, cells: int = CELLS, hot: int | None = None, sieved: int = 3) -> DataFrame:
    """(lang, phrase, a) of the phrases of 2 to `longest` words that occur `least` times or more in `texts` (lang, text).

    `frequent` has the (lang, word) that do. `hot` is the number of suffixes beyond which a leading pair is split, `sieved` the most words
    that are counted by hash cells beforehand.
    """
    spark = texts.sparkSession
    words = spark.sparkContext.broadcast(bitmap(frequent.select(F.xxhash64(F.concat_ws("\n", "lang", "word")).alias("h")), "h"))

    usual: list = []  # broadcast bitmaps of the cells of 2, 3, ... words

    def cell_counts(m: int) -> DataFrame:
        """(cell, n) of m words whose parts may all be frequent, where n is `least` or more."""
        held = list(usual)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans = _Spans(words.value, [b.value for b in held], cells)
            for lang, tokens in _blocks(batches):
                if len(tokens) >= m:
                    mixed, on = spans(lang, tokens, m)[-1]
                    cell, n = np.unique(_cell(mixed[on], cells), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

        return texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    pairs = materialise(cell_counts(2), "cells")
    usual.append(spark.sparkContext.broadcast(bitmap(pairs, "cell", cells)))
    for m in range(3, min(sieved, longest) + 1):
        usual.append(spark.sparkContext.broadcast(bitmap(cell_counts(m), "cell", cells)))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot or int(np.clip(total // (4 * tasks), *HOT))
    buckets = 16 * tasks
    crowded = spark.sparkContext.broadcast(bitmap(pairs.where(F.col("n") > hot), "cell", cells))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, join = _Spans(words.value, [b.value for b in usual], cells), b" ".join
        for lang, tokens in _blocks(batches):
            if len(tokens) < 2:
                continue
            found = spans(lang, tokens, min(longest, len(tokens)))
            pair, start = found[0]
            size = 1 + start.astype(np.int64)
            for _, on in found[1:]:  # a suffix goes on while all of it may be frequent
                size[: len(on)] += on
            at = np.flatnonzero(start)
            made = [join(tokens[i : i + m]) for i, m in zip(at.tolist(), size[at].tolist())]
            n, lead = Counter(made), dict(zip(made, at.tolist()))
            if not n:
                continue
            at = np.fromiter((lead[s] for s in n), np.int64, len(n))
            split = maybe(crowded.value, _cell(pair[at], cells))
            whole = np.fromiter((xxhash.xxh64_intdigest(s) if x else 0 for s, x in zip(n, split.tolist())), np.uint64, len(n)).view(np.int64)
            bucket = (np.where(split, whole, pair[at]).view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)) != 0)
            ends = pa.array([*first, len(order)], pa.int32())
            held = (split, pa.array(list(n), pa.binary()).cast(pa.string()), np.fromiter(n.values(), np.int64, len(n)))
            lists = [pa.ListArray.from_arrays(ends, pa.array(c).take(pa.array(order))) for c in held]
            columns = [pa.array(bucket[order][first].astype(np.int64)), pa.array([lang] * len(first), pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "hot", "suffix", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after the other; whole ones are sorted together, of SORT_ROWS suffixes or more."""
        held, size = [], 0
        for batch in batches:
            if size >= SORT_ROWS:
                other = np.flatnonzero(batch.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
                if len(other):
                    if (out := _count_phrases([*held, batch.slice(0, int(other[0]))], longest, least)) is not None:
                        yield out
                    held, size, batch = [], 0, batch.slice(int(other[0]))
            held.append(batch)
            size += pc.sum(batch.column(4).value_lengths()).as_py() or 0
        if held and (out := _count_phrases(held, longest, least)) is not None:
            yield out

    routed = texts.mapInArrow(suffixes, "bucket long, lang string, hot array<boolean>, suffix array<string>, n array<long>")
    routed = routed.repartition("bucket").sortWithinPartitions("bucket")
    part = routed.mapInArrow(sort, "lang string, phrase string, a long")
    return part.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _cut(k: Column) -> tuple[Column, Column]:
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.size(words)), " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, top: int = 2000, cells: int = CELLS, hot: int | None = None
) -> DataFrame:
    """Each language's best `top` collocations: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`; null or empty texts have no words; rows count as often as they occur, and an empty table gives none.
    `a` counts the phrase, `l` and `r` the two parts of its weakest cut, `n` all words of the language; score = floor(1000 a n / (l r)).
    A phrase inside a longer one that occurs as often is left out. Ties go to the larger `a`, then to the lesser phrase. Columns
    other than the two named are not read.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    words = texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    single = words.where(F.col("word").isNotNull())
    phrases = phrase_counts(texts, single, longest, least, cells, hot).select("lang", "phrase", "a", F.size(F.split("phrase", " ")).alias("m"))
    counts = materialise(phrases.union(single.select("lang", "word", "n", F.lit(1))), "phrases")
    first, rest = _cut(F.col("k"))
    cuts = counts.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"first": first, "rest": rest})
    # The parts of a frequent phrase are frequent: both joins find every cut's.
    of = lambda part, name: counts.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(part + "_"), F.col("a").alias(name))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(of(part, name), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(part) == F.col(part + "_"))).drop(f"{name}_lang", part + "_")
    total = words.where(F.col("word").isNull()).select("lang", F.col("n").alias("n"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(total, "lang").withColumns({"up": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")), "down": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("CAST(up div down AS LONG)"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # A phrase inside a longer one that is as frequent is so inside one that has a single word more.
    longer = counts.where("m > 2").select("lang", "a", F.explode(F.array(_cut(F.lit(1))[1], _cut(F.col("m") - 1)[0])).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a")))
    left = left.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
