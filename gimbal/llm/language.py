"""Language identification by prediction by partial matching over bytes, under frozen statistics.

Each language has a tree of contexts of up to ORDER bytes. A byte costs log2((n + d) / c) bits in the longest context that is in the tree,
where n bytes followed the context, d of them different and c of them this one (escape method C, without exclusion); a byte
that the context has not seen costs log2((n + d) / d) for the escape, and then what it costs in the context shorter by a byte; under the
empty context all 256 bytes are alike. A text's code length is the sum, whatever the place of its bytes, so all bytes of many
texts are looked up at once: for the byte strings of any language's tree, tables hold the cost under all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the longest context, and how often one must occur in a language to be in its tree (the empty one always is).
ORDER, LEAST_SEEN = 4, 6
#: The bounds of what is learnt: texts of a language (expected, drawn by hash), and languages, the most frequent ones.
SAMPLE_TEXTS, MOST_LANGS = 1_500, 256
#: Bytes that are scored or counted at once.
BLOCK_BYTES = 1_000_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_EMPTY, _FACTOR = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Lookup:
    """Rows of `values` by 64-bit keys: open addressing in two arrays, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = 64 - max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << (64 - self.shift)) - 1)
        self.keys = np.full(int(self.mask) + 1, _EMPTY)
        self.rows, self.values = np.zeros(int(self.mask) + 1, np.int32), values
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = self.keys[at[left]] == _EMPTY
            claim = left[free]
            self.keys[at[claim]] = keys[claim]  # of two that claim a place the later one has it
            self.rows[at[claim]] = claim
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _FACTOR) >> np.uint64(self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._start(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.rows[at], -1)
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & self.mask
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            on = ~hit & (held != _EMPTY)
            left, at = left[on], at[on]
        return out


@dataclass
class Model:
    """`grams[k]`: cost under each language of a byte after k others; `escapes[k]`: cost of leaving a context of k bytes."""

    langs: list[str]
    prior: np.ndarray  # bits of naming the language
    grams: list[Lookup]
    escapes: list[Lookup]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in bits."""
        order = len(self.grams) - 1
        size = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        code = strings(texts, order)
        if len(code):
            cost = np.zeros((len(code), len(self.langs)), np.float32)
            left = np.arange(len(code))
            for k in range(order, -1, -1):
                keys = code[left] & np.uint64((1 << 8 * (k + 1)) - 1)
                row = self.grams[k].find(keys)
                hit = row >= 0
                cost[left[hit]] += self.grams[k].values[row[hit]]
                left, keys = left[~hit], keys[~hit]
                if not len(left):
                    break
                row = self.escapes[k].find(keys >> np.uint64(8))
                out_of = row >= 0
                cost[left[out_of]] += self.escapes[k].values[row[out_of]]
            cost[left] += 8  # all bytes are alike
            full = np.flatnonzero(size)
            out[full] = np.add.reduceat(cost, (np.cumsum(size) - size)[full], axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language under which prior and text are shortest (of equal ones the first by name), and its probability among all."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = self.bits([folded(t) for t in texts]) + self.prior
        best = bits.argmin(1)
        share = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
        known = [bool(_LETTER.search(t)) for t in texts]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(share, known)]


def folded(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return text.encode().lower()


def strings(texts: list[bytes], order: int) -> np.ndarray:
    """For every byte of the texts, it and the `order` bytes before it as one number; line feeds stand before a text."""
    pad = b"\n" * order
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t)]), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    own = np.repeat(np.arange(1, len(texts) + 1) * order, size) + np.arange(size.sum())
    code = np.zeros(len(own), np.uint64)
    for k in range(order, -1, -1):
        code = code << np.uint64(8) | data[own - k]
    return code


def build(langs: list[str], rows: list[int], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], order: int) -> Model:
    """The model of grams' counts: for each order, grams as numbers, the language's place in `langs`, and how often it occurs.

    `rows` are the languages' numbers of texts. All grams of a context in a language's tree must be there.
    """
    prior = -np.log2(np.maximum(rows, 1) / max(1, sum(rows)))
    grams, escapes, below = [], [], None
    for k in range(order + 1):
        gram, lang, n = counts[k]
        context = gram >> np.uint64(8)
        keys, at = np.unique(gram, return_inverse=True)
        contexts, of = np.unique(context, return_inverse=True)
        times, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(times, (of, lang), n)
        np.add.at(kinds, (of, lang), 1)
        leave = np.where(kinds > 0, np.log2(np.maximum(times + kinds, 1) / np.maximum(kinds, 1)), 0)
        if below is None:
            shorter = np.full((len(keys), len(langs)), 8.0)
        else:
            shorter = below.values[below.find(keys & np.uint64((1 << 8 * k) - 1))]
        cost = leave[np.searchsorted(contexts, keys >> np.uint64(8))] + shorter
        cost[at, lang] = np.log2((times + kinds)[of, lang] / n)
        below = Lookup(keys, cost.astype(np.float32))
        grams.append(below)
        escapes.append(Lookup(contexts, leave.astype(np.float32)))
    return Model(langs, prior, grams, escapes)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some BLOCK_BYTES of text, which is the last column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES, prepend=0, append=-1))
    for lo, hi in zip([0, *cuts[:-1]], cuts):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def held_out(docs: DataFrame, id_col: str):
    """Whether a row is left for evaluation: crc32 of the id as text leaves no remainder by 5. A row without an id isn't, nor is it learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", order: int = ORDER, least_seen: int = LEAST_SEEN, sample: int = SAMPLE_TEXTS) -> Model:
    """Learn from rows outside the held-out fold that have a text and a language.

    Of each language some `sample` different texts are taken, whole, by a hash of the text. What reaches the driver are counts of byte strings
    in contexts that occur `least_seen` times in the sample; their number is bounded by its bytes.
    """
    known = docs.where(F.col(f"`{id_col}`").isNotNull() & ~held_out(docs, id_col)).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    rows = sorted((r.lang, r.n) for r in rows)
    langs, steps = [x for x, _ in rows], 1 << 30
    if not langs:
        return Model([], np.zeros(0), [], [])
    place, share = (F.create_map(*[F.lit(v) for i, (x, n) in enumerate(rows) for v in (x, f(i, n))])[F.col("lang")] for f in (lambda i, n: i, lambda i, n: min(steps, sample * steps // n)))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(steps)) < share
    some = known.where(drawn).select(place.alias("l"), "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                own = part.column(0).to_numpy()
                texts = [folded(t) for t in part.column(1).to_pylist()]
                for lang in np.unique(own):
                    code = strings([t for t, x in zip(texts, own) if x == lang], order)
                    for k in range(order + 1):
                        gram, n = np.unique(code & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), v, np.int32)) for v in (lang, k)] + [pa.array(gram.astype(np.int64)), pa.array(n)], names=["l", "k", "gram", "n"])

    counts = some.mapInArrow(count, "l int, k int, gram long, n long").groupBy("l", "k", "gram").agg(F.sum("n").alias("n"))
    contexts = counts.groupBy("l", "k", F.shiftright("gram", 8).alias("c")).agg(F.sum("n").alias("seen"), F.collect_list(F.struct("gram", "n")).alias("g"))
    kept = contexts.where((F.col("k") == 0) | (F.col("seen") >= least_seen)).select("l", "k", F.inline("g")).toArrow()
    k, lang, gram, n = (kept[c].to_numpy() for c in ("k", "l", "gram", "n"))
    parts = [np.flatnonzero(k == i) for i in range(order + 1)]
    return build(langs, [n for _, n in rows], [(gram[p].astype(np.uint64), lang[p], n[p]) for p in parts], order)


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns, `lang_pred` and `score`, its probability.

    A null text, or one without a letter, is `und` with a score of 0; so is every text if nothing was learnt. Rows are independent, repeated or not: no
    shuffle. The outputs replace kept columns of their names.
    """
    keep = [c for c in keep if c not in OUT.names]
    held = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + list(OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                lang, score = held.value.predict([t or "" for t in part.column(len(keep)).to_pylist()])
                columns = [*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return picked.mapInArrow(run, schema).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


def languages(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Per row: the id, `held_out`, `lang_pred` and `score`, by a model of the rows that aren't held out."""
    model = train(docs, id_col, lang_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), held_out(docs, id_col).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    return identify(rows, model, ["_id", "held_out"], "_text").withColumnRenamed("_id", id_col)
