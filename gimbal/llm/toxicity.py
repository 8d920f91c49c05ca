"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - cut_k): the thresholds are ordered and share the weights w of sparse word features.
The output is the expected grade, the sum of these probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialise, sample_ids

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The bounds of what is learnt: labelled documents, word features, and the least standardised difference and documents of a feature.
SAMPLE_DOCS, MAX_FEATURES, MIN_Z, MIN_DOCS = 20_000, 4_096, 4.5, 5
#: Bytes of a word's beginning that is a feature of its own, and the share of clean rows that the threshold may hit out of fold.
PREFIX, CLEAN_HITS = 6, 0.002

OUT = T.StructType(
    [
        T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("toxic", T.BooleanType()),
    ]
)
_SAMPLE = T.StructType(
    [
        T.StructField("sketch", T.StringType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)


def word_counts(text: str) -> dict[bytes, int]:
    """Times of each word, and of each beginning of PREFIX bytes of longer words, marked by a star."""
    words: dict[bytes, int] = {}
    for w in _WORD.findall(text.encode().lower()):
        words[w] = words.get(w, 0) + 1
    out = dict(words)
    for w, n in words.items():
        if len(w) > PREFIX:
            start = w[:PREFIX] + b"*"
            out[start] = out.get(start, 0) + n
    return out


@dataclass
class OrdinalModel:
    vocab: dict[bytes, int]
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float = 0.5  # of P(grade >= 1)

    def probabilities(self, counts: list[dict[bytes, int]]) -> np.ndarray:
        """P(grade >= k), a row per text and a column per k."""
        get, w = self.vocab.get, self.weights
        z = np.zeros(len(counts))
        for i, c in enumerate(counts):
            for word in c.keys() & self.vocab.keys():
                z[i] += w[get(word)] * np.log1p(c[word])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -40, 40)))


def ordinal_loss(p: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, l2: float) -> tuple[float, np.ndarray]:
    """The penalised negative log-likelihood a row, and its gradient. `p` has the weights, the first cut, and logs of the steps to the next ones."""
    n, k = max(1, len(grades)), len(p) - width
    w, cuts = p[:width], np.cumsum(np.concatenate([[p[width]], np.exp(p[width + 1 :])]))
    z = np.bincount(rows, w[cols] * values, len(grades))
    edge = np.concatenate([[-60.0], cuts, [60.0]])
    low, high = edge[grades] - z, edge[grades + 1] - z
    up, down = (1 / (1 + np.exp(np.clip(x, -60, 60))) for x in (low, high))  # P(>= grade), P(>= grade + 1)
    like = np.maximum(up - down, 1e-12)
    du, dd = up * (1 - up) / like, down * (1 - down) / like
    dcut = (np.bincount(grades, du, k + 2) - np.bincount(grades + 1, dd, k + 2))[1 : k + 1]
    g = np.zeros_like(p)
    g[:width] = np.bincount(cols, (dd - du)[rows] * values, width)[:width] + l2 * w
    g[width] = dcut.sum()
    for j in range(1, k):
        g[width + j] = dcut[j:].sum() * np.exp(p[width + j])
    return (l2 / 2 * float(w @ w) - float(np.log(like).sum())) / n, g / n


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, l2: float = 0.3, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by full-batch Adam on `ordinal_loss`, which is convex in weights and cuts.

    Grades are 0..K; those not seen still get a cut.
    """
    k = max(1, int(grades.max()) if len(grades) else 1)
    share = np.clip([(grades >= j + 1).mean() if len(grades) else 0.01 for j in range(k)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(width), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        _, g = ordinal_loss(p, rows, cols, values, grades, width, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.08 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return p[:width], np.cumsum(np.concatenate([[p[width]], np.exp(p[width + 1 :])]))


def grade_rows(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, fold: np.ndarray, width: int) -> np.ndarray:
    """Grades 0 to 3 from labels 0 and 1: a toxic row's severity is its margin under a model that hasn't seen it.

    The rows of each of two folds are placed by a one-cut model of the other fold; the toxic ones are split at the thirds of
    their fold's margins. Where a fold lacks one of the labels, its toxic rows get grade 1 by the other.
    """
    grades = y.copy()
    for f in (0, 1):
        teach, place = np.flatnonzero(fold != f), np.flatnonzero((fold == f) & (y == 1))
        if not len(place) or not 0 < y[teach].sum() < len(teach):
            continue
        at = np.full(len(y), -1)
        at[teach] = np.arange(len(teach))
        use = at[rows] >= 0
        w, _ = fit_ordinal(at[rows[use]], cols[use], values[use], y[teach], width, steps=200)
        margin = np.bincount(rows, w[cols] * values, len(y))[place]
        grades[place] = 1 + np.searchsorted(np.quantile(margin, [1 / 3, 2 / 3]), margin, side="left")
    return grades


def choose_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The least probability that no more than the share CLEAN_HITS of clean rows exceeds, within 0.1 and 0.5."""
    clean = np.sort(p[toxic == 0])[::-1]
    return float(np.clip(np.nextafter(clean[int(CLEAN_HITS * len(clean))], 1), 0.1, 0.5)) if len(clean) else 0.5


def held_out(id_col: str):
    """True for the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Learn from at most `sample_docs` labelled documents outside the held-out fold, drawn by hash.

    Labels are 0 or 1; an id with both, and a text with both, count as 1. Texts with equal words count once. The features are at most `max_features`
    words that differ most between the labels. Grades of toxic rows come from `grade_rows`, and the threshold from out-of-fold
    probabilities. Without toxic and clean rows the model is constant: nothing is toxic.
    """
    ok = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    ids = sample_ids(ok, id_col, sample_docs)
    known = ok.join(F.broadcast(ids), id_col).groupBy(F.col(id_col).alias("_g_lid")).agg(F.max(label_col).cast("int").alias("y"))
    picked = docs.select(id_col, text_col).join(F.broadcast(known), F.col(id_col) == F.col("_g_lid"))

    def make():
        def one(text: str):
            counts = word_counts(text)
            return xxhash.xxh3_128_hexdigest(b" ".join(b"%s %d" % x for x in sorted(counts.items()))), counts

        def work(texts: list[str]) -> dict[str, list]:
            got = [one(t) for t in texts]
            return {
                "sketch": [s for s, _ in got],
                "words": [[w.decode("latin-1") for w in c] for _, c in got],
                "times": [list(c.values()) for _, c in got],
            }

        return work

    rows = map_text(picked, text_col, ["y"], _SAMPLE, make)
    # Equal sketches have equal words, so it doesn't matter which row's are kept; an id may have many rows.
    sample = rows.groupBy("sketch").agg(F.max("y").alias("y"), F.any_value("words").alias("words"), F.any_value("times").alias("times"))
    sample = materialise(sample, "toxic-sample")
    n = sample.count()
    if n > sample_docs:  # ids with many rows: the share of sketches, which are hashes, that the bound allows
        sample = sample.where(F.col("sketch") < f"{int(sample_docs / n * (1 << 128)):032x}")
    n1, n = sample.agg(F.sum("y"), F.count("*")).first()
    n1, n = n1 or 0, n or 0
    empty = OrdinalModel({}, np.zeros(0), np.array([60.0]))
    if not 0 < n1 < n:
        return empty
    p = F.col("df") / n
    z = (F.col("df1") / n1 - (F.col("df") - F.col("df1")) / (n - n1)) / F.sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / (n - n1)) + 1e-12)
    words = sample.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"), F.sum("y").alias("df1"))
    vocab = (
        words.where((F.col("df") >= MIN_DOCS) & (F.col("df") < n)).select("w", z.alias("z")).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "w").limit(max_features).collect()
    )
    if not vocab:
        return empty
    table = docs.sparkSession.createDataFrame([(r.w, i) for i, r in enumerate(vocab)], "w string, f int")
    cells = sample.select("sketch", F.inline(F.arrays_zip("words", "times"))).join(F.broadcast(table), F.col("words") == F.col("w"))
    # At most sample_docs x max_features numbers, far fewer in practice.
    cells = cells.select("sketch", "f", "times").toArrow().to_pandas().sort_values(["sketch", "f"])
    known_ = sample.select("sketch", "y").toArrow().to_pandas().sort_values("sketch", ignore_index=True)
    at = {s: i for i, s in enumerate(known_["sketch"])}
    rows_ = cells["sketch"].map(at).to_numpy(dtype=np.int64)
    cols, values = cells["f"].to_numpy(dtype=np.int64), np.log1p(cells["times"].to_numpy(dtype=float))
    y, fold = known_["y"].to_numpy(dtype=np.int64), np.array([int(s[-1], 16) % 2 for s in known_["sketch"]], np.int64)
    grades = grade_rows(rows_, cols, values, y, fold, len(vocab))
    aside = np.zeros(len(y))
    for f in (0, 1):
        teach = np.flatnonzero(fold != f)
        local = np.full(len(y), -1)
        local[teach] = np.arange(len(teach))
        use = local[rows_] >= 0
        w, cuts = fit_ordinal(local[rows_[use]], cols[use], values[use], grades[teach], len(vocab), steps=200)
        aside = np.where(fold == f, 1 / (1 + np.exp(np.clip(cuts[0] - np.bincount(rows_, w[cols] * values, len(y)), -40, 40))), aside)
    weights, cuts = fit_ordinal(rows_, cols, values, grades, len(vocab))
    return OrdinalModel({r.w.encode("latin-1"): i for i, r in enumerate(vocab)}, weights, cuts, choose_cut(aside, y))


def toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """`keep` columns (default doc_id), expected `severity`, most likely `grade`, and `toxic`: P(grade >= 1) reaches the threshold, by default the model's.

    Null or empty text has no features: its severity is the base rate's, and it isn't toxic. Rows are scored one by one, repeated or not;
    input columns with an output's name are replaced. An empty table gives none.
    """
    threshold = model.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts: list[str]) -> dict[str, list]:
            counts = [word_counts(t) for t in texts]
            p = m.probabilities(counts)
            each = np.concatenate([np.ones((len(texts), 1)), p], 1) - np.concatenate([p, np.zeros((len(texts), 1))], 1)
            return {"severity": p.sum(1).tolist(), "grade": each.argmax(1).tolist(), "toxic": ((p[:, 0] >= threshold) & np.array([bool(c) for c in counts], bool)).tolist()}

        return work

    return map_text(docs, text_col, keep or ["doc_id"], OUT, make)
