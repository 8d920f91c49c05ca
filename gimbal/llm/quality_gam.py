"""Quality score: a generalised additive model with pairwise interactions.

Features are binned by quantiles of a bounded sample. Shallow trees are boosted one feature at a time, in cycles, and add
up to one lookup table per feature; then the same for the pairs that explain most of what is left. A score is a
sum of table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, sample_ids
from .quality_rules import STOP_WORDS
from .toxicity import held_out

SAMPLE_DOCS, BINS, PAIR_BINS, MAX_PAIRS = 20_000, 32, 8, 10

FEATURES = (
    "log_bytes log_words mean_word upper digit symbol bang pipe stop_mark other_mark non_ascii distinct adjacent_repeat "
    "top_word log_lines mean_line dup_lines stop_words distinct_trigrams short_words"
).split()

_CLASS = np.zeros(256, np.int64)
for _c, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"!", b"|", b".,;:?", b"\"'()[]{}=+-_/\\@^`~"), 1):
    _CLASS[list(_chars)] = _c
_CLASS[0x80:] = 9
_STOP = frozenset(w.encode() for w in STOP_WORDS)


def features(text: str) -> list[float]:
    """Numbers of a whole text, in the order of FEATURES; an empty text gives zeros."""
    raw = text.encode()
    words = raw.split()
    n = max(1, len(words))
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10).tolist()
    letters = max(1, c[1] + c[2] + c[9])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    trigrams = len(set(zip(words, words[1:], words[2:])))
    lowered = raw.lower().split()
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        c[1] / letters,
        c[3] / n,
        c[4] / n,
        c[5] / n,
        c[6] / n,
        c[7] / n,
        c[8] / n,
        c[9] / letters,
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        float(np.log1p(len(lines))),
        float(np.log1p(len(raw) / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(_STOP.__contains__, lowered)) / n,
        trigrams / max(1, len(words) - 2),
        sum(len(w) < 3 for w in words) / n,
    ]


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # edges for pairs
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for a matrix of features: one lookup and addition per table."""
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Newton values of a tree of up to `leaves` leaves over ordered bins, grown by the best gain."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + lam)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            s = np.arange(a + 1, b)
            gain = value(a, s) + value(s, b) - value(a, b)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], int(s[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """The best cross cut of a table: its gain over no cut, and the Newton values of its four parts."""
    cg = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    ch = cg.copy()
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    rg, rh, dg, dh = cg[1:-1, -1:], ch[1:-1, -1:], cg[-1:, 1:-1], ch[-1:, 1:-1]
    parts = [(a, b), (rg - a, rh - b), (dg - a, dh - b), (tg - rg - dg + a, th - rh - dh + b)]
    gain = sum(x**2 / (y + lam) for x, y in parts) - tg**2 / (th + lam)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [-(x[i, j] / (y[i, j] + lam)) for x, y in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit_additive(x: np.ndarray, y: np.ndarray, cycles: int = 120, pair_cycles: int = 40, rate: float = 0.08, lam: float = 2.0) -> AdditiveModel:
    """Fit tables to labels 0 and 1. No rows give 0.5; one class gives a constant near it."""
    if not len(y):
        return AdditiveModel(0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    model.edges = [quantiles(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [quantiles(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)
    grad = lambda: ((p := 1 / (1 + np.exp(-z))) - y, p * (1 - p))
    for _ in range(cycles):
        for b, t in zip(bins, model.tables):
            g, h = grad()
            step = rate * _shallow(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), 3, lam)
            t += step
            z += step[b]
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    wide = [len(e) + 1 for e in model.coarse]

    def table(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(small[a] * wide[b] + small[b], v, wide[a] * wide[b]).reshape(wide[a], wide[b])

    g, h = grad()
    gains = [(_quadrants(table(a, b, g), table(a, b, h), lam)[0], a, b) for a in range(x.shape[1]) for b in range(a)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:MAX_PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in model.pairs]
    for _ in range(pair_cycles):
        for (a, b), t in zip(model.pairs, model.pair_tables):
            g, h = grad()
            step = rate * _quadrants(table(a, b, g), table(a, b, h), lam)[1]
            t += step
            z += step[small[a], small[b]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(_g_lid, y, x): features of one row of each of at most `sample_docs` labelled ids outside the held-out fold, chosen by hash of the id.

    Of an id's rows that with the least hash of its text is taken. Rows without a label of 0 or 1 are left out; an id with both counts as 0.
    """
    ok = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    ids = sample_ids(ok, id_col, sample_docs)
    known = ok.join(F.broadcast(ids), id_col).groupBy(F.col(id_col).alias("_g_lid")).agg(F.min(label_col).cast("int").alias("y"))
    picked = docs.select(id_col, text_col).join(F.broadcast(known), F.col(id_col) == F.col("_g_lid"))
    picked = picked.withColumn("_g_hash", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    fields = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = map_text(picked, text_col, ["_g_lid", "y", "_g_hash"], fields, lambda: lambda texts: {"x": [features(t) for t in texts]})
    return rows.groupBy("_g_lid", "y").agg(F.min_by("x", F.struct("_g_hash", "x")).alias("x"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> AdditiveModel:
    """Learn from `training_rows`. Without any, the model is 0.5 everywhere."""
    got = training_rows(docs, labels, id_col, text_col, label_col, sample_docs).toPandas().sort_values("_g_lid")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_additive(x, got["y"].to_numpy(float))


OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def quality_scores(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per input row: the id, `held_out`, `score` in 0..1 and `predicted` (score >= threshold).

    Null text is scored as empty text, a null id is not held out, repeated rows get equal scores, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts: list[str]) -> dict[str, list]:
            s = m.scores(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
            return {"score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

        return work

    out = map_text(docs, text_col, [id_col], OUT, make)
    return out.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), "score", "predicted")
