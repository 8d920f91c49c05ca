"""Best-fit packing by length patterns.

Only the histogram of lengths (one number per length) reaches the driver. Non-negative least squares fits
repeat counts of few-document patterns to it; counts are rounded, what is left over is packed by best fit on
the histogram, and pieces find their slot by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialise

#: Entries and characters of a cached run of text.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 48
#: Pieces of one length are ranked within groups of about this many.
RANK_GROUP = 2_000


class _Runs(dict):
    """Ids of a run of text; emptied at CACHE_ENTRIES, and long runs aren't kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        got = self.encode(run)
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = got
        return got


class Encoder:
    """Token ids as little-endian 32-bit bytes, as the `tokenizers` file gives them.

    Pre-tokens never cross a single space or line feed between two other characters, so texts are cut there and
    runs are cached. A run of Latin text that isn't cached goes to the rank form of the same vocabulary, which is
    faster on short strings; any other run goes to the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("latin", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\S)")
        self.pieces = re.compile(r"\n| ?[^ \n]+").findall
        self.blank = re.compile(r"[^\S \n]").search
        self.runs = _Runs(self._encode)

    def _encode(self, run: str) -> bytes:
        if "<|" in run or not run.isprintable() and run != "\n" or max(run) >= "ɐ":
            ids = self.exact.encode(run, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(run)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _plain(self, text: str) -> bool:
        """Whether single spaces and line feeds between other characters are the only white space."""
        double = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        return not (double or text[0] in " \n" or text[-1] in " \n" or self.blank(text))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        run = self.runs.__getitem__
        if self._plain(text):
            return b"".join(map(run, self.pieces(text)))
        out = []
        for part in self.cut.split(text):
            if part[0] == "\n" and len(part) > 1 and not part[1].isspace():
                out += (run("\n"), run(part[1:]))
            else:
                out.append(run(part))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str | None = None, ranks_path: str | None = None) -> Encoder:
    import public_tokenizers

    return Encoder(
        path or public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


_PIECE = T.StructType(
    [
        T.StructField("n_ids", T.LongType()),
        T.StructField("crcs", T.ArrayType(T.LongType())),
    ]
)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32): a text's ids and `end_id`, cut so that only the first piece may be shorter."""

    def make():
        encode, end = encoder(), np.array([end_id], "<u4").tobytes()

        def work(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_ids": [], "crcs": []}
            for text in texts:
                ids = encode(text) + end
                n = len(ids) // 4
                head = n % width or width
                cuts = [0, *range(head, n, width), n]
                out["n_ids"].append(n)
                out["crcs"].append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])])
            return out

        return work

    rows = map_text(docs, text_col, [id_col], _PIECE, make)
    head = F.when(F.col("n_ids") % width == 0, width).otherwise(F.col("n_ids") % width)
    cut = rows.select(F.col(f"`{id_col}`"), "n_ids", head.alias("head"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    return cut.select(
        F.col(f"`{id_col}`"),
        "piece",
        F.when(F.col("piece") == 0, 0).otherwise(F.col("head") + (F.col("piece") - 1) * width).cast("long").alias("start"),
        F.when(F.col("piece") == 0, F.col("head")).otherwise(width).cast("long").alias("length"),
        "ids_crc32",
    )


def patterns(width: int) -> np.ndarray:
    """All sets of up to three lengths that fill `width` exactly, as rows (a, b, c), a >= b >= c, 0 for none."""
    out = [(width, 0, 0)]
    out += [(width - b, b, 0) for b in range(1, width // 2 + 1)]
    for c in range(1, width // 3 + 1):
        for b in range(c, (width - c) // 2 + 1):
            out.append((width - b - c, b, c))
    return np.array(out)


def nnls_repeats(rows: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |w(Ax - hist)|^2, A[l, p] = times that pattern p holds length l.

    A has three entries a column, so a step of accelerated projected gradient is a gather and a bincount.
    """
    n = len(hist)
    scale = max(1.0, float(hist.max()))
    target = hist / scale
    weight = 1.0 / np.sqrt(np.maximum(target, 1e-3))  # long tails count as much as peaks
    weight /= weight.max()
    live = (hist[rows] > 0) | (rows == 0)
    use = np.flatnonzero(live.all(axis=1))
    act = rows[use]

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(act[:, i], x, n) for i in range(3))
        y[0] = 0
        return y

    w2 = weight**2
    w2[0] = 0
    # Lipschitz bound by power iteration.
    v = np.ones(len(act))
    for _ in range(20):
        g = w2 * forward(v)
        v = g[act].sum(axis=1)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 1.0 / (norm * 1.1)
    x = z = np.zeros(len(act))
    t = 1.0
    for _ in range(steps):
        r = w2 * (forward(z) - target)
        new = np.maximum(0, z - step * r[act].sum(axis=1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    out = np.zeros(len(rows))
    out[use] = x * scale
    return out


def plan(hist: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeat count) that use up the histogram exactly."""
    left = np.zeros(width + 1, np.int64)
    for length, n in hist.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[width]:
        out.append(((width,), int(left[width])))
        left[width] = 0
    if left.any():
        rows = patterns(width)[1:]
        x = np.rint(nnls_repeats(rows, left.astype(float))).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            if x[p] <= 0:
                break
            lengths = [int(v) for v in rows[p] if v]
            n = min(int(x[p]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                out.append((tuple(lengths), n))
                for v in lengths:
                    left[v] -= n
    return out + best_fit(left, width)


def best_fit(left: np.ndarray, width: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of decreasing lengths, by counts: bins with equal contents are one entry, so work follows the lengths."""
    spaces: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(width + 1)]
    for length in range(width, 0, -1):
        n = int(left[length])
        while n:
            space = next((s for s in range(length, width + 1) if spaces[s]), None)
            if space is None:
                spaces_per = width // length
                full, rest = divmod(n, spaces_per)
                if full:
                    spaces[width - length * spaces_per][(length,) * spaces_per] += full
                if rest:
                    spaces[width - length * rest][(length,) * rest] += 1
                break
            held, m = next(iter(spaces[space].items()))
            take = min(m, n)
            if take == m:
                del spaces[space][held]
            else:
                spaces[space][held] = m - take
            spaces[space - length][(*held, length)] += take
            n -= take
    return [(held, m) for s in spaces for held, m in s.items()]


def slots(repeats: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): pieces of a length, by rank, fill its slots in this order."""
    out, used, sequence = [], defaultdict(int), 0
    for lengths, n in repeats:
        offset = 0
        for length in lengths:
            out.append((length, used[length], n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def pack(cut: DataFrame, width: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """`cut` (id, piece, start, length, ids_crc32) with `sequence_id` and `offset`.

    Rows with equal ids, or null ids, are packed as rows of their own; ties in rank are broken by the row's values,
    and equal rows may take each other's slots. An empty table gives none. Lengths lie in 1..width.
    """
    spark = cut.sparkSession
    rows = materialise(cut, "pieces")
    hist = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `width` rows at most
    groups = max(1, sum(hist.values()) // (RANK_GROUP * 4))
    table = np.array(sorted(slots(plan(hist, width))), np.int64).reshape(-1, 5)
    # A slot for each place of a pattern in use: `width` bounds their number, not the data.
    keys = spark.sparkContext.broadcast(((table[:, 0] << 40) | table[:, 1], table[:, 1], table[:, 3], table[:, 4]))
    # Rank within a length, without putting a length into one task: count by group, add up, rank inside the group.
    order = ["ids_crc32", "piece", "start", id_col]
    rows = rows.withColumn("_g_group", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(groups)))
    counts = rows.groupBy("length", "_g_group").agg(F.count("*").alias("_g_n"))
    before = counts.withColumn(
        "_g_before",
        F.sum("_g_n").over(Window.partitionBy("length").orderBy("_g_group").rowsBetween(Window.unboundedPreceding, -1)),
    ).select(F.col("length").alias("_g_l"), F.col("_g_group").alias("_g_gg"), F.coalesce("_g_before", F.lit(0)).alias("_g_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_g_group").orderBy(*order))
    ranked = (
        rows.withColumn("_g_in", inside)
        .join(before, (F.col("length") == F.col("_g_l")) & (F.col("_g_group") == F.col("_g_gg")))
        .withColumn("_g_rank", F.col("_g_before") + F.col("_g_in") - 1)
    )
    names = cut.columns
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        key, first, sequence, offset = keys.value
        for batch in batches:
            rank = batch.column("_g_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (batch.column("length").to_numpy(zero_copy_only=False) << 40) | rank, side="right") - 1
            columns = [batch.column(c) for c in names]
            columns += [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.select(*[F.col(f"`{c}`") for c in names], "_g_rank").mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack whole texts into sequences of at most `width` tokens; one row per piece.

    Null or empty text is one piece that holds `end_id` alone. See `pack` for ties and repeated rows.
    """
    return pack(pieces(docs, id_col, text_col, width, end_id), width, id_col)
