"""Ids of byte-pair tokens from a merge table in a file, and texts of ids.

A file is read once by each worker; it names its tokens, the merges in the order of their rank, and added tokens, which are looked for first. Texts come in
Arrow batches, and each worker keeps the ids of pieces that it has met, within a bound. The file's path must hold on every node.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How text falls into pieces that no merge crosses (fixed value); white space is as Unicode defines it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pieces whose ids a worker keeps, and the bytes that a kept one has at most.
KEPT, KEPT_BYTES = 200_000, 200


def alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a file: itself where it is visible, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = alphabet()
        raw = lambda token: bytes(byte[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.bytes = {i: raw(t) for t, i in vocabulary.items()}
        self.start = [vocabulary[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PIECES).findall
        self.kept: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The pair of least rank is merged, the leftmost of equals, until no neighbours are a pair of the table."""
        ids = [self.start[b] for b in data]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merges[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if ids[k] != pair[0] or j >= len(ids) or ids[j] != pair[1]:
                continue  # one of them was merged since
            ids[k], ids[j], after[k] = self.merges[pair][1], -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < len(ids) and (p := (ids[a], ids[after[a]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], a, p))
        return [i for i in ids if i >= 0]

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            ids = self.kept.get(piece)
            if ids is None:
                data = piece.encode()
                ids = self.merged(data)
                if len(data) <= KEPT_BYTES:
                    if len(self.kept) >= KEPT:
                        self.kept.clear()
                    self.kept[piece] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if not self.marks:
            return self.plain(text)
        out: list[int] = []
        for k, part in enumerate(self.marks.split(text)):
            out += [self.added[part]] if k % 2 else self.plain(part)
        return out

    def decode(self, ids, names: dict[int, str]) -> str:
        return b"".join(names[i].encode() if i in names else self.bytes[i] for i in ids).decode(errors="replace")


@lru_cache(maxsize=4)
def table(path: str) -> MergeTable:
    return MergeTable(path)


_IDS = T.ArrayType(T.ArrayType(T.IntegerType()))
#: Rows whose texts, or tokens, are Python objects at once; ids themselves are kept as packed numbers.
SLICE = 16


def packed_ids(values: pa.Array, encode: Callable[[str], list[int]]) -> pa.Array:
    """Ids of the texts of lists of texts, SLICE lists at a time as Python objects."""
    ids, ends, rows = array("i"), array("i", [0]), array("i", [0])
    for at in range(0, len(values), SLICE):
        for v in values.slice(at, SLICE).to_pylist():
            for t in v:
                ids.extend(encode(t))
                ends.append(len(ids))
            rows.append(len(ends) - 1)
    packed = lambda a: pa.array(np.frombuffer(a, np.int32), pa.int32())
    return pa.ListArray.from_arrays(packed(rows), pa.ListArray.from_arrays(packed(ends), packed(ids)))


def ids_of(texts: Column, path: str) -> Column:
    """Ids of each text of an array, as a map from text to ids: `lambda t: column[t]` is then a tokenizer that is a column function.

    Null texts are left out, a null array has no texts. Equal texts of an array are encoded once.
    """

    @F.arrow_udf(_IDS)
    def run(values: pa.Array) -> pa.Array:
        return packed_ids(values, table(path).encode)

    own = F.array_distinct(F.array_compact(F.coalesce(texts, F.array().cast("array<string>"))))
    return F.map_from_arrays(own, run(own))


def text_of(ids: Column, path: str, names: dict[int, str]) -> Column:
    """The text of an array of ids; `names` are texts of ids that aren't in the file, or go before it. Null stays null, an unknown id is an error."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        decode = table(path).decode
        parts = (values.slice(at, SLICE).to_pylist() for at in range(0, len(values), SLICE))
        made = [pa.array([None if v is None else decode(v, names) for v in part], pa.string()) for part in parts]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    return run(ids)
