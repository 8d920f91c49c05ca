"""Token counts by heap-and-linked-list byte-pair merging; no token identifiers are produced."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import map_text

OUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)
#: Unicode white space, as the tokenizer's patterns mean it; Python's own also holds U+001C to U+001F.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: A worker's caches are emptied at this many entries each.
CACHE_ENTRIES = 400_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    spare = 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Merger:
    """Counts what is left of a symbol sequence after merging by rank."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = ""):
        symbols = _byte_symbols()
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.inner = [number(s) for s in symbols]
        self.last = [number(s + suffix) for s in symbols]
        self.rank = {(number(a), number(b)): (r, number(a + b)) for r, (a, b) in enumerate(merges)}

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges. Each pop takes the lowest rank, the leftmost pair first."""
        n = len(word)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank = self.rank
        heap = []
        for i in range(n - 1):
            if found := rank.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            r, i, new = heapq.heappop(heap)
            if symbol[i] < 0:
                continue
            j = after[i]
            if j >= n:
                continue
            found = rank.get((symbol[i], symbol[j]))
            if not found or found[0] != r:
                continue
            merged += 1
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((new, symbol[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := rank.get((symbol[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return n - merged


class _Words(dict):
    """Count of a pre-token."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, word: str) -> int:
        n = self.merger.count(word.encode())
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = n
        return n


class _Chunks(dict):
    """Count of a run of characters without white space."""

    def __init__(self, words: _Words, pattern: regex.Pattern, tokenizer: Tokenizer):
        super().__init__()
        self.words, self.pattern = words, pattern
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, chunk: str) -> int:
        # Normalisation, then the pre-tokens; none of them crosses white space. Beyond Latin both are the
        # tokenizer's own: its Unicode tables aren't those of this Python.
        if max(chunk) < "\u0250":
            words = self.pattern.findall(unicodedata.normalize("NFC", chunk).lower())
        else:
            text = self.normalise(chunk)
            words = [text[a:b] for _, (a, b) in self.split(text)]
        n = sum(map(self.words.__getitem__, words))
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


class Counter:
    """Reads a tokenizer file of word-end byte pairs, and counts tokens of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.chunks = _Chunks(_Words(Merger(merges, spec["model"]["end_of_word_suffix"])), regex.compile(pattern.replace(r"\s", SPACE)), Tokenizer.from_file(path))
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special))
        self.separators = re.compile("[\x1c-\x1f]")
        self.space = re.compile(f"[{SPACE}]+")

    def __call__(self, text: str) -> int:
        if "<|" in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        chunks = filter(None, self.space.split(text)) if self.separators.search(text) else text.split()
        return sum(map(self.chunks.__getitem__, chunks))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker: its caches serve all tasks that the worker runs."""
    return Counter(path)


def token_counts(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """Per input row: the id, `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens).

    `path` is the tokenizer's file on the executors; by default it is looked up there. Null or empty text has
    no bytes and no tokens. Special strings inside a text count as one token. Rows are independent: no shuffle.
    """

    def make():
        if path is None:
            import public_tokenizers

            count = counter(public_tokenizers.path("word_bpe_49k.json"))
        else:
            count = counter(path)

        def work(texts: list[str]) -> dict[str, list]:
            n = [count(t) for t in texts]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return map_text(docs, text_col, [id_col], OUT, make)
