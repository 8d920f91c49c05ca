"""Plain definitions of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(_LOW)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_dedup(rows, min_chars=20, min_docs=3):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, sha256)"""
    key = lambda line: low(line).strip(WS)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc is not None:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or doc == max(held[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def fingerprint(text, shingle=3):
    w = words(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows, fps, bits=2):
    """Least id reachable, for each row."""
    uniq = sorted(set(fps))
    parent = {f: f for f in uniq}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for i, a in enumerate(uniq):
        for b in uniq[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for (doc, _), f in zip(rows, fps):
        if doc is not None:
            least[root(f)] = min(doc, least.get(root(f), doc))
    return [least.get(root(f)) for f in fps]


def decontaminate(docs, items, width=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    tests = defaultdict(set)
    for item, text in items:
        w = find(text)
        if item is None or not w:
            continue
        k = min(width, len(w))
        for i in range(len(w) - k + 1):
            tests[item].add(tuple(w[i : i + k]))
    out = []
    for doc, text in docs:
        w = find(text)
        hit, names = set(), set()
        for item, grams in tests.items():
            for k in {len(g) for g in grams}:
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) in grams:
                        hit.update(range(i, i + k))
                        names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit)))
    return out


_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    d = [int(x) for x in reversed(digits)]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    """Counts by kind, and (start, kind's place, end) in order."""
    out = []
    for k, (kind, pattern) in enumerate(_PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and _luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    out.sort()
    text = ",".join(f"{list(_PII)[k]}:{s}:{e}" for s, k, e in out)
    return [sum(x[1] == k for x in out) for k in range(4)], text, hashlib.sha256(text.encode()).hexdigest()


def warc(pages):
    """(page_id, html) -> page_id, bytes, digest, type, refers_to"""
    import base64

    least = {}
    for page, html in pages:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, html in pages:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = least.get(html or "")
        revisit = first is not None and page != first
        out.append((page, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return out
