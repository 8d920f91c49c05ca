"""Languages, spelling variants and collocations against their plain definitions."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gimbal.llm import language, oracles, phrases, queries, spelling

SF = "/root/testdata/sf0.001"


def plain_collocations(rows, least, top, longest=5):
    """rows: (lang, text)"""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    often = {k for k, a in f.items() if len(k) > 2 and a >= least}
    covered = {(k[0], *k[i:j]) for k in often for i in range(1, len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) - 1 and f[k] >= f[(k[0], *k[i:j])]}
    out = defaultdict(list)
    for k in often - covered:
        cuts = [(1000 * f[k] * n[k[0]] // (f[k[: i + 1]] * f[(k[0], *k[i + 1 :])]), i, f[k[: i + 1]], f[(k[0], *k[i + 1 :])]) for i in range(1, len(k) - 1)]
        score, _, left, right = min(cuts)
        out[k[0]].append((-score, -f[k], " ".join(k[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for lang, v in out.items() for i, (s, a, p, le, ri) in enumerate(sorted(v)[:top]))


COLLOCATION_ROWS = [
    ("en", "a b c d e f, A B C! x\ty  x y\x0bx y.z z z z z z"),
    ("en", "a b c d e f; a b. x y" * 3),
    (None, "no lang no lang no lang\r\nno lang"),
    ("und", "no lang É é"),
    ("en", None),
    ("en", ""),
    ("de", "\n.,;:!?"),
    ("fr", "à la à la à la\x1cà la à\xa0la " * 400),
    ("fr", "à la à la à la\x1cà la à\xa0la " * 400),
    ("", "empty name empty name empty name"),
]


@pytest.mark.parametrize("least, top, cells, hot", [(3, 2000, 1 << 24, None), (2, 5, 1 << 6, None), (3, 2000, 1 << 24, 1), (1, 50, 1 << 10, 20)])
def test_collocations(spark, least, top, cells, hot):
    """With few cells all pairs are let through; with a low `hot` leading pairs are split and added up again."""
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in COLLOCATION_ROWS], "lang string, text string, phrase string, n int").repartition(3)
    got = sorted(map(tuple, phrases.collocations(docs, least=least, top=top, cells=cells, hot=hot).collect()))
    assert got == plain_collocations(COLLOCATION_ROWS, least, top)


def test_collocations_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")).count() == 0


def test_collocations_as_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{os.path.dirname(SF)}/sf0.01/documents.parquet'")
    want = duck.sql(oracles.SQL["op13_collocations"]).fetchall()
    assert sorted(map(tuple, queries.op13_collocations(spark, f"{os.path.dirname(SF)}/sf0.01").collect())) == sorted(want) and want


@pytest.mark.parametrize("least, small", [(1, 4), (5, 4), (40, 16), (5, 10_000)])
def test_multikey_counts(least, small):
    rng = np.random.default_rng(1)
    rows = [tuple(int(x) for x in rng.integers(0, 3, rng.integers(1, 5)) ** 2) for _ in range(700)]
    weight = rng.integers(1, 4, len(rows))
    keys = [np.array([r[d] if d < len(r) else -1 for r in rows]) for d in range(4)]
    want = Counter()
    for r, w in zip(rows, weight):
        for d in range(len(r)):
            want[r[: d + 1]] += int(w)
    row, last, n = phrases.multikey_counts(keys, weight, least, small)
    got = {rows[i][: d + 1]: int(c) for i, d, c in zip(row, last, n)}
    assert len(got) == len(row) and got == {k: c for k, c in want.items() if c >= least}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(rows, min_count=5):
    """rows: (doc_id, text)"""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.low(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= min_count}
    met = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(met[w], key=lambda v: (-n[v], v)) for w in n if met[w] and max(n[v] for v in met[w]) >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(met[w]), n[form[w]] if w in form else None))
    return sorted(out)


def spelling_rows():
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdé", k=rng.randrange(6, 12))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "ababab"]
    rows = [(1, None), (2, ""), (None, "Aaaaaa " * 30), (4, "x" * 9_000 + " " + "ÀÉ×÷ÿ " * 9), (5, "straße Straße STRAßE " * 4)]
    rows += [(4, "x" * 9_000)] * 4 + [(6, "x" * 4_000 + "y" + "x" * 4_999)] * 5
    rows.append((7, "kettlexy " * 5 + "kettlex " * 26 + "kettle " * 131))  # a form of a form
    for i in range(10, 400):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice("abcdéA")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("most_shared", [1, 3, 32, 10**6])
def test_spelling_variants(spark, most_shared):
    """With few words to a chunk every level of the free letters is gone through."""
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.spelling_variants(docs, most_shared=most_shared).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_spelling_of_whole_documents_and_of_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, queries.op12_spelling_variants(spark, SF).collect()))
    assert got == plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def plain_bits(train, text, order, least_seen):
    """Code length of a text's bytes under the counts of some texts, by recursion over ever shorter contexts."""
    counts = defaultdict(Counter)
    for t in train:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[t[i - k : i]][t[i]] += 1

    def cost(context, byte):
        seen = counts.get(context, Counter()) if not context or sum(counts.get(context, Counter()).values()) >= least_seen else Counter()
        n, d = seen.total(), len(seen)
        if seen[byte]:
            return math.log2((n + d) / seen[byte])
        return (math.log2((n + d) / d) if d else 0) + (cost(context[1:], byte) if context else 8)

    text = b"\n" * order + text
    return sum(cost(text[i - order : i], text[i]) for i in range(order, len(text)))


def test_code_lengths(spark):
    rows = [(i, lang, t) for i in range(300) for lang, t in [(("en", "the cat and the hat"), ("de", "die Katze und der Hut"), ("fr", "le chat, là"))[i % 3]] for t in [t[i % 5 :] + t[: i % 7]]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train(docs, least_seen=3, order=3)
    texts = [b"", b"the the", b"katze", "là là été".encode(), bytes(range(128)), b"x"]
    got = model.bits(texts)
    assert model.langs == ["de", "en", "fr"]
    for j, lang in enumerate(model.langs):
        learnt = {t for i, x, t in rows if x == lang and zlib.crc32(str(i).encode()) % 5}
        want = [plain_bits([language.folded(t) for t in sorted(learnt)], t, 3, 3) for t in texts]
        assert np.allclose(got[:, j], want, rtol=1e-5, atol=1e-3)


def test_lookup_with_collisions():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = language.Lookup(keys, np.arange(len(keys)))
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, 5000).astype(np.uint64), keys)
    assert (table.find(other) == -1).all()


def test_languages_of_odd_rows(spark):
    rows = [(i, ("en", "es")[i % 2], ("the cat sat here", "el gato está aquí")[i % 2]) for i in range(60)]
    odd = [(100, "en", None), (101, None, ""), (None, "en", "the cat"), (102, None, "123 !? ²"), (103, "en", "the cat" * 20_000), (104, None, "漢字"), (104, None, "漢字")]
    docs = spark.createDataFrame([(i, x, t, 1.0, "c") for i, x, t in rows + odd], "doc_id long, lang string, text string, score double, held_out string")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and got[100].score == 0
    assert got[103].lang_pred == "en" and got[1].lang_pred == "es" and got[104].lang_pred in ("en", "es") and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values()) and language.languages(docs).count() == len(rows) + len(odd)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(60))
    assert {tuple(r) for r in language.languages(docs.where("lang IS NULL")).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language.languages(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    path = f"{os.path.dirname(SF)}/sf0.01"
    truth = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    rows = queries.op11_language_id(spark, path).join(truth, "doc_id").where("held_out")
    right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
