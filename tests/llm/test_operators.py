"""Operators against their plain definitions, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import os
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gimbal.llm import oracles, packing, pii, quality_gam, queries, simhash, toxicity, warc
from gimbal.llm.components import components
from gimbal.llm import decontaminate as decontamination
from gimbal.llm.decontaminate import decontaminate
from gimbal.llm.line_dedup import line_dedup
from gimbal.llm.quality_rules import quality_rules
from gimbal.llm.token_count import token_counts

SF = "/root/testdata/sf0.001"
LINE = "This shared line is long enough to count."
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 3
ROWS = [
    (1, LINE + "\nown text here"),
    (2, "  " + LINE.upper() + "\t\n\nshort\nshort"),
    (3, LINE + "\n" + LINE),
    (3, LINE + "\nother row of the same id"),
    (4, None),
    (5, ""),
    (None, LINE + "\nno id"),
    (6, " \t\n\x0b"),
    (7, BASE),
    (8, BASE.replace("kappa", "KAPPA")),
    (9, BASE),
    (9, BASE),
    (10, "mail x.y@a.example.com%b@c.de, 10.0.0.256 and 1.2.3.4.5.6.7.8 +1 (555) 555-7209 4111 1111 1111 1111 5 4-"),
    (11, "7" * 30_000 + " a@b " + "a." * 20_000 + "@"),
    (12, "Ünïcödé ①②③ 漢字 🙂🙂 ÀÉ " * 40),
    (13, "a b c " * 5000),
    (14, "one\rtwo\x1cthree\x85four five <|endoftext|> six"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 7, "clash") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, n_dropped string").repartition(3)


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def expected(rows):
    return sorted(map(tuple, rows), key=repr)


def test_line_dedup(docs):
    got = rows_of(line_dedup(docs).withColumn("sha", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "sha")
    assert got == expected(brute.line_dedup(ROWS))


def test_quality_rules(docs):
    got = rows_of(quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in ROWS:
        r = brute.rules(t)
        want.append((i, *r, r[0] < 50 or 100 * r[4] > 50 * r[0]))
    assert got == expected(want)


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS]
    assert rows_of(token_counts(docs), "doc_id", "n_bytes", "n_tokens") == expected(want)


def test_near_duplicates(docs):
    fps = [brute.fingerprint(t) for _, t in ROWS]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(ROWS, fps, brute.groups(ROWS, fps))]
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected(want)


@pytest.mark.parametrize("pair_bucket", [2, 32, 10_000])
def test_links_keep_all_components(spark, pair_bucket):
    """Clusters of fingerprints around centres: small buckets, large ones, and both."""
    rng = np.random.default_rng(3)
    fps = set()
    for centre in rng.integers(0, 1 << 62, 12):
        fps.add(int(centre))
        for _ in range(40):
            fps.add(int(centre) ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 6), replace=False))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, pair_bucket=pair_bucket)).collect()}
    want = brute.groups([(f, "") for f in fps], fps)
    assert [got.get(f, f) for f in fps] == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)}


ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "漢字 🙂🙂"), (3, None), (None, "alpha beta"), (4, "..."), (2, "a b"), (5, "never seen words")]


@pytest.mark.parametrize("limit", [1_500_000, 0])
def test_decontaminate(spark, docs, limit):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(docs, bench, broadcast_words=limit)
    got = rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == expected(brute.decontaminate(ROWS, ITEMS))


def test_window_hashes_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontamination._Hashes, "__missing__", lambda self, word: len(word))
    rng = np.random.default_rng(6)
    text = lambda n: " ".join("ab"[i] * j for i, j in zip(rng.integers(0, 2, n), rng.integers(1, 3, n)))
    items = [(str(i % 6), text(int(rng.integers(1, 8)))) for i in range(9)]
    index = decontamination.build_index(items, 3)
    rows = [(i, text(int(rng.integers(0, 40)))) for i in range(60)]
    for (_, t), want in zip(rows, brute.decontaminate(rows, items, 3)):
        n, found = index.scan(decontamination.words_of(t), decontamination._Hashes().__getitem__)
        assert (n, len(found)) == want[2:4]
    assert index.nbytes > 1 << 21


def test_personal_data_base(docs):
    got = rows_of(pii.personal_data(docs, pii.SpanModel()), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    want = []
    for i, t in ROWS:
        counts, spans, sha = brute.base_spans(t)
        want.append((i, *counts, sha, spans))
    assert got == expected(want)


def test_personal_data_adds_and_keeps_base(docs):
    model = pii.SpanModel([1.0], [1.0], {g: 0.5 for g in range(3)})  # takes every candidate
    for r in pii.personal_data(docs, model).collect():
        base = [x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE]
        import hashlib

        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        ends = sorted((s.s, s.e) for s in r.redactions if s.kind not in pii.BASE)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_tree_parser():
    text = "DecisionTreeRegressionModel: depth=2\n  If (feature 3 <= 0.5)\n   If (feature 1 <= 12.0)\n    Predict: -1.0\n   Else (feature 1 > 12.0)\n    Predict: 0.25\n  Else (feature 3 > 0.5)\n   Predict: 1.0E-3\n"
    assert pii._parse(text) == (3, 0.5, (1, 12.0, -1.0, 0.25), 0.001)


PAGES = [(1, "http://www.A.com/x?q=1", "<p>one</p>"), (2, "http://a.com/y", "<p>one</p>"), (3, None, None), (4, "http://b.org:8080/é", ""), (5, "not a url", "<p>ü</p>"), (6, "http://a.com/y", "<p>one</p>"), (6, "http://a.com/y", "<p>one</p>"), (None, "http://c.net/", "<p>one</p>"), (None, "http://d.net/", "only")]


@pytest.mark.parametrize("block", [1, 2, 2000])
def test_warc_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", block)
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    out = warc.archive_round_trip(pages)
    got = rows_of(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == expected(brute.warc([(i, h) for i, _, h in PAGES]))


def test_warc_urls_and_stores():
    record = warc.parse_record(warc._record("http://a.b/\tü\xa0x", 4, b"<p>", warc.payload_digest(b"<p>"), None, False))
    assert record["url"] == "http://a.b/%09ü%C2%A0x" and record["payload"] == b"<p>"
    names = {warc.pafs.FileSystem: None}
    for scheme in ("s3", "s3a", "s3n"):
        store, root = warc._file_system(f"{scheme}://bucket/folder?region=us-east-1")
        names[type(store)] = root
    assert names.pop(warc.pafs.S3FileSystem) == "bucket/folder" and len(names) == 1


def test_warc_index_blocks_and_lookup(spark, tmp_path):
    entries = spark.createDataFrame([(f"com,a)/{i % 7}", i % 50, "D", f"f{i}", i, 1) for i in range(1000)], warc.ENTRY)
    top = warc.write_index(entries, str(tmp_path / "i"), 3, block_entries=16).collect()
    reader = warc.IndexReader(str(tmp_path / "i"), sorted((r.last, r.shard) for r in top))
    for i in range(50):
        for k in range(7):
            want = sorted((f"f{n}", n, 1) for n in range(1000) if n % 50 == i and n % 7 == k)
            assert sorted(reader.lookup(warc._sortable(f"com,a)/{k}", i, "D"))) == want
    assert list(reader.lookup("nothing")) == []


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit_packing(docs).toPandas()
    want = []
    for i, x in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert expected(rows) == expected(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 1025, 3000), np.full(500, 7), np.full(400, 1024)])
    hist = {int(k): int((lengths == k).sum()) for k in np.unique(lengths)}
    used = {}
    plan = packing.plan(hist, 1024)
    for parts, n in plan:
        assert sum(parts) <= 1024 and n > 0
        for p in parts:
            used[p] = used.get(p, 0) + n
    assert used == hist
    assert sum(n for _, n in plan) <= 1.02 * np.ceil(lengths.sum() / 1024)


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(2)
    rows, cols, values, grades = [], [], [], []
    for i in range(600):
        n = int(rng.integers(0, 6))
        grades.append(0 if n == 0 else 1 + (n > 2) + (n > 4))
        if n:
            rows.append(i), cols.append(0), values.append(np.log1p(n))
        rows.append(i), cols.append(1), values.append(float(rng.random()))
    w, cuts = toxicity.fit_ordinal(np.array(rows), np.array(cols), np.array(values), np.array(grades), 2)
    assert w[0] > 3 and abs(w[1]) < w[0] / 3 and (np.diff(cuts) > 0).all()


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(docs, toxicity.train(docs, none))
    assert out.count() == len(ROWS) and not out.where("toxic").count()
    scores = quality_gam.quality_scores(docs, quality_gam.train(docs, none)).toPandas()
    assert len(scores) == len(ROWS) and scores.score.between(0, 1).all()


def test_learned_operators_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = queries.op2_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert (q.predicted == q.quality).mean() > 0.9
    t = queries.op4_toxicity(spark, sf).where("held_out").join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert (t.toxic == (t.label == 1)).mean() > 0.9


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit_additive(x, y)
    assert ((m.scores(x) > 0.5) == (y > 0.5)).mean() > 0.9 and (1, 0) in m.pairs


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], EMPTY)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup(none).count() == quality_rules(none).count() == token_counts(none).count() == 0
    assert simhash.near_duplicates(none).count() == packing.best_fit_packing(none).count() == 0
    assert pii.personal_data(none, pii.train(none)).count() == 0
    assert decontaminate(none, bench).count() == 0 and not decontaminate(docs, bench).where("contaminated").count()
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_same_rows_as_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck().sql(oracles.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda d: d[cols].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(cols).reset_index(drop=True)
    assert text(got).equals(text(want))


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input, against the plain definitions; then the run as a whole."""
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text").collect()
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns
        ids = {r.doc_id for r in out.collect()}
        if name == "line dedup":
            assert {r.doc_id: r.text for r in out.collect()}.keys() == {r.doc_id for r in before}
            want = {w[0]: w[3] for w in brute.line_dedup([tuple(r) for r in before])}
            import hashlib

            assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] for r in out.collect())
        if name == "SimHash near-dedup":
            rows = [tuple(r) for r in before]
            assert ids == set(near_groups(rows, simhash_bits=2)) and out.count() == len(ids)
        if name == "benchmark decontamination":
            assert ids == {r[0] for r in brute.decontaminate([tuple(r) for r in before], bench) if not r[5]}
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_keeps_clashing_columns_and_null_ids(spark):
    rows = [(1, BASE, 5), (2, BASE, 6), (None, BASE, 7), (None, BASE, 8), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")}).withColumn("n_chars", F.lit(1).cast("long"))
    out = corpus_pipeline.drop_contaminated(spark, corpus_pipeline.toxicity(spark, df, SF), SF)
    assert sorted(out.select("toxic").toPandas().toxic.dropna()) == [5, 6, 7, 8] and out.columns == df.columns
    kept = corpus_pipeline.near_dedup(spark, df, SF).toPandas()
    assert len(kept) == 2 and set(kept.doc_id) == {1, 3}


def near_rows():
    """Texts with copies of one or a few edits, chains of copies, exact copies, a shared passage and short texts."""
    rng = np.random.default_rng(11)
    word = lambda: "w" + "abcdefghij"[rng.integers(10)] + str(rng.integers(4000))
    texts, passage = ["", None, "Two words", "two  WORDS", "two word"], [word() for _ in range(60)]
    for k in range(30):
        base = [word() for _ in range(int(rng.integers(5, 200)))]
        at = list(base)
        for j in range(60 if k == 0 else 4):
            texts.append(" ".join(at))
            at = list(at if j % 2 else base)
            for _ in range(int(rng.integers(0, 1 + len(at) // 30))):
                at[rng.integers(len(at))] = word()
        texts.append(" ".join(base).upper())
    texts += [" ".join(passage + [word() for _ in range(12 + k % 9)]) for k in range(60)]
    return list(enumerate(texts))


def near_groups(rows, simhash_bits=None):
    """The least id of each component of pairs whose 5-word shingles are 0.8 similar, by comparing all pairs; or whose SimHashes are that near."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    fps = [brute.fingerprint(t, 5) for _, t in rows] if simhash_bits is not None else None
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            near = fps is not None and (fps[i] ^ fps[j]).bit_count() <= simhash_bits
            if near or sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("pair_bucket", [2, 32])
def test_near_copies_are_all_pairs(spark, pair_bucket):
    from gimbal.llm import jaccard

    rows = near_rows()
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["doc_id"], pair_bucket=pair_bucket).toPandas()
    least = got.groupby("group").doc_id.transform("min")
    assert dict(zip(got.doc_id, least)) == dict(enumerate(near_groups(rows)))


def test_pipeline_drops_near_copies(spark):
    rows = near_rows()
    left = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()]
    assert {i for i, _ in left} == set(near_groups(rows)) and len(left) == len(set(near_groups(rows)))
    assert [i for i, _ in sorted(left)] == sorted(near_groups(sorted(left)))  # no pair is left


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], EMPTY)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and not out.count()
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()


def test_near_copies_by_row(spark):
    """Rows without an id, rows that share one, and exact repeats."""
    words = [[f"{c}{i}" for i in range(80)] for c in "abcd"]
    edit = lambda w, i: " ".join([*w[:i], "edited", *w[i + 1 :]])
    a, b, c, d = (" ".join(w) for w in words)
    rows = [(1, a), (None, edit(words[0], 40)), (2, edit(words[0], 9)), (2, b), (2, edit(words[1], 70)), (None, c), (None, edit(words[2], 30)), (3, d), (3, d), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    out = corpus_pipeline.near_dedup(spark, df, SF)
    got = out.toPandas()
    assert out.columns == df.columns and sorted(got.doc_id.dropna()) == [1, 2, 3] and len(got) == 4
    assert {t.split()[0] for t in got.text} == {"a0", "b0", "c0", "d0"}
