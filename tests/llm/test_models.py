"""Learned operators against plain loops and numeric gradients, and fitted models on odd rows."""

import numpy as np
import pytest
from test_operators import BASE, EMPTY, ROWS

from gimbal.llm import quality_gam, toxicity


def cells(n=60, width=5, seed=3):
    rng = np.random.default_rng(seed)
    rows, cols = np.repeat(np.arange(n), 3), rng.integers(0, width, 3 * n)
    return rows, cols, rng.random(3 * n), rng.integers(0, 4, n)


def test_ordinal_gradient_is_numeric():
    rows, cols, values, grades = cells()
    p = np.random.default_rng(5).normal(0, 0.5, 8)
    value, grad = toxicity.ordinal_loss(p, rows, cols, values, grades, 5, 0.3)
    loss = lambda q: toxicity.ordinal_loss(q, rows, cols, values, grades, 5, 0.3)[0]
    assert grad == pytest.approx([(loss(p + d) - loss(p - d)) / 2e-6 for d in np.eye(8) * 1e-6], abs=1e-6)
    # The likelihood by its definition.
    cuts, total = np.cumsum([p[5], np.exp(p[6]), np.exp(p[7])]), 0.3 / 2 * (p[:5] ** 2).sum()
    for i, g in enumerate(grades):
        z = sum(p[c] * v for r, c, v in zip(rows, cols, values) if r == i)
        at_least = [1.0, *(1 / (1 + np.exp(cuts - z))), 0.0]
        total -= np.log(at_least[g] - at_least[g + 1])
    assert value == pytest.approx(total / len(grades))


def test_ordinal_fit_is_a_minimum():
    rows, cols, values, grades = cells(200)
    w, cuts = toxicity.fit_ordinal(rows, cols, values, grades, 5, steps=3000)
    p = np.r_[w, cuts[0], np.log(np.diff(cuts))]
    assert np.abs(toxicity.ordinal_loss(p, rows, cols, values, grades, 5, 0.3)[1]).max() < 1e-3


def test_grades_follow_the_other_fold():
    """More of the marker word is worse; a row's own fold doesn't place it."""
    rng = np.random.default_rng(1)
    y = (np.arange(400) % 4 == 0).astype(np.int64)
    strength = np.where(y == 1, rng.random(400) * 3 + 0.5, 0)
    rows = np.flatnonzero(strength)
    grades = toxicity.grade_rows(rows, np.zeros(len(rows), np.int64), strength[rows], y, np.arange(400) // 4 % 2, 1)
    assert set(grades[y == 0]) == {0} and sorted(set(grades[y == 1])) == [1, 2, 3]
    assert np.corrcoef(np.argsort(np.argsort(strength[y == 1])), grades[y == 1])[0, 1] > 0.8


def plain_tree(bins, g, h, n, leaves, lam):
    """Best-gain cuts of ordered bins, by trying all of them."""
    value = lambda b: sum(g[i] for i in range(len(g)) if bins[i] in b) ** 2 / (sum(h[i] for i in range(len(g)) if bins[i] in b) + lam)
    parts = [list(range(n))]
    while len(parts) < leaves:
        best = None
        for k, part in enumerate(parts):
            for c in range(1, len(part)):
                gain = value(part[:c]) + value(part[c:]) - value(part)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, k, c)
        if best is None:
            break
        _, k, c = best
        parts[k : k + 1] = [parts[k][:c], parts[k][c:]]
    out = [0.0] * n
    for part in parts:
        v = -sum(g[i] for i in range(len(g)) if bins[i] in part) / (sum(h[i] for i in range(len(g)) if bins[i] in part) + lam)
        for b in part:
            out[b] = v
    return out


def test_tables_are_those_of_plain_cyclic_boosting():
    rng = np.random.default_rng(2)
    x = np.round(rng.random((80, 3)), 1)
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.random(80) > 0.8).astype(float)
    model = quality_gam.fit_additive(x, y, cycles=4, pair_cycles=0, rate=0.1, lam=2.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    z = [np.log(share / (1 - share))] * len(y)
    bins = [[sum(e <= v for e in edges) for v in x[:, j]] for j, edges in enumerate(model.edges)]
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    for _ in range(4):
        for j, t in enumerate(tables):
            p = [1 / (1 + np.exp(-v)) for v in z]
            step = plain_tree(bins[j], [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], len(t), 3, 2.0)
            for b, v in enumerate(step):
                t[b] += 0.1 * v
            z = [v + 0.1 * step[b] for v, b in zip(z, bins[j])]
    for got, want in zip(model.tables, tables):
        assert got == pytest.approx(want)
    assert model.scores(x) == pytest.approx([1 / (1 + np.exp(-(model.intercept + sum(t[b[i]] for t, b in zip(tables, bins))))) for i in range(len(y))])


def test_pairs_cut_at_the_best_cross():
    rng = np.random.default_rng(8)
    g, h, lam = rng.normal(size=(4, 5)), rng.random((4, 5)), 2.0
    gain, table = quality_gam._quadrants(g, h, lam)
    best = max(
        (sum(g[r, c].sum() ** 2 / (h[r, c].sum() + lam) for r in (slice(0, i), slice(i, 4)) for c in (slice(0, j), slice(j, 5))) - g.sum() ** 2 / (h.sum() + lam), i, j)
        for i in range(1, 4)
        for j in range(1, 5)
    )
    assert gain == pytest.approx(best[0])
    assert table[: best[1], : best[2]] == pytest.approx(np.full((best[1], best[2]), -g[: best[1], : best[2]].sum() / (h[: best[1], : best[2]].sum() + lam)))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, ids with several rows, and columns named like outputs and labels."""
    rows = [(i, t, 7, "clash", 1.5) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string, severity double").repartition(3)


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels), quality_gam.train(docs, labels), docs, labels


def test_fitted_models_on_odd_rows(spark, odd, learned):
    tox, gam, docs, labels = learned
    assert len(tox.vocab) > 5 and len(tox.cuts) == 3 and gam.pairs
    got = toxicity.toxicity(odd, tox, keep=["doc_id", "score"]).toPandas()
    assert len(got) == len(ROWS) and set(got.score) == {"clash"} and got.severity.between(0, 3).all() and got.grade.between(0, 3).all()
    assert not got[got.doc_id.isin([4, 5, 6])].toxic.any()  # without words
    q = quality_gam.quality_scores(odd, gam).toPandas()
    assert len(q) == len(ROWS) and q.score.between(0, 1).all() and not q[q.doc_id.isna()].held_out.any()
    for table in (got.severity, q.score):  # repeated rows and null or empty texts score alike
        assert table[q.doc_id.eq(9)].nunique() == 1 and table[q.doc_id.isin([4, 5])].nunique() == 1
    none = spark.createDataFrame([], EMPTY)
    assert toxicity.toxicity(none, tox).count() == quality_gam.quality_scores(none, gam).count() == 0
    assert not toxicity.train(none, labels).vocab and quality_gam.train(none, labels).scores(np.zeros((1, 20))) == pytest.approx([0.5])


def test_models_do_not_depend_on_the_order_of_rows(spark, learned):
    tox, gam, docs, labels = learned
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert again.vocab == tox.vocab and again.weights == pytest.approx(tox.weights, abs=1e-9) and again.threshold == tox.threshold
    other = quality_gam.train(docs.repartition(7), labels)
    assert all(a == pytest.approx(b) for a, b in zip(other.tables, gam.tables))


def test_one_id_with_many_rows_stays_within_the_bound(spark):
    rows = [(5, f"{BASE} number {i}") for i in range(300)] + [(i, f"text {i} " * 9) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in [5, *range(20, 60)]], "doc_id long, toxic int, quality int")
    sampled = quality_gam.training_rows(docs, labels, sample_docs=30)
    assert sampled.groupBy("_g_lid").count().where("count > 1").count() == 0 and sampled.count() <= 30
