"""Weights that leave out what they judge, against loops over numpy arrays."""

import zlib

import numpy as np
import pytest

from partloom.bindings import evaluation
from partloom.operators import learned


@pytest.fixture(scope="module")
def rows(spark, small):
    found = learned.features(evaluation(spark, small)).toPandas()
    return found["qid"].to_numpy(), found["cand_key"].tolist(), np.array(found["x"].tolist()), found["y"].to_numpy()


def test_ridge(spark, small, rows):
    qid, keys, x, y = rows
    got = {(r.qid, r.cand_key): r.score for r in learned.l12_all(spark, small).collect()}
    assert len(got) == len(set(zip(qid, keys)))
    xb = np.hstack([x, np.ones((len(x), 1))])
    keep = np.diag([learned.RIDGE] * x.shape[1] + [0.0])
    for q in np.unique(qid)[::40]:
        own = qid == q
        w = np.linalg.solve(xb[~own].T @ xb[~own] + keep, xb[~own].T @ y[~own])
        for i in np.flatnonzero(own):
            assert abs(got[q, keys[i]] - xb[i] @ w) < 2e-6


def test_pairwise(spark, small, rows):
    qid, keys, x, y = rows
    fold = np.array([zlib.crc32(str(q).encode()) % learned.FOLDS for q in qid])
    got = {(r.qid, r.cand_key): r.score for r in learned.l13_folds(spark, small).collect()}
    pairs = [(a, b) for q in np.unique(qid) for own in [np.flatnonzero(qid == q)] for a in own for b in own if y[a] > y[b]]
    a, b = np.array(pairs).T
    for k in (0, 7):
        d = (x[a] - x[b])[fold[a] != k]
        w = np.zeros(x.shape[1])
        for _ in range(learned.STEPS):
            p = 1 / (1 + np.exp(d @ w))
            w = w - np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + learned.L2 * np.eye(len(w)), -(d.T @ p) / len(d) + learned.L2 * w)
        for i in np.flatnonzero(fold == k):
            assert abs(got[qid[i], keys[i]] - x[i] @ w) < 2e-6
    right = np.mean([got[qid[i], keys[i]] > got[qid[j], keys[j]] for i, j in pairs])
    assert right > 0.5


def test_without_pairs(spark):
    none = spark.createDataFrame([(1, "a", 1.0, [0.5]), (2, "b", 1.0, [0.1])], "qid long, cand_key string, y double, x array<double>")
    assert (learned.pairwise_left_out(none, 1, folds=2) == 0).all()
    assert [len(r.w) for r in learned.ridge_left_out(none, 1).collect()] == [2, 2]
    assert learned.ridge_left_out(none.limit(0), 1).count() == 0


def test_bootstrap_interval(spark):
    """Against resampling with replacement, drawn at once: the same mean, and ends within a tenth of the interval's width."""
    from partloom.operators.evaluation import bootstrap

    rng = np.random.default_rng(3)
    diff = rng.normal(0.05, 0.2, 400)
    got = bootstrap(spark.createDataFrame(list(enumerate(diff.tolist())), "qid long, diff double"), 4000).first()
    means = rng.choice(diff, (4000, len(diff))).mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert abs(got["mean"] - diff.mean()) < 0.1 * (high - low) and abs(got.low - low) < 0.1 * (high - low) and abs(got.high - high) < 0.1 * (high - low)
    again = bootstrap(spark.createDataFrame(list(enumerate(diff.tolist())), "qid long, diff double").repartition(7), 4000).first()
    assert abs(again.low - got.low) < 1e-9 and abs(again.high - got.high) < 1e-9


def test_ridge_sums_queries_where_their_rows_are(spark, small):
    """Rows are dealt by query before anything is computed of them, and no query's sums of products are dealt again."""
    plan = learned.l12_all(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "Exchange hashpartitioning(qid" not in plan


def test_equal_differences_are_drawn_together(spark):
    """100,000 queries with two differences take two draws a resample; the interval is that of the normal distribution."""
    from pyspark.sql import functions as F

    from partloom.operators.evaluation import bootstrap, drawn_together

    rows = spark.range(100_000).select(F.col("id").alias("qid"), F.when(F.col("id") % 4 == 0, -0.25).otherwise(0.5).alias("diff"))
    assert sorted((r.n, r["mean"]) for r in drawn_together(rows).collect()) == [(25_000, -0.25), (75_000, 0.5)]
    got = bootstrap(rows, 4000).first()
    half = 1.96 * (0.75 * 0.25 * 0.75**2) ** 0.5 / 100_000**0.5
    assert abs(got["mean"] - 0.3125) < half / 10 and abs(got.high - got.low - 2 * half) < half / 5


def test_cosine_by_blocks(spark, monkeypatch):
    """Copies, equal scores, tiny blocks, vectors that are null, of another width or hold a null."""
    from partloom.operators import evaluation as ev

    rng = np.random.default_rng(5)
    made = {i: rng.integers(-2, 3, 8).astype(float).tolist() for i in range(400)}
    made |= {i: made[3] for i in range(40, 60)} | {7: None, 10: [1.0, None, *[0.5] * 6], 21: [1.0] * 5, 30: [1.0] * 7}
    made = {i: v if v is None or any(v) else [1.0] * 8 for i, v in made.items()}
    monkeypatch.setattr(ev, "QUERY_BLOCK", 8)
    monkeypatch.setattr(ev, "TILE", 16)
    got = {}
    for r in ev.cosine_top_k(spark.createDataFrame(list(made.items()), "vec_id long, e array<double>"), 10, 5).collect():
        got.setdefault(r.query_id, {})[r.nth] = r.vec_id

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return float("-inf")  # null comes last
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 9)

    for q in range(0, 400, 10):
        want = sorted((i for i in made if i != q), key=lambda i: (-cosine(made[q], made[i]), i))[:5]
        assert [got[q][n] for n in range(1, 6)] == want, q


def test_pairs_are_made_where_a_query_was_dealt(spark, small, monkeypatch):
    """Rows of l13 are dealt by query once, before features are made of them, and not for each side of the join."""
    plans, kept = [], learned.pairs_of

    def seen(rows, *of):
        plans.append(kept(rows, *of)._jdf.queryExecution().executedPlan().toString())
        return kept(rows, *of)

    monkeypatch.setattr(learned, "pairs_of", seen)
    learned.l13_folds(spark, small)
    assert len(plans) == 1 and "hashpartitioning(l_orderkey" in plans[0] and "hashpartitioning(qid" not in plans[0]


def test_slopes_equal_the_loop(spark):
    rng = np.random.default_rng(2)
    d, fold, w = rng.normal(size=(300, 3)), rng.integers(0, 4, 300), rng.normal(size=(4, 3))
    pairs = spark.createDataFrame([(int(f), x) for f, x in zip(fold, d.tolist())], "fold int, d array<double>").repartition(3)
    n, gradient, second = learned._slopes(pairs, w)
    for k in range(4):
        x = d[fold != k]
        p = 1 / (1 + np.exp(x @ w[k]))
        assert n[k] == len(x) and np.allclose(gradient[k], -(x.T @ p)) and np.allclose(second[k], (x * (p * (1 - p))[:, None]).T @ x)
