"""Trees grown by passes over sums, against single steps over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.boosting import Settings


def table(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n).astype(float), rng.integers(0, 9, n).astype(float), rng.integers(0, 2, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * (a - 6) + np.where(b > 4, 2, -1) * c)))).astype(int)
    a[rng.random(n) < 0.15] = np.nan
    b[(rng.random(n) < 0.3) & (y == 1)] = np.nan  # missing b speaks for label 1
    held = rng.random(n) < 0.25
    rows = [(int(y[i]), None if np.isnan(a[i]) else float(a[i]), float(b[i]), float(c[i]), bool(held[i])) for i in range(n)]
    return spark.createDataFrame(rows, "label int, a double, b double, c double, held boolean").repartition(3), np.stack([a, b, c], 1), y, held


def exact(x, y, s, signs, rounds):
    """Row by row: in every step the best of all splits of all leaves, by value and by side of the missing."""
    base = np.log(y.sum() / (len(y) - y.sum()))
    score, splits = np.full(len(y), base), []
    val = lambda g, h, lo, hi: min(max(-g.sum() / (h.sum() + s.l2), lo), hi)
    obj = lambda g, h, v: -(2 * g.sum() * v + (h.sum() + s.l2) * v * v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        leaves = [(np.ones(len(y), bool), -np.inf, np.inf)]
        while len(leaves) < s.leaves:
            best = None
            for k, (m, lo, hi) in enumerate(leaves):
                parent = obj(g[m], h[m], val(g[m], h[m], lo, hi))
                for f in range(x.shape[1]):
                    for cut in np.unique(x[m, f][~np.isnan(x[m, f])]):
                        for miss in (True, False):
                            gone = np.isnan(x[:, f])
                            left = m & np.where(gone, miss, x[:, f] <= cut)
                            right = m & ~left
                            if min(left.sum(), right.sum()) < s.least_rows:
                                continue
                            vl, vr = val(g[left], h[left], lo, hi), val(g[right], h[right], lo, hi)
                            if signs[f] * (vr - vl) < 0:
                                continue
                            gain = obj(g[left], h[left], vl) + obj(g[right], h[right], vr) - parent
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                                best = (gain, k, f, left, right, vl, vr, lo, hi)
            if best is None:
                break
            gain, k, f, left, right, vl, vr, lo, hi = best
            mid = (vl + vr) / 2
            bl, br = ((lo, hi), (lo, hi)) if not signs[f] else ((lo, mid), (mid, hi)) if signs[f] > 0 else ((mid, hi), (lo, mid))
            leaves[k : k + 1] = [(left, *bl), (right, *br)]
            splits.append(gain)
        for m, lo, hi in leaves:
            score[m] += s.rate * val(g[m], h[m], lo, hi)
    return 1 / (1 + np.exp(-score)), splits


@pytest.mark.parametrize("signs", [{}, {"a": 1, "c": -1}])
def test_trees_are_those_of_single_exact_steps(spark, signs):
    df, x, y, _ = table(spark)
    s = Settings(rounds=3, leaves=7, rate=0.3, least_rows=15, monotone=signs)
    model = boosting.fit(df, ("a", "b", "c"), s)
    want, gains = exact(x, y, s, [signs.get(c, 0) for c in "abc"], 3)
    assert np.allclose(model.probability(x), want, atol=1e-5)
    assert sorted(g for t in model.trees for g in t.gain if g) == pytest.approx(sorted(gains), rel=1e-3)
    got = df.select("label", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in "abc"])
    assert sorted(r["p"] for r in model.transform(got).collect()) == pytest.approx(sorted(want), abs=1e-5)


def test_monotone_at_every_split_point(spark):
    rng = np.random.default_rng(8)
    p1, p2 = rng.random(4000), rng.random(4000)
    y = rng.random(4000) < np.clip(p1 - 0.4 * p2 + 0.15 * np.sin(25 * p1) + 0.1, 0, 1)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, p1, p2, strict=True)], "label int, p1 double, p2 double")
    model = boosting.fit(df, ("p1", "p2"), Settings(rounds=8, leaves=15, rate=0.5, least_rows=40, monotone={"p1": 1, "p2": -1}))
    u, v = np.append(model.cuts[0], 2.0), np.append(model.cuts[1], 2.0)
    grid = model.probability(np.stack([np.repeat(u, len(v)), np.tile(v, len(u))], 1)).reshape(len(u), len(v))
    assert (np.diff(grid, axis=0) >= -1e-12).all() and (np.diff(grid, axis=1) <= 1e-12).all()
    assert grid[-1, 0] - grid[0, -1] > 0.6
    free = boosting.fit(df, ("p1", "p2"), Settings(rounds=8, leaves=15, rate=0.5, least_rows=40))
    grid = free.probability(np.stack([np.repeat(u, len(v)), np.tile(v, len(u))], 1)).reshape(len(u), len(v))
    assert (np.diff(grid, axis=0) < 0).any()


def test_held_rows_end_training_and_models_are_kept_as_text(spark, monkeypatch):
    df, x, y, held = table(spark)
    monkeypatch.setattr(boosting, "REWRITE", 2)
    model = boosting.fit(df, ("a", "b", "c"), Settings(rounds=20, leaves=15, rate=0.8, least_rows=5, patience=2), held="held")
    assert len(model.trees) == int(np.argmin(model.losses)) < 20 and len(model.losses) == len(model.trees) + 3
    p = model.probability(x)[held]
    assert -np.log(np.where(y[held], p, 1 - p)).mean() == pytest.approx(min(model.losses), abs=1e-5)
    again = boosting.Boosted.from_json(model.to_json())
    assert np.array_equal(again.probability(x), model.probability(x)) and again.gains() == model.gains()
    bagged = boosting.fit(df, ("a", "b", "c"), Settings(rounds=2, row_share=0.7, feature_share=0.6), held="held")
    twice = boosting.fit(df, ("a", "b", "c"), Settings(rounds=2, row_share=0.7, feature_share=0.6), held="held")
    assert np.array_equal(bagged.probability(x), twice.probability(x))


def test_nothing_to_learn(spark):
    df, _, _, _ = table(spark, 40)
    one = boosting.fit(df.where("label = 1"), ("a", "b"), Settings(rounds=3))
    assert not one.trees and one.base > 5
    none = boosting.fit(df.limit(0), ("a", "b"), Settings(rounds=3))
    assert none.probability(np.array([[1.0, np.nan]]))[0] == 0.5
    empty = boosting.fit(df.withColumn("a", F.lit(None).cast("double")), ("a", "c"), Settings(rounds=2, least_rows=2))
    assert all(f == 1 for t in empty.trees for f in t.feature if f >= 0)


def test_ranks_pairs_at_least_as_well_as_depth_wise_trees(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    df, _, _, _ = table(spark, 4000, 12)
    learn, test = df.where("not held"), df.where("held")
    auc = lambda d, c: BinaryClassificationEvaluator(rawPredictionCol=c).evaluate(d.withColumn("label", F.col("label").cast("double")))
    model = boosting.fit(df, ("a", "b", "c"), Settings(rounds=12, leaves=15, rate=0.3, least_rows=10), held="held")
    ours = auc(model.transform(test), "p")
    filled = lambda d: d.withColumns({f"{c}_null": F.col(c).isNull().cast("double") for c in "abc"}).na.fill(-1.0)
    stages = [VectorAssembler(inputCols=["a", "b", "c", "a_null", "b_null", "c_null"], outputCol="x"), GBTClassifier(featuresCol="x", maxIter=12, maxDepth=4, stepSize=0.3, seed=1)]
    theirs = auc(Pipeline(stages=stages).fit(filled(learn)).transform(filled(test)), "rawPrediction")
    assert ours >= theirs - 0.003, (ours, theirs)
