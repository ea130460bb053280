"""Grown trees against exhaustive search, Spark's own estimators, and themselves under other partitionings."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from panelcf.operators import histtrees as ht
from panelcf.operators import panel as panels
from panelcf.operators import trees


def brute(x, y, w, min_leaf, depth):
    """Predictions on the training rows of a tree that tries every cut of every feature."""
    out = np.full(len(y), np.average(y, weights=w))
    if depth == 0 or len(y) < 2:
        return out
    sse = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()
    everything = np.ones(len(y), bool)
    best = None
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= min_leaf:
                gain = sse(everything) - sse(left) - sse(~left)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, left
    if best is None or best[0] <= 1e-9:
        return out
    for side in (best[1], ~best[1]):
        out[side] = brute(x[side], y[side], w[side], min_leaf, depth - 1)
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.integers(1, 4), st.integers(1, 4), st.integers(0, 3), st.booleans())
def test_trees_equal_exhaustive_search(seed, n, width, min_leaf, depth, weighted):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, width)).round(1), rng.normal(size=n)
    w = rng.integers(1, 4, n).astype(float) if weighted else np.ones(n)
    binned = ht.Binned(x, np.arange(n), 255)
    tree = ht.grow(binned.codes, binned.bins, y, w, ht.Forest(max_depth=depth, min_leaf=min_leaf), np.arange(width))
    got, want = tree.values(binned.codes), brute(x, y, w, min_leaf, depth)
    # equal loss where equally good cuts differ
    assert np.isclose((w * (y - got) ** 2).sum(), (w * (y - want) ** 2).sum(), atol=1e-7) or np.allclose(got, want)
    if depth <= 1:
        assert (w * (y - got) ** 2).sum() <= (w * (y - want) ** 2).sum() + 1e-7


def test_leaf_limit_and_best_first_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = np.where(x[:, 0] > 0, 10.0, 0.0) + np.where((x[:, 0] > 0) & (x[:, 1] > 0), 5.0, 0.0) + rng.normal(size=400) * 0.01
    binned = ht.Binned(x, np.arange(400), 255)
    for leaves in (1, 2, 3, 9):
        tree = ht.grow(binned.codes, binned.bins, y, np.ones(400), ht.Boosting(max_leaves=leaves, min_leaf=7), np.arange(5))
        assert (tree.feature < 0).sum() == leaves
        node = np.unique(tree.values(binned.codes), return_counts=True)[1]
        assert node.min() >= 7
    three = ht.grow(binned.codes, binned.bins, y, np.ones(400), ht.Boosting(max_leaves=3, min_leaf=7), np.arange(5))
    assert three.feature[:3].tolist() == [0, -1, 1] or three.feature[:3].tolist() == [0, 1, -1] or set(three.feature[three.feature >= 0]) == {0, 1}


def test_few_bins_lie_between_values_and_share_the_rows():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=3000), np.zeros(3000)])
    cuts = ht.cuts_of(values, 20)
    assert len(cuts) <= 19 and not np.isin(cuts, values).any() and (np.diff(cuts) > 0).all()
    shares = np.bincount(np.searchsorted(cuts, values[:3000]))
    assert shares.max() < 3 * 6000 / 20
    assert ht.cuts_of(np.array([3.0, 1.0, 3.0, 2.0]), 255).tolist() == [1.5, 2.5]
    assert ht.cuts_of(np.array([2.0, 2.0]), 255).tolist() == []


def days(spark, n=140, units=("A", "B"), width=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for u in units:
        x = rng.normal(size=(n, width)).round(2)
        y = x @ np.arange(1, width + 1) + np.abs(x[:, 0]) + rng.normal(size=n)
        for k in range(n):
            date = dt.date(2020, 1, 1) + dt.timedelta(days=k)
            donors = [(f"d{j}", float(v)) for j, v in enumerate(x[k])]
            rows.append((u, date, float(y[k]), donors, dt.date(2020, 4, 1), date < dt.date(2020, 4, 1)))
    return spark.createDataFrame(rows, "treated_id string, date date, y double, donors array<struct<id: string, x: double>>, start date, is_pre boolean")


def by_estimator(design, estimator):
    rows = design.select("treated_id", "date", "y", "is_pre", *[F.col("donors")[j]["x"].alias(f"x{j}") for j in range(3)])
    wide = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(rows)
    out = {}
    for unit in ("A", "B"):
        mine = wide.filter(F.col("treated_id") == unit)
        model = estimator.fit(mine.filter("is_pre").coalesce(1).withColumnRenamed("y", "label"))
        out |= {(r.treated_id, r.date): r.prediction for r in model.transform(mine).collect()}
    return out


def predicted(frame):
    return {(r.treated_id, r.date): r.y_hat for r in frame.collect()}


@pytest.mark.parametrize("rounds, depth", [(1, 1), (1, 3), (4, 2)])
def test_boosting_equals_spark_at_full_rate(spark, rounds, depth):
    """Spark's first tree is not scaled, so it is the mean and the first tree here at rate 1; its later trees
    are grown on twice the residuals, so its step of one half is rate 1 here."""
    design = days(spark)
    want = by_estimator(design, GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=0.5, maxBins=255, minInstancesPerNode=5, featureSubsetStrategy="all"))
    got = predicted(trees.grow_all(design, {"gb": ht.Boosting(rounds, 1.0, None, depth, 5)}).predictions)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-6


def test_unsampled_forest_equals_spark(spark):
    design = days(spark)
    want = by_estimator(design, RandomForestRegressor(numTrees=1, maxDepth=4, bootstrap=False, maxBins=255, minInstancesPerNode=5, featureSubsetStrategy="all"))
    got = predicted(trees.grow_all(design, {"rf": ht.Forest(3, 4, 5, bootstrap=False)}).predictions)
    assert max(abs(got[k] - want[k]) for k in got) < 1e-6


def test_same_trees_whatever_the_partitions_and_blocks(spark):
    design, found = days(spark), []
    for block, parts in ((25, 1), (4, 7)):
        models = {"rf": ht.Forest(12, min_leaf=5, block=block), "gbt": ht.Boosting(12, features=0.7, min_leaf=5)}
        grown = trees.grow_all(design.repartition(parts), models, seed=3)
        found.append((predicted(grown.predictions.filter("method = 'rf'")), sorted(map(str, grown.trees.collect()))))
    assert found[0][1] == found[1][1]
    assert all(abs(found[0][0][k] - found[1][0][k]) < 1e-9 for k in found[0][0])
    other = trees.grow_all(design, models, seed=4)
    assert sorted(map(str, other.trees.collect())) != found[0][1]


def test_table_predicts_what_the_fit_predicts(spark, tmp_path):
    design = panels.design_daily(days(spark))
    grown = trees.grow_all(design, {"rf": ht.Forest(60, min_leaf=5), "gbt": ht.Boosting(60, min_leaf=5)}, store=str(tmp_path))
    want = {(r.treated_id, r.method, r.date): (r.y, r.y_hat) for r in grown.predictions.collect()}
    got = {(r.treated_id, r.method, r.date): (r.y, r.y_hat) for r in trees.predict_trees(design, grown.trees).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 2 * 140
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_validation_trains_on_earlier_splits_only(spark):
    design = panels.expanding_splits(days(spark), 4)
    spec = {"gb": ht.Boosting(5, 0.3, None, 2, 1)}
    got = {(r.treated_id, r.split): r for r in trees.time_series_cv(design, None, spec, n_splits=4).collect()}
    assert len(got) == 8
    for unit in ("A", "B"):
        rows = design.filter((F.col("treated_id") == unit) & F.col("is_pre")).orderBy("date").collect()
        x, y = np.array([[d.x for d in r.donors] for r in rows]), np.array([r.y for r in rows])
        split = np.array([-1 if r.split is None else r.split for r in rows])
        errors = []
        for s in range(4):
            y_hat, _ = ht.fit(spec["gb"], x, y, np.flatnonzero(split < s), unit, 0)
            errors.append(np.sqrt(np.mean((y - y_hat)[split == s] ** 2)))
            assert abs(got[unit, s].rmse - errors[-1]) < 1e-9
        assert abs(got[unit, 0].mean_rmse - np.mean(errors)) < 1e-9


def test_guards(spark):
    design = days(spark)
    with pytest.raises(Exception, match="complete dates before the start"):
        trees.grow_all(design, min_pre=120).predictions.collect()
    mixed = design.withColumn("donors", F.when(F.col("date") > "2020-03-01", F.slice("donors", 1, 2)).otherwise(F.col("donors")))
    with pytest.raises(Exception, match="different donors"):
        trees.grow_all(mixed, {"rf": ht.Forest(1)}).predictions.collect()
    with pytest.raises(ValueError, match="all Forest"):
        trees.time_series_cv(design, None, {"a": ht.Forest(1), "b": GBTRegressor()})


def test_no_units_no_rows(spark):
    assert trees.grow_all(days(spark).limit(0), {"rf": ht.Forest(2)}).predictions.collect() == []
