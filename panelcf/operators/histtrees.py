"""Forests and boosted trees on binned features, for all treated units in one job.

A unit of work is a row: a treated unit, a method, and a block of a forest's trees or a validation split. The task holds one
unit's days, at most its calendar, and grows trees from histograms of binned features; units, blocks and splits are dealt
over the cluster. Bootstrap draws and feature draws depend on the seed, the unit and the tree alone, so that a lost executor or another partitioning gives
the same trees. Trees come back as a table, and ``predict_by_table`` predicts from it in SQL expressions.

Trees are grown best first: the leaf with the greatest gain is split next, until there are ``max_leaves`` leaves (or none
can be split, if there is no limit; the order then makes no difference). A split needs ``min_leaf`` different days on both
sides. Of equal gains the first feature and the lowest cut win. A value goes left if it is at most the cut, which lies in
the middle between two neighbouring values of the training days (at most ``max_bins`` - 1 cuts a feature, by rank).
"""

from __future__ import annotations

import heapq
import sys
import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcf.sources.tables import stored

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Forest:
    """Mean of trees, each grown on a bootstrap sample of the days."""

    trees: int = 500
    max_depth: int | None = None
    min_leaf: int = 1
    features: float = 1.0
    bootstrap: bool = True
    max_bins: int = 255
    max_leaves: int | None = None
    block: int = 25


@dataclass(frozen=True)
class Boosting:
    """The mean, plus ``rate`` times the trees, each grown on what the ones before leave over."""

    rounds: int = 500
    rate: float = 0.05
    max_leaves: int | None = 31
    max_depth: int | None = None
    min_leaf: int = 20
    features: float = 1.0
    max_bins: int = 255


Spec = Forest | Boosting


class Tree(NamedTuple):
    """Nodes as arrays; the root is node 0. A leaf has feature -1."""

    feature: np.ndarray
    code: np.ndarray  # codes up to this one go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: np.ndarray

    def values(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        while len(live := np.flatnonzero(self.feature[node] >= 0)):
            at = node[live]
            goes_left = codes[live, self.feature[at]] <= self.code[at]
            node[live] = np.where(goes_left, self.left[at], self.right[at])
        return self.value[node]


def cuts_of(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Cuts between neighbouring values: all of them, or those nearest to equal shares of the rows."""
    different, counts = np.unique(values, return_counts=True)
    middles = (different[:-1] + different[1:]) / 2
    if len(middles) < max_bins:
        return middles
    before = np.cumsum(counts)[:-1]
    chosen = np.searchsorted(before, len(values) * np.arange(1, max_bins) / max_bins)
    return middles[np.unique(np.minimum(chosen, len(middles) - 1))]


class Binned:
    """A unit's days in codes: the number of cuts below a value, by feature."""

    def __init__(self, x: np.ndarray, train: np.ndarray, max_bins: int):
        self.cuts = [cuts_of(x[train, j], max_bins) for j in range(x.shape[1])]
        self.codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        self.bins = 1 + max(map(len, self.cuts))


def _sums(flat: np.ndarray, weights: np.ndarray, size: int, width: int) -> np.ndarray:
    return np.bincount(flat, np.repeat(weights, width), size)


def grow(codes: np.ndarray, bins: int, y: np.ndarray, weight: np.ndarray, spec: Spec, allowed: np.ndarray) -> Tree:
    """A tree for ``y`` on rows with positive ``weight``; ``allowed`` are the features that may split."""
    rows = np.flatnonzero(weight)
    width, size = len(allowed), len(allowed) * bins
    flat = codes[:, allowed] + np.arange(width) * bins
    centre = np.average(y[rows], weights=weight[rows])
    wy, whole = (y - centre) * weight, bool((weight[rows] == 1).all())
    nodes: list[list] = []  # feature, code, left, right, value, depth
    waiting: list = []

    def histograms(mine: np.ndarray) -> list[np.ndarray]:
        """By feature and bin: days, their weight and their weighted sum."""
        cells = flat[mine].ravel()
        days = np.bincount(cells, minlength=size)
        return [days, days if whole else _sums(cells, weight[mine], size, width), _sums(cells, wy[mine], size, width)]

    def add(mine: np.ndarray, depth: int, hist: list[np.ndarray] | None) -> None:
        w, s = weight[mine].sum(), wy[mine].sum()
        node = len(nodes)
        nodes.append([-1, 0, 0, 0, centre + s / w, depth])
        if len(mine) < 2 * spec.min_leaf or len(mine) < 2 or (spec.max_depth is not None and depth >= spec.max_depth) or width == 0:
            return
        hist = hist or histograms(mine)
        days, ws, ss = (np.cumsum(h.reshape(width, bins), axis=1)[:, :-1] for h in hist)
        fits = (days >= spec.min_leaf) & (len(mine) - days >= spec.min_leaf) & (days > 0) & (days < len(mine))
        if not fits.any():
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, ss * ss / ws + (s - ss) ** 2 / (w - ws) - s * s / w, -np.inf)
        best = int(gain.argmax())
        worth = float(gain.flat[best])
        if worth > 1e-12 * (wy[mine] ** 2 / weight[mine]).sum():
            heapq.heappush(waiting, (-worth, node, depth, mine, hist, *divmod(best, bins - 1)))

    add(rows, 0, None)
    leaves = 1
    while waiting and (spec.max_leaves is None or leaves < spec.max_leaves):
        _, node, depth, mine, hist, j, code = heapq.heappop(waiting)
        goes_left = codes[mine, allowed[j]] <= code
        sides = mine[goes_left], mine[~goes_left]
        less = int(len(sides[1]) < len(sides[0]))
        part = histograms(sides[less])
        rest = [h - p for h, p in zip(hist, part)]
        nodes[node][:4] = [int(allowed[j]), code, len(nodes), len(nodes) + 1]
        for k in (0, 1):
            add(sides[k], depth + 1, part if k == less else rest)
        leaves += 1
    columns = zip(*nodes)
    return Tree(*(np.array(c, float if k == 4 else np.int64) for k, c in enumerate(columns)))


def _draws(seed: int, unit: str, tree: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(unit.encode()), tree])


def _allowed(rng: np.random.Generator, width: int, share: float) -> np.ndarray:
    if share >= 1:
        return np.arange(width)
    return np.sort(rng.permutation(width)[: max(1, round(share * width))])


def fit(spec: Spec, x: np.ndarray, y: np.ndarray, train: np.ndarray, unit: str, seed: int, first: int = 0,
        count: int | None = None) -> tuple[np.ndarray, list[tuple[int, float, Tree, Binned]]]:
    """(sum of the trees' predictions on all days, trees as (number, weight, tree, bins)). ``first`` and ``count`` choose trees of a forest."""
    binned = Binned(x, train, spec.max_bins)
    codes, target = binned.codes[train], y[train]
    total, out = np.zeros(len(x)), []
    if isinstance(spec, Forest):
        for k in range(first, first + (spec.trees if count is None else count)):
            rng = _draws(seed, unit, k)
            drawn = np.bincount(rng.integers(0, len(target), len(target)), minlength=len(target)) if spec.bootstrap else np.ones(len(target))
            tree = grow(codes, binned.bins, target, drawn.astype(float), spec, _allowed(rng, x.shape[1], spec.features))
            total += tree.values(binned.codes) / spec.trees
            out.append((k, 1 / spec.trees, tree, binned))
        return total, out
    ones, total[:] = np.ones(len(target)), target.mean()
    zero = np.zeros(1, np.int64)
    out.append((0, 1.0, Tree(zero - 1, zero, zero, zero, np.array([target.mean()]), zero), binned))
    for k in range(1, spec.rounds + 1):
        tree = grow(codes, binned.bins, target - total[train], ones, spec, _allowed(_draws(seed, unit, k), x.shape[1], spec.features))
        total += spec.rate * tree.values(binned.codes)
        out.append((k, spec.rate, tree, binned))
    return total, out


# --- the job -------------------------------------------------------------------

_TREE = "tree int, weight double, node int, depth int, feature string, cut double, left int, right int, value double"
_FITS = f"treated_id string, method string, split int, y_hat array<double>, dates array<date>, y array<double>, rmse double, trees array<struct<{_TREE.replace(' ', ': ')}>>".replace(",: ", ", ")


def packed(rows: DataFrame, names, min_pre: int = 1) -> DataFrame:
    """One row per treated unit with its days in date order, from (treated_id, date, y, is_pre, split, ids, x).

    ``ids`` name the first values of ``x``, ``names`` the others. A unit with too few days before its start is an error of the
    job, as is one whose days have different donors.
    """
    day = F.struct("date", "y", F.coalesce("is_pre", F.lit(False)).alias("pre"), "split", "ids", "x")
    units = rows.groupBy("treated_id").agg(F.array_sort(F.collect_list(day)).alias("days"))

    def each(name: str) -> Column:
        return F.transform("days", lambda d: d[name])

    n_pre = F.size(F.filter("days", lambda d: d["pre"]))
    few = F.concat(F.lit("treated unit '"), "treated_id", F.lit("': "), n_pre.cast("string"),
                   F.lit(f" complete dates before the start, at least {min_pre} are needed"))
    mixed = F.concat(F.lit("treated unit '"), "treated_id", F.lit("': its dates have different donors"))
    checked = F.when(n_pre < min_pre, F.raise_error(few).cast("array<double>")).when(
        F.exists("days", lambda d: d["ids"] != F.get("days", F.lit(0))["ids"]), F.raise_error(mixed).cast("array<double>")).otherwise(F.flatten(each("x")))
    features = F.concat(F.get("days", F.lit(0))["ids"], F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    return units.select("treated_id", each("date").alias("dates"), *[each(c).alias(c) for c in ("y", "pre", "split")], checked.alias("x"), features.alias("features"))


def _tree_rows(trees, features: list[str]) -> list[dict]:
    out = []
    for number, weight, tree, binned in trees:
        for node in range(len(tree.value)):
            j = int(tree.feature[node])
            inner = j >= 0
            out.append({
                "tree": number, "weight": weight, "node": node, "depth": int(tree.depth[node]), "feature": features[j] if inner else None,
                "cut": float(binned.cuts[j][tree.code[node]]) if inner else None, "left": int(tree.left[node]) if inner else None,
                "right": int(tree.right[node]) if inner else None, "value": float(tree.value[node]),
            })
    return out


def _worker(models: dict[str, Spec], seed: int, keep_trees: bool):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                spec, y, pre = models[r.method], np.asarray(r.y, float), np.asarray(r.pre, bool)
                x = np.asarray(r.x, float).reshape(len(y), -1)
                tested = None
                if r.job_split >= 0:
                    split = np.array([-1 if s is None or s != s else int(s) for s in r.split])
                    tested, train = np.flatnonzero(pre & (split == r.job_split)), np.flatnonzero(pre & (split < r.job_split))
                else:
                    train = np.flatnonzero(pre)
                count = r.count if isinstance(spec, Forest) and r.count > 0 else None
                y_hat, trees = fit(spec, x, y, train, r.treated_id, seed, r.first, count)
                rmse = None if tested is None else float(np.sqrt(np.mean((y[tested] - y_hat[tested]) ** 2)))
                yield pd.DataFrame([(
                    r.treated_id, r.method, r.job_split, None if rmse is not None else y_hat, r.dates, r.y, rmse,
                    _tree_rows(trees, list(r.features)) if keep_trees else [],
                )], columns=["treated_id", "method", "split", "y_hat", "dates", "y", "rmse", "trees"])

    return run


def _jobs(units: DataFrame, jobs: list[tuple[str, int, int, int]]) -> DataFrame:
    """A row per unit and job (method, split, first tree, number of trees), dealt over the cluster."""
    spark = units.sparkSession
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("job_split"), F.lit(a).alias("first"), F.lit(n).alias("count")) for m, s, a, n in jobs])
    rows = units.withColumn("job", F.explode(kinds)).select(*units.columns, "job.*")
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism),
                            "treated_id", "method", "job_split", "first")


@dataclass(frozen=True)
class Grown:
    predictions: DataFrame  # treated_id, method, date, y, y_hat
    trees: DataFrame  # treated_id, method, tree, weight, node, feature, cut, left, right, value


def fit_units(units: DataFrame, models: dict[str, Spec], seed: int = 0, store: str | None = None, keep_trees: bool = True) -> Grown:
    """Fit every unit of ``packed`` rows with every model on the days before its start; predictions on all days."""
    jobs = []
    for name, spec in models.items():
        blocks = range(0, spec.trees, spec.block) if isinstance(spec, Forest) else [0]
        jobs += [(name, -1, a, min(spec.block, spec.trees - a) if isinstance(spec, Forest) else 0) for a in blocks]
    fits = stored(_jobs(units, jobs).mapInPandas(_worker(models, seed, keep_trees), _FITS), store and f"{store}/fits")
    days = fits.select("treated_id", "method", F.explode(F.arrays_zip("dates", "y", "y_hat")).alias("d")).groupBy("treated_id", "method", F.col("d.dates").alias("date")).agg(
        F.first("d.y").alias("y"), F.sum("d.y_hat").alias("y_hat"))
    return Grown(days, fits.select("treated_id", "method", F.inline("trees")))


def validate_units(units: DataFrame, models: dict[str, Spec], n_splits: int, seed: int = 0, store: str | None = None) -> DataFrame:
    """(treated_id, method, split, rmse): every unit, model and split is a fit of its own, on the days before the split."""
    tested = units.select("*", F.array_distinct("split").alias("used"))
    jobs = [(name, s, 0, 0) for name in models for s in range(n_splits)]
    rows = _jobs(tested, jobs).where(F.array_contains("used", F.col("job_split"))).drop("used")
    done = rows.mapInPandas(_worker(models, seed, False), _FITS)
    return stored(done.select("treated_id", "method", "split", "rmse"), store and f"{store}/errors")


def predict_by_table(rows: DataFrame, trees: DataFrame, block: int = 50) -> DataFrame:
    """(treated_id, method, date, y_hat) from a table of trees, for rows (treated_id, date, ids, x) with feature ids and values.

    Trees are walked by expressions, a block of a unit's trees at a time; a row meets each block of its unit once.
    """
    node = F.struct("node", "feature", "cut", "left", "right", "value")
    whole = trees.groupBy("treated_id", "method", "tree", "weight").agg(F.max("depth").alias("depth"), F.sort_array(F.collect_list(node)).alias("nodes"))
    blocks = whole.groupBy("treated_id", "method", F.floor(F.col("tree") / block).alias("block")).agg(F.collect_list(F.struct("weight", "depth", "nodes")).alias("trees"))
    joined = rows.select("treated_id", "date", F.map_from_arrays("ids", "x").alias("of")).join(blocks, "treated_id")

    def value(t):
        def step(at, _):  # a leaf stays where it is
            n = F.get(t["nodes"], at)
            return F.when(n["feature"].isNull(), at).when(F.element_at("of", n["feature"]) <= n["cut"], n["left"]).otherwise(n["right"])

        return F.get(t["nodes"], F.aggregate(F.sequence(F.lit(0), t["depth"]), F.lit(0), step))["value"] * t["weight"]

    part = F.aggregate("trees", F.lit(0.0), lambda total, t: total + value(t))
    return joined.select("treated_id", "method", "date", part.alias("part")).groupBy("treated_id", "method", "date").agg(F.sum("part").alias("y_hat"))
