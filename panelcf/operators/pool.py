"""Fits of many treated units that share one pool of stations: one matrix of moments for all of them.

If every other station is a donor, the treated station is itself a column of the pool: the complete dates are the same for all units
of a start, and unit j takes row and column j of the matrix as its target and the rest as its donors. So the panel has a row per date,
not per unit and date, moments are summed once per start and fold, and the weights of least squares and ridge come from one
decomposition for all units: with K the matrix (plus the penalty), the weights of unit j are -K^-1[d, j] / K^-1[j, j], by the
inverse of a bordered matrix.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcf.functions.columns import HOUSE, PanelCols
from panelcf.operators.panel import _series, with_folds
from panelcf.operators.synth import _SCORES, _WEIGHTS, METHODS, MONTHLY, ScmSettings, _grid, _solve_ols, _solve_sparse, _spread, choose
from panelcf.sources.tables import stored

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units that one task solves from a copy of their matrix.
BLOCK = 8

_MOMENTS = "start date, fold int, n long, n_pre long, ids array<string>, sums array<double>, cross array<double>"


def pool_panel(m: DataFrame, assignments: DataFrame, grain: str = "month", cols: PanelCols = HOUSE) -> DataFrame:
    """``start, date, ids, x, is_pre``: the dates on which every station has a value, once per different start.

    ``ids`` are all stations in order, ``x`` their values.
    """
    series = _series(m, grain, cols)
    known = F.when(F.col("x").isNotNull(), F.struct(F.col("station_id").cast("string").alias("id"), "x"))
    by_date = series.groupBy("date").agg(F.sort_array(F.collect_list(known)).alias("cells"))
    n_stations = series.select(F.count_distinct("station_id")).scalar()
    starts = assignments.agg(F.collect_set("start")).scalar()  # different days
    complete = by_date.filter((F.size("cells") == n_stations) & (n_stations > 1)).withColumn("starts", starts)
    return complete.withColumn("start", F.explode("starts")).select(
        "start", "date", F.transform("cells", lambda c: c["id"]).alias("ids"), F.transform("cells", lambda c: c["x"]).alias("x"),
        (F.col("date") < F.col("start")).alias("is_pre"))


def pool_problems(pool: DataFrame, assignments: DataFrame, min_pre: int = 1) -> DataFrame:
    """``treated_id, problem`` for units that cannot be fitted; empty when all is well."""
    sizes = pool.groupBy("start").agg(F.count_if("is_pre").alias("n_pre"), F.first("ids").alias("ids"))
    units = assignments.groupBy("treated_id").agg(F.count(F.lit(1)).alias("n_roles"), F.min("start").alias("start"))
    return units.join(sizes, "start", "left").select(
        "treated_id",
        F.when(F.col("n_roles") > 1, F.lit("assigned more than once"))
        .when(~F.coalesce(F.array_contains("ids", F.col("treated_id").cast("string")), F.lit(False)),
              F.lit("no complete date: unit absent, or no common dates"))
        .when(F.col("n_pre") < min_pre, F.concat(
            F.lit(f"fewer than {min_pre} complete dates before the start: "), F.col("n_pre").cast("string")))
        .alias("problem"),
    ).filter(F.col("problem").isNotNull())


def require_fittable_pool(pool: DataFrame, assignments: DataFrame, min_pre: int = 1) -> None:
    """Raise for the first unit (by id) that cannot be fitted."""
    bad = pool_problems(pool, assignments, min_pre).orderBy("treated_id").first()
    if bad is not None:
        raise ValueError(f"treated unit {bad.treated_id!r}: {bad.problem}")


# --- moments -------------------------------------------------------------------


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for (start, fold), part in batch.groupby(["start", "fold"], sort=False):
            z = np.stack(part["x"].to_numpy())
            rows.append((start, int(fold), len(z), int(part["n_pre"].iloc[0]), part["ids"].iloc[0], z.sum(0), (z.T @ z).ravel()))
        yield pd.DataFrame(rows, columns=["start", "fold", "n", "n_pre", "ids", "sums", "cross"])


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    first = part.iloc[[0]].copy()
    first["n"] = int(part["n"].sum())
    for c in ("sums", "cross"):
        first[c] = [np.sum(np.stack(part[c].to_numpy()), axis=0)]
    return first


def pool_moments(pool: DataFrame, folds: int = 5) -> DataFrame:
    """Per start and fold: n, station ids, sums and cross products of all stations, whatever the number of treated units."""
    pre = with_folds(pool, folds, "start").filter("is_pre").select("start", "fold", "n_pre", "ids", "x")
    return pre.mapInPandas(_partial, _MOMENTS).groupBy("start", "fold").applyInPandas(_merge, _MOMENTS)


@dataclass
class _Pool:
    """Sums over some dates, for all stations."""

    n: float
    s: np.ndarray
    c: np.ndarray

    def __sub__(self, other: _Pool) -> _Pool:
        return _Pool(self.n - other.n, self.s - other.s, self.c - other.c)

    def gram(self, intercept: bool) -> np.ndarray:
        return self.c - np.outer(self.s, self.s) / self.n if intercept else self.c

    def offset(self, v: np.ndarray, intercept: bool) -> np.ndarray:
        return v @ self.s / self.n if intercept else np.zeros(v.shape[:-1])

    def sse(self, v: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared error of contrasts ``v`` (1 at the target, minus the weights elsewhere) with intercept ``b``."""
        return np.einsum("...i,ij,...j->...", v, self.c, v) - 2 * b * (v @ self.s) + self.n * b * b

    def r2(self, sse: np.ndarray, j: int) -> np.ndarray:
        sst = float(self.c[j, j] - self.s[j] ** 2 / self.n)
        return 1 - sse / sst if sst > 0 else (sse == 0).astype(float)


def _contrast(w: np.ndarray, j: int) -> np.ndarray:
    """Weights of the others as contrasts over all stations."""
    return np.insert(-w, j, 1.0, axis=-1)


class _Solver:
    """Weights of any unit of the pool from its Gram matrix."""

    def __init__(self, gram: np.ndarray, n: float, cfg: ScmSettings):
        self.gram, self.n, self.cfg = gram, n, cfg
        self.parts: tuple[np.ndarray, np.ndarray] | None = None
        self.inverse: np.ndarray | None = None

    def others(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        keep = np.delete(np.arange(len(self.gram)), j)
        return self.gram[np.ix_(keep, keep)], self.gram[keep, j]

    def ridge(self, j: int, alphas) -> np.ndarray:
        """For every alpha, by one decomposition for all units and alphas."""
        if self.parts is None:
            self.parts = np.linalg.eigh(self.gram)
        values, vectors = self.parts
        column = (vectors[j] / (np.maximum(values, 0.0) + np.asarray(alphas)[:, None])) @ vectors.T
        return np.delete(-column / column[:, [j]], j, axis=1)

    def ols(self, j: int) -> np.ndarray:
        """By the inverse of the whole matrix if that is well posed; the parts without j then are, too."""
        if self.inverse is None:
            scale = np.sqrt(np.where(np.diag(self.gram) > 0, np.diag(self.gram), 1.0))
            scaled = self.gram / np.outer(scale, scale)
            posed = np.linalg.cond(scaled) < 1e8
            self.inverse = np.linalg.inv(scaled) / np.outer(scale, scale) if posed else np.zeros((0, 0))
        if len(self.inverse):
            return np.delete(-self.inverse[:, j] / self.inverse[j, j], j)
        return _solve_ols(*self.others(j))

    def sparse(self, j: int, alpha: float, ratio: float, w: np.ndarray) -> np.ndarray:
        gram, xy = self.others(j)
        return _solve_sparse(gram + alpha * (1 - ratio) * self.n * np.eye(len(xy)), xy, alpha * ratio * self.n, w, self.cfg.max_steps)

    def path(self, j: int, alphas, ratios) -> np.ndarray:
        out = np.empty((len(ratios), len(alphas), len(self.gram) - 1))
        for r, ratio in enumerate(ratios):
            w = np.zeros(len(self.gram) - 1)
            for i in np.argsort(alphas)[::-1]:
                w = out[r, i] = self.sparse(j, alphas[i], ratio, w)
        return out


def _matrix(n, sums, cross) -> _Pool:
    return _Pool(n, np.asarray(sums), np.asarray(cross).reshape(len(sums), len(sums)))


def _fold_scores(cfg: ScmSettings):
    """Scores of all grid points; a row is a fold, a method and a block of units, with the moments of the fold and of all folds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                held = _matrix(row.n, row.sums, row.cross)
                train = _matrix(row.total_n, row.total_sums, row.total_cross) - held
                solver, place = _Solver(train.gram(cfg.fit_intercept), train.n, cfg), {i: k for k, i in enumerate(row.ids)}
                alphas, ratios = _grid(row.method, cfg)
                r, a = np.meshgrid(np.arange(len(ratios)), np.arange(len(alphas)), indexing="ij")
                for unit in row.units:
                    j = place[unit]
                    v = _contrast(solver.ridge(j, alphas)[None] if row.method == "ridge" else solver.path(j, alphas, ratios), j)
                    sse = held.sse(v, train.offset(v, cfg.fit_intercept))
                    yield pd.DataFrame({
                        "treated_id": unit, "method": row.method, "alpha": np.asarray(alphas)[a.ravel()], "l1_ratio": np.asarray(ratios)[r.ravel()],
                        "alpha_pos": a.ravel().astype("int32"), "l1_pos": r.ravel().astype("int32"), "fold": np.int32(row.fold),
                        "score": (held.r2(sse, j) if row.method == "ridge" else sse / held.n).ravel(),
                    })

    return run


def _refits(cfg: ScmSettings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                total = _matrix(row.n, row.sums, row.cross)
                solver, ids = _Solver(total.gram(cfg.fit_intercept), total.n, cfg), list(row.ids)
                for choice in row.choices:
                    j, method = ids.index(choice["treated_id"]), choice["method"]
                    if method == "ols":
                        w = solver.ols(j)
                    elif method == "ridge":
                        w = solver.ridge(j, [choice["alpha"]])[0]
                    else:
                        w = solver.sparse(j, choice["alpha"], choice["l1_ratio"], np.zeros(len(ids) - 1))
                    yield pd.DataFrame({
                        "treated_id": choice["treated_id"], "method": method, "alpha": choice["alpha"], "l1_ratio": choice["l1_ratio"],
                        "intercept": float(total.offset(_contrast(w, j), cfg.fit_intercept)), "station_id": ids[:j] + ids[j + 1:], "weight": w,
                    })

    return run


# --- Spark side ----------------------------------------------------------------


def _blocks(assignments: DataFrame) -> DataFrame:
    """``start, block, units``: the units of a start in blocks of at most BLOCK."""
    place = F.row_number().over(Window.partitionBy("start").orderBy("treated_id")) - 1
    return assignments.select("start", F.col("treated_id").cast("string").alias("treated_id")).withColumn("block", F.floor(place / BLOCK)).groupBy(
        "start", "block").agg(F.sort_array(F.collect_list("treated_id")).alias("units"))


def _totals(moments: DataFrame) -> DataFrame:
    return moments.groupBy("start").applyInPandas(lambda part: _merge(part.sort_values("fold")), _MOMENTS).drop("fold")


def pool_scores(moments: DataFrame, assignments: DataFrame, methods, cfg: ScmSettings) -> DataFrame:
    """Held-out score of every grid point and fold, as ``synth.cv_scores``; every fold, method and block of units is a row."""
    short = F.raise_error(F.lit("fewer dates before the start than folds")).cast("long")
    total = _totals(moments).select("start", F.col("n").alias("total_n"), F.col("sums").alias("total_sums"), F.col("cross").alias("total_cross"))
    each = moments.join(total, "start").join(_blocks(assignments), "start").withColumns({
        "method": F.explode(F.array(*[F.lit(m) for m in methods if m != "ols"])),
        "n": F.when(F.col("n_pre") < cfg.folds, short).otherwise(F.col("n")),
    })
    return _spread(each, "start", "block", "method", "fold").mapInPandas(_fold_scores(cfg), _SCORES)


def fit_pool(pool: DataFrame, assignments: DataFrame, methods=METHODS, cfg: ScmSettings = MONTHLY, store: str | None = None) -> DataFrame:
    """Weights per unit, method and donor as ``synth.fit_scm``, from moments that all units of a start share."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}; choose from {METHODS}")
    moments = stored(pool_moments(pool, cfg.folds), store and f"{store}/moments")
    units = assignments.select("start", F.col("treated_id").cast("string").alias("treated_id"))
    parts = []
    if "ols" in methods:
        parts.append(units.select("treated_id", F.lit("ols").alias("method"), F.lit(0.0).alias("alpha"), F.lit(0.0).alias("l1_ratio")))
    if set(methods) - {"ols"}:
        parts.append(choose(pool_scores(moments, assignments, methods, cfg)).drop("cv_score"))
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    place = F.row_number().over(Window.partitionBy("start", "method").orderBy("treated_id")) - 1
    blocks = chosen.join(units, "treated_id").withColumn("block", F.floor(place / BLOCK)).groupBy("start", "method", "block").agg(
        F.collect_list(F.struct("treated_id", "method", "alpha", "l1_ratio")).alias("choices"))
    rows = _totals(moments).select("start", "n", "ids", "sums", "cross").join(blocks, "start")
    return _spread(rows, "start", "method", "block").mapInPandas(_refits(cfg), _WEIGHTS)


def predict_pool(pool: DataFrame, weights: DataFrame, assignments: DataFrame) -> DataFrame:
    """``treated_id, method, date, y, y_hat`` on all dates, as ``synth.predict_scm``. The products are added in the order of the stations."""
    unit = F.col("treated_id").cast("string")
    vectors = weights.groupBy("treated_id", "method").agg(
        F.map_from_entries(F.collect_list(F.struct("station_id", "weight"))).alias("_w"), F.first("intercept").alias("_b"))
    mine = assignments.select("treated_id", "start").join(vectors.withColumnRenamed("treated_id", "_unit"), unit == F.col("_unit"))
    ids = pool.groupBy("start").agg(F.first("ids").alias("_ids"))
    aligned = mine.join(ids, "start").select("treated_id", "start", "method", "_b", F.array_position("_ids", unit).cast("int").alias("_at"),
                                             F.transform("_ids", lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0.0))).alias("_v"))
    total = F.aggregate(F.zip_with("x", "_v", lambda x, w: x * w), F.lit(0.0), lambda a, p: a + p)
    return pool.select("start", "date", "x").join(aligned, "start").select(
        "treated_id", "method", "date", F.element_at("x", F.col("_at")).alias("y"), (total + F.col("_b")).alias("y_hat"))
