"""Penalised synthetic controls: one job for any number of treated units.

Passes over the data: (1) the panel, (2) per unit and fold one small set of
moments (counts, sums and cross products of donors and treated series). All of
cross-validation, the choice of penalties and the refits use the moments only;
their size depends on the number of donors, not on the number of dates. The
choice itself is plain SQL over the fold scores, and the counterfactual is a join
of panel and weights.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.operators.panel import long_panel, with_folds
from panelcf.sources.tables import stored

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METHODS = ("ols", "ridge", "lasso", "elasticnet")


def log_space(low: float, high: float, size: int) -> tuple[float, ...]:
    return tuple(float(a) for a in np.logspace(low, high, size))


@dataclass(frozen=True)
class ScmSettings:
    """Intercept, penalty grids, validation and solver limits of a fit."""

    fit_intercept: bool
    ridge_alphas: tuple[float, ...]
    lasso_alphas: tuple[float, ...]
    enet_alphas: tuple[float, ...]
    l1_ratios: tuple[float, ...]
    min_pre: int = 1
    folds: int = 5
    max_steps: int = 10_000


# Grids and intercept rules of the two presets (fixed values).
MONTHLY = ScmSettings(
    fit_intercept=False,
    ridge_alphas=log_space(-3, 3, 50),
    lasso_alphas=log_space(-3, 1, 50),
    enet_alphas=log_space(-3, 1, 40),
    l1_ratios=(0.2, 0.5, 0.8),
)
DAILY = ScmSettings(
    fit_intercept=True,
    ridge_alphas=log_space(-3, 3, 40),
    lasso_alphas=log_space(-3, 1, 40),
    enet_alphas=log_space(-3, 1, 40),
    l1_ratios=(0.1, 0.5, 0.9),
    min_pre=10,
)

# The monthly preset with the wider spread of ratios used while exploring.
MONTHLY_WIDE = replace(MONTHLY, l1_ratios=(0.1, 0.5, 0.9))

_MOMENTS = "treated_id string, fold int, n long, n_pre long, donors array<string>, sums array<double>, cross array<double>"
_SCORES = "treated_id string, method string, alpha double, l1_ratio double, alpha_pos int, l1_pos int, fold int, score double"
_WEIGHTS = "treated_id string, method string, alpha double, l1_ratio double, intercept double, station_id string, weight double"


# --- moments -----------------------------------------------------------------

def _moment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial moments of the (unit, fold) groups seen by one task."""
    for batch in batches:
        rows = []
        for (unit, fold), part in batch.groupby(["treated_id", "fold"], sort=False):
            z = np.column_stack([np.stack(part["x"].to_numpy()), part["y"].to_numpy(float)])
            rows.append({
                "treated_id": unit, "fold": int(fold), "n": len(z), "n_pre": int(part["n_pre"].iloc[0]),
                "donors": part["ids"].iloc[0], "sums": z.sum(0), "cross": (z.T @ z).ravel(),
            })
        yield pd.DataFrame(rows, columns=["treated_id", "fold", "n", "n_pre", "donors", "sums", "cross"])


def _merge_moments(part: pd.DataFrame) -> pd.DataFrame:
    first = part.iloc[[0]].copy()
    first["n"] = int(part["n"].sum())
    first["sums"] = [np.sum(np.stack(part["sums"].to_numpy()), axis=0)]
    first["cross"] = [np.sum(np.stack(part["cross"].to_numpy()), axis=0)]
    return first


def fold_moments(panel: DataFrame, folds: int = 5) -> DataFrame:
    """Per unit and fold: n, donor ids, sums and cross products of (donors, treated).

    Tasks reduce their rows to moments first; only moments are merged per fold.
    """
    pre = with_folds(panel, folds).filter("is_pre").select(
        F.col("treated_id").cast("string").alias("treated_id"), "fold", "n_pre", "y",
        F.transform("donors", lambda d: d["id"].cast("string")).alias("ids"),
        F.transform("donors", lambda d: d["x"]).alias("x"),
    )
    partial = pre.mapInPandas(_moment_rows, _MOMENTS)
    return partial.groupBy("treated_id", "fold").applyInPandas(_merge_moments, _MOMENTS)


@dataclass
class _Moments:
    """Sums over some rows; subtracting two gives the moments of the remaining rows."""

    n: float
    s: np.ndarray
    c: np.ndarray

    def __sub__(self, other: "_Moments") -> "_Moments":
        return _Moments(self.n - other.n, self.s - other.s, self.c - other.c)

    def centred(self, intercept: bool) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrix of the donors and their products with y, about the means if asked."""
        c = self.c - np.outer(self.s, self.s) / self.n if intercept else self.c
        return c[:-1, :-1], c[:-1, -1]

    def offset(self, w: np.ndarray, intercept: bool) -> np.ndarray:
        return (self.s[-1] - w @ self.s[:-1]) / self.n if intercept else np.zeros(w.shape[:-1])

    def sse(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared error of each row of ``w`` with intercept ``b`` on these rows."""
        v = np.concatenate([-w, np.ones(w.shape[:-1] + (1,))], axis=-1)
        return np.einsum("...i,ij,...j->...", v, self.c, v) - 2 * b * np.einsum("...i,i->...", v, self.s) + self.n * b * b

    def r2(self, sse: np.ndarray) -> np.ndarray:
        """1 - SSE / SST; a constant y scores 1 if met exactly, else 0."""
        sst = float(self.c[-1, -1] - self.s[-1] ** 2 / self.n)
        return 1 - sse / sst if sst > 0 else (sse == 0).astype(float)


def _unpack(part: pd.DataFrame) -> tuple[list[str], list[_Moments], _Moments]:
    part = part.sort_values("fold")
    folds = [
        _Moments(n, np.asarray(s), np.asarray(c).reshape(len(s), len(s)))
        for n, s, c in zip(part["n"], part["sums"], part["cross"])
    ]
    total = _Moments(sum(f.n for f in folds), sum(f.s for f in folds), sum(f.c for f in folds))
    return list(part["donors"].iloc[0]), folds, total


# --- small solves on the moments ---------------------------------------------

def _solve_ridge(gram: np.ndarray, xy: np.ndarray, alphas) -> np.ndarray:
    """Ridge weights for every alpha from one eigen-decomposition."""
    values, vectors = np.linalg.eigh(gram)
    rotated = vectors.T @ xy
    return (rotated / (np.maximum(values, 0.0) + np.asarray(alphas)[:, None])) @ vectors.T


def _solve_ols(gram: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares; the shortest solution where donors are collinear."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    well_posed = np.linalg.cond(gram / np.outer(scale, scale)) < 1e12
    return np.linalg.solve(gram, xy) if well_posed else np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ xy


def _solve_sparse(a: np.ndarray, q: np.ndarray, l1: float, w: np.ndarray, steps: int) -> np.ndarray:
    """Minimise w'Aw/2 - w'q + l1 |w|_1 exactly, starting from ``w``.

    Active set with fixed signs: move towards the minimiser of the current signs,
    stop where a weight reaches zero and release it; once a full step is taken,
    admit the zero weight whose slope is steepest, until none exceeds ``l1``.
    A weight whose column depends on the admitted ones is exchanged for one of
    them: along that direction the loss is flat and the penalty falls, so no
    state returns. An unfinished solution is an error.
    """
    w = w.copy()
    signs = np.sign(w)
    slack = 1e-11 * (np.abs(q).max() + np.abs(a).max() * np.abs(w).max(initial=0.0))
    for _ in range(steps):
        active = np.flatnonzero(signs)
        w[signs == 0] = 0.0
        if len(active):
            block, goal = a[np.ix_(active, active)], q[active] - l1 * signs[active]
            try:
                target = np.linalg.solve(block, goal)
            except np.linalg.LinAlgError:
                target = np.linalg.lstsq(block, goal, rcond=None)[0]
            now = w[active]
            crossing = target * signs[active] < 0
            if crossing.any():
                share = now[crossing] / (now[crossing] - target[crossing])
                first = share.min()
                w[active] = now + first * (target - now)
                released = active[crossing][share <= first]
                w[released] = signs[released] = 0.0
                continue
            w[active] = target
        slope = q - a @ w
        slope[active] = 0.0
        j = int(np.argmax(np.abs(slope)))
        if abs(slope[j]) <= l1 + slack:
            return w
        signs[j] = np.sign(slope[j])
        if len(active):
            with_j = np.linalg.lstsq(a[np.ix_(active, active)], a[active, j], rcond=None)[0]
            if a[j, j] - a[active, j] @ with_j <= 1e-10 * a[j, j]:
                _exchange(w, signs, active, j, -with_j * signs[j])
    raise RuntimeError(f"no optimum within {steps} steps")


def _exchange(w: np.ndarray, signs: np.ndarray, active: np.ndarray, j: int, direction: np.ndarray) -> None:
    """Raise weight ``j`` along a direction without curvature until an active weight is used up."""
    shrinking = direction * signs[active] < 0
    if not shrinking.any():
        signs[j] = 0.0
        raise RuntimeError("the penalised loss has no minimum")
    room = np.full(len(active), np.inf)
    room[shrinking] = np.abs(w[active][shrinking] / direction[shrinking])
    first = room.min()
    w[active] += first * direction
    w[j] = first * signs[j]
    gone = active[int(np.argmin(room))]
    w[gone] = signs[gone] = 0.0


def _sparse_path(train: _Moments, alphas, ratios, cfg: ScmSettings) -> np.ndarray:
    """Weights (ratio, alpha, donor); each path runs from the largest alpha down."""
    gram, xy = train.centred(cfg.fit_intercept)
    path = np.empty((len(ratios), len(alphas), len(xy)))
    for r, ratio in enumerate(ratios):
        w = np.zeros(len(xy))
        for i in np.argsort(alphas)[::-1]:
            ridge = alphas[i] * (1 - ratio) * train.n * np.eye(len(xy))
            w = path[r, i] = _solve_sparse(gram + ridge, xy, alphas[i] * ratio * train.n, w, cfg.max_steps)
    return path


def _grid(method: str, cfg: ScmSettings) -> tuple[tuple[float, ...], tuple[float, ...]]:
    if method == "ridge":
        return cfg.ridge_alphas, (0.0,)
    return (cfg.lasso_alphas, (1.0,)) if method == "lasso" else (cfg.enet_alphas, cfg.l1_ratios)


def _total(part: pd.DataFrame) -> pd.DataFrame:
    """Moments of a unit over all folds, added in their order."""
    return _merge_moments(part.sort_values("fold"))


def _fold_scores(cfg: ScmSettings):
    """Scores of all grid points; a row is one fold of one unit and method, with the unit's total beside it."""
    def score(row) -> pd.DataFrame:
        size = len(row.sums)
        held = _Moments(row.n, np.asarray(row.sums), np.asarray(row.cross).reshape(size, size))
        train = _Moments(row.total_n, np.asarray(row.total_sums), np.asarray(row.total_cross).reshape(size, size)) - held
        alphas, ratios = _grid(row.method, cfg)
        ridge = row.method == "ridge"
        path = _solve_ridge(*train.centred(cfg.fit_intercept), alphas)[None] if ridge else _sparse_path(train, alphas, ratios, cfg)
        sse = held.sse(path, train.offset(path, cfg.fit_intercept))
        r, a = np.meshgrid(np.arange(len(ratios)), np.arange(len(alphas)), indexing="ij")
        return pd.DataFrame({
            "treated_id": row.treated_id, "method": row.method, "alpha": np.asarray(alphas)[a.ravel()],
            "l1_ratio": np.asarray(ratios)[r.ravel()], "alpha_pos": a.ravel().astype("int32"),
            "l1_pos": r.ravel().astype("int32"), "fold": np.int32(row.fold), "score": (held.r2(sse) if ridge else sse / held.n).ravel(),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield score(row)

    return run


def _refit(cfg: ScmSettings):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        unit, method = key
        donors, _, total = _unpack(part)
        alpha, ratio = part["alpha"].iloc[0], part["l1_ratio"].iloc[0]
        gram, xy = total.centred(cfg.fit_intercept)
        if method == "ols":
            w = _solve_ols(gram, xy)
        elif method == "ridge":
            w = _solve_ridge(gram, xy, [alpha])[0]
        else:
            ridge = alpha * (1 - ratio) * total.n * np.eye(len(xy))
            w = _solve_sparse(gram + ridge, xy, alpha * ratio * total.n, np.zeros(len(xy)), cfg.max_steps)
        return pd.DataFrame({
            "treated_id": unit, "method": method, "alpha": alpha, "l1_ratio": ratio,
            "intercept": float(total.offset(w, cfg.fit_intercept)), "station_id": donors, "weight": w,
        })

    return run


# --- Spark side --------------------------------------------------------------

def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the small solves to all cores.

    Moments are few bytes but much work, so the partition count is fixed here:
    sizing partitions by bytes would put all units into one task.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def cv_scores(moments: DataFrame, methods, cfg: ScmSettings) -> DataFrame:
    """Held-out score of every grid point and fold: R² for ridge, MSE for lasso and elastic net.

    Every fold of every unit and method is a row of its own, so one unit keeps
    folds x methods tasks busy.
    """
    tuned = [m for m in methods if m != "ols"]
    short = F.raise_error(F.lit("fewer dates before the start than folds")).cast("long")
    total = moments.groupBy("treated_id").applyInPandas(_total, _MOMENTS).select(
        "treated_id", F.col("n").alias("total_n"), F.col("sums").alias("total_sums"), F.col("cross").alias("total_cross"))
    each = moments.join(total, "treated_id").withColumns({
        "method": F.explode(F.array(*[F.lit(m) for m in tuned])),
        "n_pre": F.when(F.col("n_pre") < cfg.folds, short).otherwise(F.col("n_pre")),
    })
    return _spread(each.drop("donors"), "treated_id", "method", "fold").mapInPandas(_fold_scores(cfg), _SCORES)


def choose(scores: DataFrame) -> DataFrame:
    """Best grid point per unit and method.

    Ridge: highest mean R², then the first alpha of the grid. Lasso and elastic
    net: lowest mean MSE, then the first ratio of the grid, then the largest alpha.
    Folds are added in their order, so that equal scores (all weights zero, say)
    stay exactly equal and the tie rules decide.
    """
    in_order = F.sort_array(F.collect_list(F.struct("fold", "score")))
    mean = scores.groupBy("treated_id", "method", "alpha", "l1_ratio", "alpha_pos", "l1_pos").agg(
        in_order.alias("folds")
    ).withColumn("score", F.aggregate("folds", F.lit(0.0), lambda a, f: a + f["score"]) / F.size("folds"))
    ridge = F.col("method") == "ridge"
    rank = F.struct(
        F.when(ridge, -F.col("score")).otherwise(F.col("score")).alias("loss"),
        F.when(ridge, F.col("alpha_pos")).otherwise(F.col("l1_pos")).alias("first"),
        (-F.col("alpha")).alias("largest"),
    )
    return mean.groupBy("treated_id", "method").agg(
        F.min_by("alpha", rank).alias("alpha"), F.min_by("l1_ratio", rank).alias("l1_ratio"),
        F.min_by("score", rank).alias("cv_score"),
    )


def fit_scm(panel: DataFrame, methods=METHODS, cfg: ScmSettings = MONTHLY, store: str | None = None) -> DataFrame:
    """Weights per unit, method and donor (with intercept and chosen penalties).

    Weights are unconstrained: they may be negative and need not sum to one.
    ``store`` names a shared folder for the moments, which are needed twice.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}; choose from {METHODS}")
    moments = stored(fold_moments(panel, cfg.folds), store and f"{store}/moments")
    parts = []
    if "ols" in methods:
        parts.append(moments.withColumns({
            "method": F.lit("ols"), "alpha": F.lit(0.0), "l1_ratio": F.lit(0.0),
        }))
    if set(methods) - {"ols"}:
        best = choose(cv_scores(moments, methods, cfg)).drop("cv_score")
        parts.append(moments.join(best, "treated_id").select(*moments.columns, "method", "alpha", "l1_ratio"))
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _spread(chosen, "treated_id", "method").groupBy("treated_id", "method").applyInPandas(_refit(cfg), _WEIGHTS)


def predict_scm(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """``treated_id, method, date, y, y_hat`` on all dates, before and after the start.

    A donor without a weight contributes nothing; ``intercept`` is optional. The
    weights of a unit and method become one array in the order of the donor ids,
    which meets every date of the unit; values are added in that order.
    """
    if "intercept" not in weights.columns:
        weights = weights.withColumn("intercept", F.lit(0.0))
    vectors = weights.groupBy("treated_id", "method").agg(
        F.sort_array(F.collect_list(F.struct("station_id", "weight"))).alias("_w"), F.first("intercept").alias("_b"))
    products = F.zip_with("donors", "_w", lambda d, w: d["x"] * w["weight"])
    by_id = F.map_from_entries("_w")
    looked_up = F.transform("donors", lambda d: d["x"] * F.coalesce(F.try_element_at(by_id, d["id"]), F.lit(0.0)))
    aligned = F.transform("donors", lambda d: d["id"]) == F.transform("_w", lambda w: w["station_id"])
    total = F.aggregate(F.when(aligned, products).otherwise(looked_up), F.lit(0.0), lambda a, p: a + p)
    return panel.select("treated_id", "date", "y", "donors").join(vectors, "treated_id").select(
        "treated_id", "method", "date", "y", (total + F.col("_b")).alias("y_hat"))


def fit_ols_sql(panel: DataFrame, fit_intercept: bool = True) -> DataFrame:
    """Least squares against a single donor, entirely as an aggregate."""
    rows = long_panel(panel).filter("is_pre")
    if fit_intercept:
        slope = F.coalesce(F.try_divide(F.covar_pop("y", "x"), F.var_pop("x")), F.lit(0.0))
        base = F.avg("y") - slope * F.avg("x")
    else:
        slope = F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))), F.lit(0.0))
        base = F.lit(0.0)
    return rows.groupBy("treated_id").agg(
        F.max("station_id").alias("station_id"), slope.alias("weight"), base.alias("intercept")
    ).withColumn("method", F.lit("ols"))
