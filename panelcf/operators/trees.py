"""Tree counterfactuals: the presets as one job over all units, and any estimator of Spark's own, one fit per unit.

Forests and boosting (``Forest``, ``Boosting``) are grown by ``histtrees``: every unit, method, block of trees and split is a row
of one job. Other estimators are fitted one treated unit at a time; several units or folds run side by
side from a small pool of driver threads, each fit being a Spark job.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcf.functions.columns import id_list
from panelcf.operators.histtrees import Boosting, Forest, Grown, Spec, fit_units, packed, predict_by_table, validate_units
from panelcf.operators.panel import CALENDAR_FEATURES, SEASON_FEATURES
from panelcf.sources.tables import stored

Model = Spec | Estimator


def daily_models(n_trees: int = 500, n_rounds: int = 500, max_depth: int | None = None) -> dict[str, Spec]:
    """Forest with at least 10 days per leaf, and boosting with 31 leaves at rate 0.05 on 80 % of the features per tree."""
    return {
        "rf": Forest(n_trees, max_depth, min_leaf=10),
        "gbt": Boosting(n_rounds, 0.05, max_leaves=31, min_leaf=20, features=0.8),
    }


def monthly_models(n_trees: int = 300, n_rounds: int = 300) -> dict[str, Spec]:
    """Shallow presets for short monthly panels."""
    return {
        "rf": Forest(n_trees, max_depth=4),
        "gb": Boosting(n_rounds, 0.05, max_leaves=None, max_depth=2, min_leaf=1),
    }


def named_features(design: DataFrame) -> tuple[DataFrame, list[str]]:
    """(treated_id, date, y, is_pre, split, ids, x): donor values, then the design's season or calendar columns; and the names of these."""
    extra = [c for c in dict.fromkeys((*CALENDAR_FEATURES, *SEASON_FEATURES)) if c in design.columns]
    x = F.concat(F.transform("donors", lambda d: d["x"]), F.array(*[F.col(c).cast("double") for c in extra]).cast("array<double>"))
    split = F.col("split") if "split" in design.columns else F.lit(None).cast("int")
    return design.select("treated_id", "date", "y", "is_pre", split.alias("split"), F.transform("donors", lambda d: d["id"]).alias("ids"), x.alias("x")), extra


def all_specs(models: dict[str, Model]) -> bool:
    kinds = {isinstance(m, (Forest, Boosting)) for m in models.values()}
    if len(kinds) != 1:
        raise ValueError("models are either all Forest and Boosting, or all estimators")
    return kinds.pop()


def grow_all(design: DataFrame, models: dict[str, Spec] | None = None, min_pre: int = 50, seed: int = 0,
             store: str | None = None, keep_trees: bool = True) -> Grown:
    """Predictions on all dates, and the trees as a table, for every treated unit of the design, trained on the dates before the start.

    ``store`` names a shared folder: the units' days and the fits are then written there once and read back. Too few dates
    before a start are an error when the job runs.
    """
    rows, extra = named_features(design)
    units = stored(packed(rows, extra, min_pre), store and f"{store}/units")
    return fit_units(units, models or daily_models(), seed, store, keep_trees)


def predict_trees(design: DataFrame, trees: DataFrame) -> DataFrame:
    """(treated_id, method, date, y, y_hat) for the dates of a design from a table of trees."""
    rows, extra = named_features(design)
    wide = rows.withColumn("ids", F.concat("ids", F.array(*[F.lit(n) for n in extra]).cast("array<string>")))
    return predict_by_table(wide, trees).join(rows.select("treated_id", "date", "y"), ["treated_id", "date"]).select("treated_id", "method", "date", "y", "y_hat")


def feature_rows(design: DataFrame) -> DataFrame:
    """Donor values and the design's season or calendar columns as one vector."""
    extra = [c for c in dict.fromkeys((*CALENDAR_FEATURES, *SEASON_FEATURES)) if c in design.columns]
    values = F.concat(
        F.transform("donors", lambda d: d["x"]), F.array(*[F.col(c).cast("double") for c in extra])
    ) if extra else F.transform("donors", lambda d: d["x"])
    kept = [c for c in ("treated_id", "date", "y", "is_pre", "split") if c in design.columns]
    return design.select(*kept, array_to_vector(values).alias("features"))


def _prepared(est: Estimator, seed: int) -> Estimator:
    """A copy with the seed (where the estimator has one) and the design's column names."""
    extra = {est.getParam("featuresCol"): "features", est.getParam("labelCol"): "y",
             est.getParam("predictionCol"): "y_hat"}
    if est.hasParam("seed"):
        extra[est.getParam("seed")] = seed
    return est.copy(extra)


def _run(spark: SparkSession, tasks, parallelism: int) -> list:
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


def fit_trees(design: DataFrame, treated_ids, models: dict[str, Model] | None = None,
              min_pre: int = 50, seed: int = 0, parallelism: int = 4, partitions: int = 2,
              store: str | None = None) -> tuple[DataFrame, dict[tuple[str, str], object]]:
    """``(treated_id, method, date, y, y_hat)`` on all dates of a few units, and the fitted models.

    Trained on the dates before the start only. ``models`` maps a name to a forest or boosting (grown as in
    ``grow_all``, which takes all units; the model is its table of trees), or to any
    regression estimator; each is copied and seeded before it is fitted. With
    ``store`` the feature rows and each fit's predictions are files below it, read
    back as one table, so the plan does not grow with the units; without it the
    feature rows are cached and the predictions are a union for a few units.
    """
    models = models or daily_models()
    ids = id_list(treated_ids)
    chosen = design.filter(F.col("treated_id").isin(ids))
    grown = all_specs(models)
    rows = chosen if grown else stored(feature_rows(chosen), f"{store}/features") if store else feature_rows(chosen).persist()
    counts = {r.treated_id: r.n for r in rows.filter("is_pre").groupBy("treated_id").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    for unit in ids:
        if counts.get(unit, 0) < min_pre:
            raise ValueError(f"treated unit {unit!r}: {counts.get(unit, 0)} complete dates before the start, "
                             f"at least {min_pre} are needed")
    if grown:
        done = grow_all(chosen, models, min_pre, seed, store)
        return done.predictions, {(u, n): done.trees.filter((F.col("treated_id") == u) & (F.col("method") == n)) for u in ids for n in models}

    def predicted(unit: str, name: str, model) -> DataFrame:
        return model.transform(rows.filter(F.col("treated_id") == unit)).select(
            "treated_id", F.lit(name).alias("method"), "date", "y", "y_hat")

    def task(number: int, unit: str, name: str, est: Estimator):
        def run():
            train = rows.filter((F.col("treated_id") == unit) & F.col("is_pre")).coalesce(partitions)
            model = _prepared(est, seed).fit(train)
            if store:
                predicted(unit, name, model).write.mode("overwrite").parquet(f"{store}/fit/{number}")
            return (unit, name), model
        return run

    pairs = [(u, n, e) for u in ids for n, e in models.items()]
    fitted = dict(_run(design.sparkSession, [task(k, *p) for k, p in enumerate(pairs)], parallelism))
    if store:
        return design.sparkSession.read.option("recursiveFileLookup", True).parquet(f"{store}/fit"), fitted
    return reduce(DataFrame.unionByName, [predicted(u, n, m) for (u, n), m in fitted.items()]), fitted


def time_series_cv(design: DataFrame, treated_ids, models: dict[str, Model], seed: int = 0,
                   parallelism: int = 4, partitions: int = 2, store: str | None = None, n_splits: int = 5) -> DataFrame:
    """``treated_id, method, split, rmse, mean_rmse`` of an expanding-window validation.

    ``design`` must carry the ``split`` column of ``expanding_splits`` with ``n_splits``; ``mean_rmse`` is
    the mean over the splits of a unit and method. ``store`` as in ``fit_trees``. Forests and boosting are one job,
    and take all units of the design if no ids are given; estimators need ids.
    """
    mean = F.avg("rmse").over(Window.partitionBy("treated_id", "method"))
    if all_specs(models):
        chosen = design if treated_ids is None else design.filter(F.col("treated_id").isin(id_list(treated_ids)))
        rows, extra = named_features(chosen)
        units = stored(packed(rows, extra), store and f"{store}/units")
        return validate_units(units, models, n_splits, seed, store).withColumn("mean_rmse", mean)
    ids = id_list(treated_ids)
    rows = feature_rows(design).filter(F.col("treated_id").isin(ids) & F.col("is_pre"))
    rows = stored(rows, f"{store}/features") if store else rows.persist()
    pairs = [(r.treated_id, r.split) for r in rows.filter(F.col("split").isNotNull()).select("treated_id", "split").distinct()
             .orderBy("treated_id", "split").collect()]

    def task(number: int, unit: str, split: int, name: str, est: Estimator):
        def run():
            mine = rows.filter(F.col("treated_id") == unit)
            train = mine.filter(F.coalesce("split", F.lit(-1)) < split).coalesce(partitions)
            model = _prepared(est, seed).fit(train)
            errors = model.transform(mine.filter(F.col("split") == split)).groupBy("treated_id", "split").agg(
                F.sqrt(F.avg(F.pow(F.col("y") - F.col("y_hat"), 2))).alias("rmse")
            ).select("treated_id", F.lit(name).alias("method"), "split", "rmse")
            if store:
                errors.write.mode("overwrite").parquet(f"{store}/errors/{number}")
            return errors
        return run

    tasks = [task(k, *p, n, e) for k, (p, (n, e)) in enumerate((p, m) for p in pairs for m in models.items())]
    each = _run(design.sparkSession, tasks, parallelism)  # a row per unit, model and split
    if store:
        each = design.sparkSession.read.option("recursiveFileLookup", True).parquet(f"{store}/errors")
    else:
        each = reduce(DataFrame.unionByName, each)
    return each.withColumn("mean_rmse", mean)
