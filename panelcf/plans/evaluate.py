"""The whole evaluation, for one treated unit or thousands in the same job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.functions.columns import HOUSE, PanelCols, id_list
from panelcf.operators.effects import att_summary, capitalised, r2, rmse, weights_table, with_periods
from panelcf.operators.panel import counterfactual_panel, require_fittable
from panelcf.operators.pool import fit_pool, pool_panel, predict_pool, require_fittable_pool
from panelcf.operators.synth import DAILY, METHODS, MONTHLY, ScmSettings, fit_scm, predict_scm
from panelcf.operators.trees import Model, all_specs, daily_models, fit_trees, grow_all
from panelcf.sources.tables import stored


@dataclass(frozen=True)
class Evaluation:
    panel: DataFrame
    weights: DataFrame
    fit: DataFrame
    effects: DataFrame
    weight_table: DataFrame


def evaluate(m: DataFrame, assignments: DataFrame, donor_sets: DataFrame | None = None,
             grain: str = "month", methods=METHODS, cfg: ScmSettings | None = None,
             cols: PanelCols = HOUSE, check: bool = True, store: str | None = None) -> Evaluation:
    """Panel, weights, counterfactual and effects of every assignment.

    ``treated_id`` is part of every key, so adding units adds rows, not jobs. Without donor sets the units of a start
    share one matrix of moments (see ``operators.pool``), and the panel is only made if it is used.
    ``check`` looks for units that cannot be fitted first. ``store`` names a
    shared folder where panel, moments and weights are written and read back, so
    that they are computed once and survive lost executors.
    """
    cfg = cfg or (MONTHLY if grain == "month" else DAILY)
    below = (lambda name: f"{store}/{name}") if store else (lambda name: None)
    panel = counterfactual_panel(m, assignments, donor_sets, grain, cols)
    if donor_sets is None:  # every unit is a donor of the others: they share their dates and moments
        pool = stored(pool_panel(m, assignments, grain, cols), below("pool"))
        if check:
            require_fittable_pool(pool, assignments, cfg.min_pre)
        weights = stored(fit_pool(pool, assignments, methods, cfg, store), below("weights"))
        fit = predict_pool(pool, weights, assignments)
    else:
        panel = stored(panel, below("panel"))
        if check:
            require_fittable(panel, assignments, cfg.min_pre)
        weights = stored(fit_scm(panel, methods, cfg, store), below("weights"))
        fit = predict_scm(panel, weights)
    named = m.withColumnRenamed(cols.id, "station_id")
    return Evaluation(
        panel, weights, fit,
        att_summary(with_periods(fit, assignments)),
        weights_table(weights, named),
    )


def evaluate_trees(design: DataFrame, assignments: DataFrame, treated_ids=None, models: dict[str, Model] | None = None,
                   min_pre: int = 50, seed: int = 0, store: str | None = None) -> DataFrame:
    """Effects and errors of tree counterfactuals, one row per unit and method.

    ``treated_id, method, att_pre, att_post, att_post_ex, r2_pre, rmse_pre, rmse_post``: the same
    table as for the penalised fits, joined with the quality of the fit. Forests and boosting
    take all units of the design if no ids are given; estimators of the user's own need ids.
    """
    models = models or daily_models()
    if all_specs(models):
        chosen = design if treated_ids is None else design.filter(F.col("treated_id").isin(id_list(treated_ids)))
        fit = grow_all(chosen, models, min_pre, seed, store, keep_trees=False).predictions
    else:
        fit, _ = fit_trees(design, treated_ids, models, min_pre, seed, store=store)
    dated = with_periods(stored(fit, store and f"{store}/fit"), assignments)
    quality = r2(dated, F.col("start")).join(rmse(dated, F.col("start")), ["treated_id", "method"])
    named = quality.withColumn("method", capitalised("method"))
    return att_summary(dated).join(named, ["treated_id", "method"], "left")
