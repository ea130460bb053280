"""Exact quantiles of groups of any size.

``percentile`` keeps all distinct values of a group in one task. Here a group is
cut into value ranges by approximate splitters (a mergeable sketch), the ranges
are counted, and only the ranges that hold a wanted rank are kept. The splitters
decide how evenly work is spread, never which value is returned. Each round
divides the longest stretch that is finally ordered by about ``ranges``; there are
as many rounds as the largest group needs for a stretch of ``longest`` values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    ranges: int = 64, rounds: int | None = None, longest: int = 100_000) -> DataFrame:
    """``keys…, quantiles`` with one linear-interpolated value per probability; nulls ignored.

    ``rounds`` is found from the number of distinct values of the largest group if not given.
    """
    rows = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    targets = rows.groupBy(*keys).agg(F.sum("_k").alias("_n")).select(*keys, _ranks(probs).alias("_targets"))
    if rounds is None:
        most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
        rounds = max(1, math.ceil(math.log(max(1.0, most / longest)) / math.log(ranges)))
    path = list(keys)
    for level in range(rounds):
        rows, targets = _narrow(rows, targets, path, value, ranges, f"_range{level}")
        path.append(f"_range{level}")
    inside = Window.partitionBy(*path).orderBy(value)
    hits = (
        rows.join(targets, path)
        .withColumn("_end", F.sum("_k").over(inside))
        .withColumn("t", F.explode("_targets"))
        .filter((F.col("t.r") < F.col("_end")) & (F.col("t.r") >= F.col("_end") - F.col("_k")))
    )
    each = [
        F.sum(F.when(F.col("t.i") == i, F.col(value) * F.col("t.s"))) for i in range(len(probs))
    ]
    return hits.groupBy(*keys).agg(F.array(*each).alias("quantiles"))


def _ranks(probs: list[float]):
    """The two neighbouring ranks of each quantile, with their shares."""
    both = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("_n") - 1)
        up = at - F.floor(at)
        both.append(F.struct(F.lit(i).alias("i"), F.floor(at).alias("r"), (1 - up).alias("s")))
        both.append(F.struct(F.lit(i).alias("i"), F.ceil(at).alias("r"), up.alias("s")))
    return F.array(*both)


def _narrow(rows: DataFrame, targets: DataFrame, path: list[str], value: str, ranges: int, name: str):
    """Split every group into value ranges; keep the ranges that hold a wanted rank."""
    cuts = [i / ranges for i in range(1, ranges)]
    splitters = rows.groupBy(*path).agg(F.percentile_approx(value, cuts, 50 * ranges).alias("_cuts"))
    ranged = rows.join(splitters, path).select(
        *path, value, "_k", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias(name)
    )
    counts = ranged.groupBy(*path, name).agg(F.sum("_k").alias("_rows"))
    before = Window.partitionBy(*path).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    skip = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    within = F.filter("_targets", lambda t: (t["r"] >= F.col("_skip")) & (t["r"] < F.col("_skip") + F.col("_rows")))
    kept = (
        counts.withColumn("_skip", skip).join(targets, path)
        .select(*path, name, "_skip", within.alias("_targets")).filter(F.size("_targets") > 0)
        .select(*path, name, F.transform(
            "_targets", lambda t: F.struct(t["i"].alias("i"), (t["r"] - F.col("_skip")).alias("r"), t["s"].alias("s"))
        ).alias("_targets"))
    )
    return ranged.join(kept.select(*path, name), [*path, name], "left_semi"), kept
