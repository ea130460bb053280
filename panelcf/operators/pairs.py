"""Sums over the days that two series share, for many pairs of series, without a row per pair and day.

Series are dealt into blocks of stations, days into chunks. A row is a chunk with the values of one block of each side; its task puts them
into matrices X (zero where unknown) and M (one where known), and six products of these give the sums of all pairs under the mask of days
that both know: n = M'M, sum of x = X'M, of y = M'X, of squares (X*X)'M and M'(X*X), of products X'X. They are added over the chunks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stations of a block and days of a chunk: a row holds this many values a side at most.
BLOCK, CHUNK = 512, 512
#: Share of the sum of squares below which a variance is rounding, the series constant on the shared days.
ROUNDING = 1e-13

_SUMS = "left_id string, right_id string, n long, sx double, sy double, sxx double, syy double, sxy double"


def _matrices(ids, days, values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, column = np.unique(np.asarray(ids, str), return_inverse=True)
    x, known = np.zeros((CHUNK, len(names))), np.zeros((CHUNK, len(names)))
    x[days, column], known[days, column] = values, 1.0
    return names, x, known


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            left, x, mx = _matrices(r.left_ids, r.left_days, r.left_values)
            right, y, my = _matrices(r.right_ids, r.right_days, r.right_values)
            n = mx.T @ my
            a, b = np.nonzero((n > 0) & (left[:, None] != right))
            sums = (x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y)
            yield pd.DataFrame({"left_id": left[a], "right_id": right[b], "n": n[a, b].astype(np.int64),
                                **{c: s[a, b] for c, s in zip(("sx", "sy", "sxx", "syy", "sxy"), sums)}})


def pair_sums(cells: DataFrame, is_left: Column) -> DataFrame:
    """``left_id, right_id, n, sx, sy, sxx, syy, sxy`` of every left series with every other one, from one row
    ``id, date, value`` per series and day. Values count from each series' least one, so that sums of squares keep their digits."""
    known = cells.filter(F.col("value").isNotNull()).select(F.col("id").cast("string").alias("id"), "date", "value")
    least = known.groupBy("id").agg(F.min("value").alias("least"))
    blocks = known.select(F.greatest(F.lit(1), F.ceil(F.count_distinct("id") / BLOCK))).scalar()
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    placed = known.join(least, "id").select(
        "id", (F.col("value") - F.col("least")).alias("v"), F.floor(day / CHUNK).alias("chunk"), F.pmod(day, F.lit(CHUNK)).cast("int").alias("d"),
    ).withColumns({"n_blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks)})

    def gathered(rows: DataFrame, side: str) -> DataFrame:
        held = rows.groupBy("chunk", "block", "n_blocks").agg(F.collect_list(F.struct("id", "d", "v")).alias("c"))
        return held.select("chunk", "block", "n_blocks", *[
            part.alias(f"{side}_{name}") for name, part in (
                ("ids", F.transform("c", lambda x: x["id"])), ("days", F.transform("c", lambda x: x["d"])), ("values", F.transform("c", lambda x: x["v"])))])

    # the left blocks meet every right block of their chunk; chunk and right block deal out the work
    left = gathered(placed.filter(is_left), "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).drop("n_blocks")
    pairs = left.join(gathered(placed, "right").drop("n_blocks"), ["chunk", "block"])
    partial = pairs.drop("chunk", "block").mapInPandas(_products, _SUMS)
    return partial.groupBy("left_id", "right_id").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlation() -> Column:
    """Pearson's r from the columns of ``pair_sums``; null where a series is constant on the shared days."""
    n = F.col("n")

    def spread(s: str, ss: str) -> Column:
        centred = F.col(ss) - F.col(s) * F.col(s) / n
        return F.when(centred > ROUNDING * F.col(ss), centred)

    return (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
