"""Shards of near equal bytes by a k-d tree over document metadata, in DataFrame functions only.

Each document is a point: the logarithm of its size, its number, and the places of its source and language on a line (by hash, so equal ones
stay together). A node of the tree is cut along the dimension in which its points lie widest, at the median weighted by
bytes, until there are as many leaves as shards. Medians come from histograms of the cut key: each pass counts bytes by
the next ten bits of the key and keeps the bin that holds the middle, for all nodes of a level at once. So a pass sends a thousand sums a node to the driver,
never a row. The key ends in a hash of the document, so a source with a third of all rows is cut like any other.

Defined results: null or empty texts have size 1; nulls in metadata are one place of their own; equal rows are tied and
stay in one leaf; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcf.llm.common import stored

SHARDS = 16
KEY_BITS, PLACE_BITS, PASS_BITS = 50, 20, 10
#: A median is precise enough once its bin weighs less than this share of a shard.
PRECISION = 0.0005
#: Rows numbered by one task.
RUN_ROWS = 50_000

_DIMENSIONS = ("size", "source", "number", "lang")


def _unit(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - PLACE_BITS).cast("double") / (1 << PLACE_BITS)


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, tie, and a place in [0, 1) per dimension), stored."""
    text, number = F.coalesce("text", F.lit("")), F.col("doc_id").cast("double")
    have = {c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("tie"), F.log2(size.cast("double")).alias("p_size"), number.alias("p_number"),
        _unit(F.xxhash64(F.coalesce(have["source"], F.lit("")))).alias("p_source"), _unit(F.xxhash64(F.coalesce(have["lang"], F.lit("")))).alias("p_lang"))
    return stored(rows, "points")


def _scaled(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Places as whole numbers below 2**PLACE_BITS."""
    out = {}
    for d in _DIMENSIONS:
        low, high = ranges[d]
        share = (F.coalesce(F.col(f"p_{d}"), F.lit(low)) - F.lit(low)) / F.lit(max(high - low, 1e-9))
        out[f"p_{d}"] = F.least(F.floor(share * (1 << PLACE_BITS)), F.lit((1 << PLACE_BITS) - 1)).cast("long")
    return rows.withColumns(out)


def _key(dimension: Column) -> Column:
    place = F.lit(0).cast("long")
    for k, d in enumerate(_DIMENSIONS):
        place = F.when(dimension == k, F.col(f"p_{d}")).otherwise(place)
    low = KEY_BITS - PLACE_BITS
    return F.shiftleft(place, low).bitwiseOR(F.shiftrightunsigned("tie", 64 - low))


def _of_node(values: dict[int, int]) -> Column:
    out = F.lit(None).cast("long")
    for node, v in values.items():
        out = F.when(F.col("node") == node, F.lit(v).cast("long")).otherwise(out)
    return out


def _medians(rows: DataFrame, shares: dict[int, float], weights: dict[int, int], precision: float) -> dict[int, int]:
    """Per node the key up to which the left side's share of bytes lies. rows: node, key, size."""
    low, below, open_ = dict.fromkeys(shares, 0), dict.fromkeys(shares, 0), set(shares)
    for left in range(KEY_BITS - PASS_BITS, -1, -PASS_BITS):
        if not open_:
            break
        inside = rows.where(F.col("node").isin(*open_)).where(F.shiftright("key", left + PASS_BITS) == F.shiftright(_of_node(low), left + PASS_BITS))
        bins = inside.groupBy("node", F.shiftright("key", left).alias("bin")).agg(F.sum("size").alias("w")).collect()  # 2**PASS_BITS bins a node
        per: dict[int, list] = {}
        for node, b, w in bins:
            per.setdefault(node, []).append((b, w))
        for node in list(open_):
            goal, sum_ = shares[node] * weights[node], below[node]
            for b, w in sorted(per.get(node, [])):
                if sum_ + w >= goal or b == max(per[node])[0]:
                    low[node], below[node] = b << left, sum_
                    if w <= precision or not left:
                        # the whole bin, or at last the whole key, goes to the nearer side
                        low[node] = (b << left) + ((1 << left) - 1 if sum_ + w - goal <= goal - sum_ else -1)
                        open_.discard(node)
                    break
                sum_ += w
    return low


def tree(rows: DataFrame, shards: int = SHARDS) -> tuple[Column, DataFrame]:
    """The leaf number of a point as a column of the scaled points, and these."""
    stats = rows.agg(F.sum("size"), *[f(f"p_{d}") for d in _DIMENSIONS for f in (F.min, F.max)]).first()
    total, ends = stats[0] or 0, list(stats[1:])
    ranges = {d: (float(ends[2 * k] or 0), float(ends[2 * k + 1] or 0)) for k, d in enumerate(_DIMENSIONS)}
    scaled = _scaled(rows, ranges)
    leaf, spans = F.lit(0).cast("int"), {0: (0, shards)}
    for _ in range(math.ceil(math.log2(max(2, shards)))):
        here = scaled.withColumn("node", leaf)
        wide = {n: (lo, hi) for n, (lo, hi) in spans.items() if hi - lo > 1}
        if not wide or not total:
            break
        boxes = here.groupBy("node").agg(F.sum("size"), *[(F.max(f"p_{d}") - F.min(f"p_{d}")) for d in _DIMENSIONS]).collect()  # a row per node
        weights = {r[0]: r[1] for r in boxes}
        widest = {r[0]: max(range(len(_DIMENSIONS)), key=lambda k, r=r: (r[2 + k] or 0, -k)) for r in boxes}
        wide = {n: s for n, s in wide.items() if n in weights}
        shares = {n: ((lo + hi) // 2 - lo) / (hi - lo) for n, (lo, hi) in wide.items()}
        keyed = here.select("node", "size", _key(_of_node(widest)).alias("key"))
        cuts = _medians(keyed, shares, weights, PRECISION * total / shards)
        right = {n: (lo + hi) // 2 for n, (lo, hi) in wide.items()}
        # leaves are numbered by the first shard of their span, so a node keeps its number on the left
        new = leaf
        for n in wide:
            new = F.when((leaf == n) & (_key(F.lit(widest[n])) > F.lit(cuts[n])), F.lit(right[n])).otherwise(new)
        scaled = stored(scaled.withColumn("leaf", new.cast("int")), "points")
        leaf = F.col("leaf")
        spans = {n: s for n, s in spans.items() if n not in wide} | {n: (lo, (lo + hi) // 2) for n, (lo, hi) in wide.items()} | {
            right[n]: (right[n], hi) for n, (lo, hi) in wide.items()}
    return leaf, scaled


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots count from 0 without gaps in every shard."""
    rows = points(docs)
    leaf, scaled = tree(rows, shards)
    placed = scaled.select("doc_id", "size", "text_crc32", "tie", leaf.alias("shard"))
    runs = max(1, math.ceil(rows.count() / RUN_ROWS))
    numbered = stored(placed.withColumn("run", F.pmod("tie", F.lit(runs)).cast("int")), "placed")
    # numbers within a run, which has a bounded share of a shard's rows, after all rows of the runs before it
    sizes = numbered.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("tie", "doc_id"))
    return numbered.withColumn("within", within).join(offsets, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"))
