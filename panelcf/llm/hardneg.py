"""Hard negatives of anchors by a GNAT-style tree: many split points a node, and ranges of distances to sibling subtrees.

A node deals its rows to the nearest of its split points. For each split point i and each child j it holds the least and
the greatest distance from i to the rows of j, and the range of the rows' norms. The rows whose score (inner product)
with an anchor lies in a window [low, high] lie in an annulus around the anchor, between the radii that follow from
|q - x|^2 = |q|^2 + |x|^2 - 2 score. A sibling goes if, for some split point, the annulus and the range cannot meet; what is
left are leaves, whose rows are compared exactly. A top-k search starts with a probe of a few leaves, whose
k-th best score raises the window's lower end for the rest, so the result is exact.

Distribution: split points come from a sample of at most SAMPLE_ROWS rows (those with the smallest hashes); every row is
indexed, and the ranges are taken over all rows, as partial minima and maxima by task. Leaves are gathered in units of
bounded size, a leaf that is too large for one (many equal vectors) is dealt over several. A visit carries an
anchor to a unit; units with many visits are copied, so that a group is bounded on both sides, and groups are streamed one
by one through sorted partitions. The tree on the driver and in tasks is bounded by the sample, not by the table.

Where vectors have no structure the annuli meet nearly every leaf, and the search is a blocked comparison of the
anchors with all rows.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; a vector that is
shorter than the longest one has zeros at its end; repeated rows are rows of their own; an empty table gives no rows. Products of
norms must be below 2^63, else an error is raised, as scores would not be long integers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcf.llm.common import stored

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that choose the split points, split points a node, and rows aimed at in a leaf.
SAMPLE_ROWS, FANOUT, LEAF_ROWS = 8192, 12, 1024
#: Bytes of vectors in a unit, visits in a group, leaves probed for each window.
UNIT_BYTES, GROUP_VISITS, PROBES = 32 << 20, 4096, 2

POSITIVES, NEGATIVES = 5, 10
#: Ends of a window that takes every score.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scores of negatives, in hundredths of the positive's score.
WINDOW = (30, 90)

_INDEXED = "row long, id long, label long, leaf int, vec array<double>"
_VISIT = "unit long, qid long, label long, vec array<double>, low array<long>, high array<long>, leaves array<int>"
_FOUND = "qid long, w int, id long, score long"


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix, zeros behind the ends of shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _lists(matrix: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)[: len(matrix) + 1] if matrix.shape[1]
                                    else np.zeros(len(matrix) + 1, np.int32), pa.array(matrix.reshape(-1), kind))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Tree:
    """Per node its split points and their children (a node, or -1 - leaf); after ``measured``, the ranges as well."""

    points: list[np.ndarray]
    children: list[list[int]]
    leaf_points: np.ndarray
    low: list[np.ndarray] | None = None  # [node][i, j]: least distance of split point i from the rows of child j
    high: list[np.ndarray] | None = None
    norms: list[np.ndarray] | None = None  # [node][0 or 1, j]: least and greatest squared norm in child j

    def descend(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows that reach it, their distances to its split points, their children) from the root on."""
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            d = _distances(x[rows], self.points[node])
            child = d.argmin(1)
            yield node, rows, d, child
            for j, below in enumerate(self.children[node]):
                if below >= 0 and len(mine := rows[child == j]):
                    stack.append((below, mine))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for node, rows, _, child in self.descend(x):
            below = np.array(self.children[node])[child]
            out[rows[below < 0]] = -1 - below[below < 0]
        return out

    def needed(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[anchor, leaf]: whether rows with a score in one of the anchor's windows may lie there."""
        out = np.zeros((len(q), len(self.leaf_points)), bool)
        squares = (q * q).sum(1)
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            d = _distances(q[who], self.points[node])[:, :, None]
            with np.errstate(invalid="ignore"):
                near = np.maximum(np.maximum(self.low[node] - d, d - self.high[node]).max(1), 0)
                far = (d + self.high[node]).min(1)
                least, most = self.norms[node]
                slack = 1e-6 + 1e-9 * (squares[who, None] + most)
                top = (squares[who, None] + most - near * near) / 2 + slack
                bottom = (squares[who, None] + least - far * far) / 2 - slack
            meets = ((top[:, None, :] >= low[who][:, :, None]) & (bottom[:, None, :] <= high[who][:, :, None])).any(1)
            meets &= most >= least  # children without rows
            for j, below in enumerate(self.children[node]):
                if below < 0:
                    out[who, -1 - below] = meets[:, j]
                elif meets[:, j].any():
                    stack.append((below, who[meets[:, j]]))
        return out


def _far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k different points of the first few (of all, if those are equal), each the farthest from those chosen before."""
    some = x[: 3 * k]
    some = x if (some == some[0]).all() else some
    chosen, gap = [0], _distances(some, some[:1])[:, 0]
    while len(chosen) < k and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def plant(sample: np.ndarray, rows_each: float, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> Tree:
    """A tree from sample rows, each of which stands for ``rows_each`` rows."""
    tree, leaf_points = Tree([], [], np.zeros(0)), []

    def grow(x: np.ndarray) -> int:
        node = len(tree.points)
        points = _far_apart(x, min(fanout, max(2, round(len(x) * rows_each / leaf_rows))))
        tree.points.append(points)
        tree.children.append([])
        child = _distances(x, points).argmin(1)
        for j in range(len(points)):
            mine = x[child == j]
            if len(mine) * rows_each > leaf_rows and len(mine) > 2 * fanout and (mine != mine[0]).any():
                tree.children[node].append(grow(mine))
            else:
                tree.children[node].append(-1 - len(leaf_points))
                leaf_points.append(points[j])
        return node

    grow(sample)
    tree.leaf_points = np.array(leaf_points)
    return tree


def _indexer(tree: Tree, width: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(3), width)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(tree.leaves(x), pa.int32()), _lists(x)], ["row", "id", "label", "leaf", "vec"])

    return run


def _measurer(tree: Tree, width: int):
    """Partial ranges: a row per node and child that the task has seen."""

    def run(batches):
        low, high = ([np.full((len(p), len(p)), v) for p in tree.points] for v in (np.inf, -np.inf))
        norms = [np.array([[np.inf], [-np.inf]]).repeat(len(p), 1) for p in tree.points]
        for b in batches:
            x = _matrix(b.column(0), width)
            squares = (x * x).sum(1)
            for node, rows, d, child in tree.descend(x):
                for j in np.unique(child):
                    mine = child == j
                    low[node][:, j] = np.minimum(low[node][:, j], d[mine].min(0))
                    high[node][:, j] = np.maximum(high[node][:, j], d[mine].max(0))
                    n = squares[rows[mine]]
                    norms[node][:, j] = min(norms[node][0, j], n.min()), max(norms[node][1, j], n.max())
        out = [(n, j, low[n][:, j].tolist(), high[n][:, j].tolist(), *norms[n][:, j].tolist())
               for n in range(len(tree.points)) for j in range(len(tree.points[n])) if norms[n][1, j] >= norms[n][0, j]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "child", "low", "high", "least", "most"])

    return run


def measured(tree: Tree, indexed: DataFrame, width: int) -> Tree:
    """The tree with the ranges over all rows."""
    parts = indexed.select("vec").mapInArrow(_measurer(tree, width), "node long, child long, low array<double>, high array<double>, least double, most double")
    most = max(map(len, tree.points))
    merged = parts.groupBy("node", "child").agg(
        F.array(*[F.min(F.get("low", F.lit(i))) for i in range(most)]).alias("low"),
        F.array(*[F.max(F.get("high", F.lit(i))) for i in range(most)]).alias("high"), F.min("least").alias("least"), F.max("most").alias("most"),
    ).collect()  # a row for each split point of the tree
    low, high = ([np.full((len(p), len(p)), v) for p in tree.points] for v in (np.inf, -np.inf))
    norms = [np.array([[np.inf], [-np.inf]]).repeat(len(p), 1) for p in tree.points]
    for r in merged:
        k = len(tree.points[r.node])
        low[r.node][:, r.child], high[r.node][:, r.child] = r.low[:k], r.high[:k]
        norms[r.node][:, r.child] = r.least, r.most
    if max(n[1].max() for n in norms) >= 2.0**63:
        raise ValueError("inner products of these vectors do not fit a long integer")
    return Tree(tree.points, tree.children, tree.leaf_points, low, high, norms)


@dataclass
class Units:
    """Leaves gathered in units: a unit holds the leaves [first, end), or a part of one large leaf."""

    first: np.ndarray
    end: np.ndarray
    first_unit: np.ndarray  # by leaf
    parts: np.ndarray  # by leaf

    @classmethod
    def of(cls, counts: np.ndarray, rows: int) -> Units:
        first, end, first_unit, parts, room = [], [], [], [], 0
        for leaf, n in enumerate(counts.tolist()):
            if n > rows or n > room or not first:
                pieces = max(1, -(-n // rows))
                first_unit.append(len(first))
                first += [leaf] * pieces
                end += [leaf + 1] * pieces
                room = rows - n if pieces == 1 else 0
            else:
                pieces, room = 1, room - n
                first_unit.append(len(first) - 1)
                end[-1] = leaf + 1
            parts.append(pieces)
        return cls(*(np.array(a, np.int64) for a in (first, end, first_unit, parts)))


def _visitor(tree: Tree, units: Units, width: int, probe: bool, filled: np.ndarray):
    """Anchors to the units that they need, or, as a probe, to one part of the leaves that look best for each window."""
    alone = units.parts > 1

    def best(q, low, high):
        e = q @ tree.leaf_points.T
        out = np.zeros(e.shape, bool)
        for w in range(low.shape[1]):
            away = np.where(high[:, w, None] >= MOST, -e, np.abs(e - high[:, w, None]))
            away[:, ~filled] = np.inf
            k = min(PROBES, int(filled.sum()))
            rows = np.flatnonzero(low[:, w] <= high[:, w])
            out[rows[:, None], np.argpartition(away[rows], k - 1, axis=1)[:, :k]] = True
        return out

    def run(batches):
        for b in batches:
            qid, q = b.column(0).to_numpy(), _matrix(b.column(2), width)
            for at in range(0, len(qid), 256):
                some = slice(at, at + 256)
                low, high = ([np.array(x, float) for x in b.column(c)[some].to_pylist()] for c in (3, 4))
                most = max(map(len, low), default=0)
                low = np.array([np.append(x, np.full(most - len(x), np.inf)) for x in low])
                high = np.array([np.append(x, np.full(most - len(x), -np.inf)) for x in high])
                need = best(q[some], low, high) if probe else tree.needed(q[some], low, high)
                who, unit, leaves = [], [], []
                for u, (a, z) in enumerate(zip(units.first.tolist(), units.end.tolist())):
                    mine = need[:, a:z]
                    if probe and alone[a]:
                        mine = mine & ((qid[some] % units.parts[a] + units.first_unit[a]) == u)[:, None]
                    rows = np.flatnonzero(mine.any(1))
                    who.append(rows)
                    unit.append(np.full(len(rows), u))
                    leaves += [(a + np.flatnonzero(m)).astype(np.int32) for m in mine[rows]]
                who = np.concatenate(who) + at if who else np.zeros(0, np.int64)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(unit) if unit else who, pa.int64()), *[b.column(c).take(take) for c in (0, 1, 2, 3, 4)], pa.array(leaves, pa.list_(pa.int32()))],
                    ["unit", "qid", "label", "vec", "low", "high", "leaves"])

    return run


def _scan(unit: dict[str, np.ndarray], visits: pa.RecordBatch, same: bool, k: int, width: int, whole: bool):
    """The best k rows of a unit for each visit and window, the leaves of the visit only. ``whole``: in whole numbers."""
    kind = np.int64 if whole else np.float64
    q, qid, label = _matrix(visits.column("vec"), width).astype(kind), visits.column("id").to_numpy(), visits.column("label").to_numpy()
    lows, highs = visits.column("low").to_pylist(), visits.column("high").to_pylist()
    wanted = visits.column("leaves")
    owner, leaf = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
    kept: list[list] = [[] for _ in qid]
    for x in np.unique(leaf):
        a, z = np.searchsorted(unit["leaf"], [x, x + 1])
        who = owner[leaf == x]
        for at in range(0, len(who), step := max(1, (1 << 22) // max(z - a, 1))):
            scores = q[who[at:at + step]] @ unit["vec"][a:z].T
            for v, s in zip(who[at:at + step].tolist(), scores):
                fits = (unit["label"][a:z] == label[v]) == same
                fits &= (s >= min(lows[v])) & (s <= max(highs[v]))
                rows = np.flatnonzero(fits)
                if same:
                    rows = rows[unit["row"][a + rows] != qid[v]]
                if len(rows):
                    kept[v].append((s[rows], unit["id"][a + rows]))
    for v, parts in enumerate(kept):
        if not parts:
            continue
        s, ids = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((ids, -s))
        s, ids = s[order], ids[order]
        for w, (low, high) in enumerate(zip(lows[v], highs[v])):
            best = np.flatnonzero((s >= low) & (s <= high))[:k]
            if len(best):
                yield qid[v], w, ids[best], s[best]


def _scanner(same: bool, k: int, width: int, whole: bool):
    """Sorted groups of a unit's rows, then its visits; a group's rows are held, its visits are streamed."""

    def run(batches):
        group, parts, unit = None, [], None
        for b in batches:
            unit_of, copy, kind = (b.column(c).to_numpy() for c in ("unit", "copy", "kind"))
            cuts = np.flatnonzero((np.diff(unit_of) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(unit_of)]):
                if a == z:
                    continue
                if (unit_of[a], copy[a]) != group:
                    group, parts, unit = (unit_of[a], copy[a]), [], None
                some = b.slice(a, z - a)
                if kind[a] == 0:
                    parts.append({"vec": _matrix(some.column("vec"), width)} | {c: some.column(c).to_numpy() for c in ("row", "id", "label", "leaf")})
                    continue
                if not parts:
                    continue  # a unit whose rows all went to other parts
                if unit is None:
                    unit = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
                    unit["vec"] = unit["vec"].astype(np.int64) if whole else unit["vec"]
                found = list(_scan(unit, some, same, k, width, whole))
                if found:
                    qid, w, ids, s = zip(*found)
                    n = list(map(len, ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qid, n), pa.int64()), pa.array(np.repeat(w, n), pa.int32()),
                         pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(s).astype(np.int64), pa.int64())], ["qid", "w", "id", "score"])

    return run


@dataclass
class Index:
    indexed: DataFrame  # row, id, label, leaf, vec; stored
    tree: Tree
    units: Units
    filled: np.ndarray
    width: int

    def rows(self) -> DataFrame:
        """The rows with their units."""
        of_leaf = self.indexed.sparkSession.createDataFrame(
            [(x, int(u), int(p)) for x, (u, p) in enumerate(zip(self.units.first_unit, self.units.parts))], "leaf int, first_unit long, parts long")
        return self.indexed.join(of_leaf, "leaf").withColumn("unit", F.col("first_unit") + F.pmod(F.xxhash64("row"), F.col("parts")))

    def _best(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """(qid, w, id, score, rank): the best k over all visits, rank from 1."""
        visits = stored(visits, "visits")
        copies = stored(visits.groupBy("unit").agg(F.ceil(F.count("*") / GROUP_VISITS).alias("copies")), "unit-copies")
        whole = max(n[1].max() for n in self.tree.norms) >= 2.0**53
        held = self.rows().join(copies, "unit").select(
            "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "row", "id", "label", "leaf", "vec")
        asking = visits.join(copies, "unit").select(
            "unit", F.pmod(F.xxhash64("qid"), F.col("copies")).alias("copy"), F.lit(1).alias("kind"), F.col("qid").alias("id"), "label", "vec", "low", "high", "leaves")
        groups = copies.agg(F.sum("copies").alias("n")).first().n or 1
        parts = max(int(groups), int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = held.unionByName(asking, allowMissingColumns=True).repartition(parts, "unit", "copy").sortWithinPartitions("unit", "copy", "kind", "leaf")
        found = dealt.mapInArrow(_scanner(same, k, self.width, whole), _FOUND)
        place = F.row_number().over(Window.partitionBy("qid", "w").orderBy(F.desc("score"), F.asc("id")))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """The best k rows of the same label, or of others, in each window of each anchor (qid, label, vec, low, high)."""
        visitor = lambda probe: _visitor(self.tree, self.units, self.width, probe, self.filled)
        asked = anchors.select("qid", "label", "vec", "low", "high")
        first = self._best(asked.mapInArrow(visitor(True), _VISIT), same, k)
        full = first.where(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("least"))
        raised = F.transform("low", lambda x, w: F.coalesce(F.greatest(x, F.try_element_at("least", w)), x))
        again = stored(asked.join(full, "qid", "left").select("qid", "label", "vec", raised.alias("low"), "high"), "raised-anchors")
        return self._best(again.mapInArrow(visitor(False), _VISIT), same, k)


def usable(rows: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, vec) of the rows that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite).select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"))


def build(vectors: DataFrame, scale: float = 256) -> Index | None:
    """The index of rows (id, label, vec); each component x counts as floor(scale * x). None without rows."""
    scaled = vectors.select("id", "label", F.transform("vec", lambda x: F.rint(F.floor(x * scale))).alias("vec"))
    n, width = scaled.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return None
    sample = scaled.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h", "vec").limit(SAMPLE_ROWS).collect()
    points = np.array([np.append(r.vec, np.zeros(width - len(r.vec))) for r in sample], float).reshape(len(sample), width)
    tree = plant(points, n / len(sample))
    numbered = scaled.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vec")
    indexed = stored(numbered.mapInArrow(_indexer(tree, width), _INDEXED), "indexed-vectors")
    tree = measured(tree, indexed, width)
    counts = np.zeros(len(tree.leaf_points), np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row for each leaf of the tree
        counts[r.leaf] = r["count"]
    share = -(-n // (4 * vectors.sparkSession.sparkContext.defaultParallelism))
    units = Units.of(counts, min(max(LEAF_ROWS, share), max(LEAF_ROWS, UNIT_BYTES // (8 * max(width, 1)))))
    return Index(indexed, tree, units, counts > 0, width)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW, scale: float = 256) -> DataFrame:
    """Hard negatives for each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` as from ``usable``; ``is_anchor`` is a condition on its columns. Positives are the best rows of the anchor's label other than its own
    row, negatives the best of other labels whose score is within the window's hundredths of the positive's. Ties go to the smaller id.
    """
    index = build(vectors, scale)
    if index is None:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = stored(index.indexed.where(is_anchor).select(F.col("row").alias("qid"), "id", "label", "vec"), "anchors")
    everything = {"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))}
    good = stored(index.search(anchors.withColumns(everything), True, positives), "positives")
    low, high = window  # of scores from zero on; below, the upper end is less than the lower
    bounds = F.struct("rank", F.expr(f"score div 100 * {low} + (score % 100 * {low} + 99) div 100").alias("low"), F.expr(f"score div 100 * {high} + score % 100 * {high} div 100").alias("high"))
    windows = good.where("score >= 0").groupBy("qid").agg(F.sort_array(F.collect_list(bounds)).alias("b"))  # at most ``positives`` each
    asking = stored(anchors.join(windows, "qid").select("qid", "label", "vec", F.col("b.low").alias("low"), F.col("b.high").alias("high")), "windows")
    bad = index.search(asking, False, negatives)
    named = good.join(anchors.select("qid", F.col("id").alias("anchor_id")), "qid").select(
        "qid", "anchor_id", F.col("id").alias("positive_id"), (F.col("rank") - 1).alias("w"), F.col("score").alias("positive_score"))
    return bad.join(named, ["qid", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
