import math
import random

import numpy as np
import pytest
from helpers import key
from pyspark.sql import functions as F

from panelcf.llm import hardneg
from panelcf.llm.queries import ENTRIES

SCHEMA = "vec_id long, embedding array<float>, label int, low string, qid int"


def contract(data):
    """The contract's rows by brute force; data: (vec_id, embedding, label)."""
    taking = []
    for vec_id, e, label in data:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        taking.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in e], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, (aid, av, alabel) in enumerate(taking):
        if aid % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label) for k, (i, v, label) in enumerate(taking) if k != a]
        positives = sorted((s, i) for s, i, label in scored if label == alabel)[:5]
        others = sorted((s, i) for s, i, label in scored if label != alabel)
        for s, i in positives:
            fit = [(n, j) for n, j in others if 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(aid, i, r + 1, j, -s, -n) for r, (n, j) in enumerate(fit)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA).repartition(3)


def awkward(seed, n=420, d=6):
    """Clusters, equal vectors, ties, rows that take no part, repeated rows, short and empty vectors, far outliers."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    data = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    data += [(n + i, [1.0] * d, i % 3) for i in range(90)]  # one vector, many copies
    data += [(2000 + i, [float(rng.randint(-2, 2)) for _ in range(d)], rng.randrange(11)) for i in range(150)]
    data += [(3000, [40.0] * d, 1), (3001, [-40.0] * d, 1), (3100, [0.5] * (d - 2), 2), (3101, [0.25], 1), (3200, [], 2), (3201, [], 1)]
    data += [(None, [1.0] * d, 1), (3300, None, 1), (3400, [1.0, None] + [0.0] * (d - 2), 1), (3500, [math.nan] * d, 1),
             (3600, [math.inf] + [0.0] * (d - 1), 1), (3700, [1.0] * d, None), (3800, [0.0] * d, 9)]
    return data + [data[0], data[0], data[100], data[5], (None, None, None)]


@pytest.mark.parametrize("seed, leaf_rows, visits", [(0, 1024, 4096), (1, 20, 3), (2, 7, 1), (3, 60, 4096)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, seed, leaf_rows, visits):
    monkeypatch.setattr(hardneg, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(hardneg.plant, "__defaults__", (leaf_rows, 5))
    monkeypatch.setattr(hardneg, "GROUP_VISITS", visits)
    monkeypatch.setattr(hardneg, "UNIT_BYTES", leaf_rows * 48)
    monkeypatch.setattr(hardneg, "SAMPLE_ROWS", 300)
    data = awkward(seed)
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in ENTRIES["op11_hard_negatives"].run(spark, str(tmp_path)).collect()]
    want = contract(data)
    assert len(want) > 150
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_and_unusable_tables(spark):
    for data in ([], [(100, None, 1), (None, [1.0], 1)]):
        assert hardneg.mine(hardneg.usable(frame(spark, data)), F.lit(True)).collect() == []


def test_norms_beyond_long_are_an_error(spark):
    with pytest.raises(ValueError, match="long integer"):
        hardneg.mine(hardneg.usable(frame(spark, [(100, [1e30], 1), (1, [1.0], 2)])), F.lit(True))


def test_large_components_are_exact(spark, tmp_path):
    """Scores beyond 2^53, compared as whole numbers."""
    rng = random.Random(4)
    data = [(i * 50, [float(rng.randint(1, 1 << 22)) + 0.25 * rng.randint(0, 3) for _ in range(3)], i % 3) for i in range(60)]
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in ENTRIES["op11_hard_negatives"].run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(contract(data)) and max(r[4] for r in got) > 1 << 53


def test_annuli_leave_out_only_leaves_without_matches():
    """Clustered vectors: few leaves are needed, and none that holds a wanted row is left out."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 300, (30, 8))
    x = np.floor(centres[rng.integers(0, 30, 4000)] + rng.normal(0, 15, (4000, 8)))
    tree = hardneg.plant(x[:800], 5.0, leaf_rows=100, fanout=8)
    leaves = tree.leaves(x)
    low, high = ([np.full((len(p), len(p)), v) for p in tree.points] for v in (np.inf, -np.inf))
    norms = [np.array([[np.inf], [-np.inf]]).repeat(len(p), 1) for p in tree.points]
    for node, at, d, child in tree.descend(x):
        for j in np.unique(child):
            low[node][:, j], high[node][:, j] = d[child == j].min(0), d[child == j].max(0)
            n = (x[at[child == j]] ** 2).sum(1)
            norms[node][:, j] = n.min(), n.max()
    tree.low, tree.high, tree.norms = low, high, norms
    q = x[:50]
    scores = q @ x.T
    top = np.sort(scores, axis=1)[:, -20]
    need = tree.needed(q, top[:, None], np.full((50, 1), np.inf))
    holds = np.zeros_like(need)
    for k in range(50):
        holds[k, leaves[scores[k] >= top[k]]] = True
    assert (need | ~holds).all()
    assert need.mean() < 0.5
