import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, documents, key, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcf.llm import periods
from panelcf.llm.queries import ENTRIES


def brute_runs(w, least=6, exponent=4):
    """Every stretch that no neighbour extends, for every period, if no smaller period fits it."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                s, e = i, j + q
                smallest = next(p for p in range(1, q + 1) if all(w[k] == w[k + p] for k in range(s, e - p)))
                if e - s >= max(least, exponent * q) and smallest == q:
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def solved(texts, **more):
    return periods._solved([t.encode() for t in texts], more.get("least", 6), more.get("exponent", 4))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.integers(3, 5), st.integers(0, 9))
def test_runs_equal_brute_force(texts, exponent, least):
    _, runs, _ = solved([" ".join(t) for t in texts], least=least, exponent=exponent)
    for t, r in zip(texts, runs):
        assert [tuple(x.values()) for x in r] == brute_runs(t, least, exponent)


def periodic(rng):
    out = []
    while len(out) < 300:
        block = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21]))]
        out += (block * rng.randint(1, 9))[: rng.randint(1, 120)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_nested_and_touching_runs(seed):
    w = periodic(random.Random(seed))
    _, (runs,), (collapsed,) = solved([" ".join(w)])
    want = brute_runs(w)
    assert [tuple(x.values()) for x in runs] == want
    gone = {k for s, n, q in want for k in range(s + q, s + n)}
    assert collapsed.decode().split() == [x for k, x in enumerate(w) if k not in gone]


def test_very_frequent_word_stays_cheap():
    n = 400_000
    begin, end, q = periods.diagonals(np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([0, n]))
    assert (begin.tolist(), end.tolist(), q.tolist()) == ([0], [n], [1])


def test_exponent_below_three_is_an_error():
    with pytest.raises(ValueError):
        periods.diagonals(np.zeros(9, np.int64), np.zeros(9, np.int64), np.array([0, 9]), exponent=2)


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w) if n < 2500 else quick_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def quick_runs(w):
    """For long texts: every diagonal at once, by comparison of shifted arrays."""
    ids = {}
    c, out = np.array([ids.setdefault(x, len(ids)) for x in w]), []
    for q in range(1, len(c) // 4 + 1):
        m = np.concatenate(([0], (c[:-q] == c[q:]).astype(np.int8), [0]))
        d = np.flatnonzero(np.diff(m))
        for s, e in zip(d[::2], d[1::2] + q):
            if e - s >= max(6, 4 * q) and not any((c[s:e - p] == c[s + p:e]).all() for p in range(1, q)):
                out.append((int(s), int(e - s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_query_equals_brute_force(spark, tmp_path):
    """Nulls, blanks, one very long text, repeated rows, clashing columns; ids enough that some texts are made periodic."""
    rng = random.Random(5)
    data = rows() + [(1000 + i, " ".join(periodic(rng)) if i % 3 else " a b \t a\x0b b " * rng.randint(0, 9), None, "h", 1, 0, "r") for i in range(120)]
    documents(spark, data).withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in ENTRIES["op13_periodic_runs"].run(spark, str(tmp_path)).collect()]
    want = [contract(r[0], r[1]) for r in data]
    assert sum(r[1] > 0 for r in want) > 60 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in data)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert ENTRIES["op13_periodic_runs"].run(spark, str(tmp_path)).collect() == []
