import hashlib
import random

import pytest
from helpers import SCHEMA, documents, key, prose, rows

from panelcf.llm import spotsigs


def sets_of(spark, data):
    got = spotsigs.with_signatures(spark.createDataFrame(data, "doc_id long, text string"), "text", "sigs").collect()
    return {r["doc_id"]: frozenset(r["sigs"]) for r in got}


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_chains(spark):
    texts = ["Cat sat on the mat, dog ran", "cat sat the on mat dog", "cat sat", "", None, "the of", "mat dog"]
    s = sets_of(spark, list(enumerate(texts)))
    assert len(s[0]) == 2 and s[0] == s[1] and len(s[2]) == 1 and s[3] == s[4] == frozenset()
    assert s[6] < s[0] and s[2] < s[0]


def test_edit_experiment(spark, monkeypatch):
    data = [r for r in rows() if r[0] is not None][:-1]
    ordered = sorted(data, key=lambda r: r[0])
    edited = []
    for k, r in enumerate(ordered):
        t, u = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        h = len(t) // 2
        edited.append((r[0], len(t), t[:len(t) - h] + u[:h]))
    own, changed = sets_of(spark, [(r[0], r[1]) for r in ordered]), sets_of(spark, [(d, e) for d, _, e in edited])
    ids = [r[0] for r in ordered]
    for size in (1000, 7):
        monkeypatch.setattr(spotsigs, "BUCKET_ROWS", size)
        got = {r["doc_id"]: r for r in spotsigs.edit_experiment(documents(spark, data)).collect()}
        assert len(got) == len(ids)
        for k, (d, n, e) in enumerate(edited):
            r = got[d]
            assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(e.encode()).hexdigest())
            assert r["near_edited"] == pytest.approx(jaccard(own[d], changed[d]))
            assert r["near_next"] == pytest.approx(jaccard(own[d], own[ids[(k + 1) % len(ids)]]))
    same = {}
    for r in ordered:
        same.setdefault(r[1] or "", set()).add(got[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_nulls_repeats_and_single_rows(spark):
    assert len(spotsigs.edit_experiment(documents(spark)).collect()) == len(rows())
    assert spotsigs.edit_experiment(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spotsigs.edit_experiment(documents(spark, rows()[:1])).first()
    assert one["near_next"] == 1.0


def test_many_ranges(spark, monkeypatch):
    """The plan gets a few characters for each range, with or without a bound on the ranges every row is right."""
    data = [(5 * i - 700, f"the word{i % 50} of {i}") for i in range(300)] + [(None, "the null of ids"), (-700, "the first again"), (2**40, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)

    def ran():
        done = spotsigs.edit_experiment(docs)
        return len(done._jdf.queryExecution().logical().toString()), sorted(done.collect(), key=str)

    plan, want = ran()
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 1)
    longer, got = ran()
    assert longer < plan + 30 * len(data) and got == want and len(got) == len(data)
    monkeypatch.setattr(spotsigs, "MAX_BUCKETS", 20)
    bounded, got = ran()
    assert bounded < plan + 30 * 30 and got == want


def test_cuts_below(spark):
    ids = [None, -9, -3, -2, 0, 4, 5, 6, 2**60 - 1, 2**60, 2**60 + 1]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for cuts in ([], [5], [-3, 5], [-3, 0, 5], [-3, 0, 5, 6, 2**60]):
        got = {r[0]: r[1] for r in rows.select("doc_id", spotsigs._cuts_below(rows["doc_id"], cuts)).collect()}
        assert got == {i: 0 if i is None else sum(c <= i for c in cuts) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    data = []
    for i in range(25):
        words = prose(rng, rng.choice([8, 30, 90, 150])).split()
        data.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            for _ in range(k):
                words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
            data.append((10 * i + k, " ".join(words)))
        data.append((10 * i + 9, data[-2][1]))
    data += [(900, ""), (901, None)]
    members, pairs = spotsigs.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    s, least = sets_of(spark, data), {}
    for d, _ in data:
        least[s[d]] = min(d, least.get(s[d], d))
    assert {tuple(r) for r in members.collect()} == {(d, least[s[d]]) for d, _ in data}
    want = {(a, b) for a, b in ((x, y) for x in least.values() for y in least.values() if x < y) if s[a] and s[b] and jaccard(s[a], s[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and len(want) > 5


def test_key_helper_orders_nulls():
    assert sorted([(None,), (1,)], key=key) == [(None,), (1,)]
