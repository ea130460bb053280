import random

import pytest
import xxhash
from helpers import SCHEMA, ascii_lower, documents, key, prose, rows
from pyspark.sql import functions as F

from panelcf.llm import simhash


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint); the smallest id reachable over two or fewer differing bits."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i:]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in prints]


def test_fingerprints_and_components(spark):
    data = rows()
    got = simhash.near_duplicates(documents(spark)).select("__llm_id", simhash.hex_digits(F.col("fp")), "component_id").collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in data]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_connect_what_brute_force_connects(spark, crowd):
    rng = random.Random(crowd)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for _ in range(6):  # chains and clusters that share either half
        p = rng.getrandbits(64)
        for _ in range(25):
            p ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 2, 3])))
            prints.add(p & ((1 << 64) - 1))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowd)
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in edges.collect())
    from panelcf.llm.components import connected

    root = {r["vertex"]: r["root"] for r in connected(edges).collect()}
    got = [root.get(p, p) for p in signed]
    want = brute_components([(i, p & ((1 << 64) - 1)) for i, p in enumerate(signed)])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_bit_counts_in_blocks(monkeypatch):
    text = prose(random.Random(1), 3000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 300)
    assert simhash.fingerprint(text) == whole


def test_stage_keeps_one_of_each(spark):
    docs = documents(spark)
    kept = simhash.keep_one_each(docs)
    assert kept.schema == docs.schema
    data = rows()
    prints = [(r[0], brute_fingerprint(r[1])) for r in data]
    components = brute_components(prints)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(set(components), key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one_each(none).collect() == []
