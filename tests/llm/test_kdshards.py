import zlib
from collections import Counter

import pytest
from helpers import SCHEMA, documents, prose, rows

from panelcf.llm import kdshards


@pytest.mark.parametrize("run_rows", [50_000, 10])
def test_sizes_slots_and_balance(spark, monkeypatch, run_rows):
    import random

    monkeypatch.setattr(kdshards, "RUN_ROWS", run_rows)
    rng = random.Random(2)
    data = rows() + [(1000 + i, prose(rng, 30), "en", "hot", 1, 0, "r") for i in range(400)]
    got = kdshards.assign(documents(spark, data)).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(16)) and len(by) > 8  # a single text outweighs several shards
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())


def test_bytes_are_near_equal(spark):
    import random

    rng = random.Random(4)
    data = [(i, prose(rng, rng.choice([20, 50, 200])), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 1, 0, "r") for i in range(3000)]
    total = Counter()
    for r in kdshards.assign(documents(spark, data)).collect():
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 16
    assert len(total) == 16 and max(abs(v - mean) for v in total.values()) < 0.02 * mean + 3000


def test_empty_table(spark):
    assert kdshards.assign(spark.createDataFrame([], SCHEMA)).collect() == []
