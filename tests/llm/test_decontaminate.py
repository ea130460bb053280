import hashlib
import random
import re

from helpers import SCHEMA, ascii_lower, documents, key, prose, rows
from pyspark.sql import functions as F

from panelcf.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, item in items:
            v = words(item)
            for win in [v[k:k + 13] for k in range(len(v) - 12)] or [v]:
                for s in range(len(w) - len(win) + 1 if win else 0):
                    if w[s:s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=key)


def case():
    rng = random.Random(5)
    data = rows()
    items = [(i, prose(rng, rng.choice([14, 20, 45]))) for i in range(12)] + [
        (20, data[10][1]), (21, "orth wher"), (22, "idiot"), (23, ""), (24, None), (25, "?!"), (None, prose(rng, 15)), (2, "Straße-漢字"), (26, data[10][1])]
    for k, (i, item) in enumerate(list(items)):
        if item:
            data.append((200 + k, f"{prose(rng, 30)} {item.upper() if k % 2 else item}, {prose(rng, k)}", None, None, 0, 0, "r"))
    data.append((300, " ".join([items[0][1]] * 30), None, None, 0, 0, "r"))
    data.append((301, " ".join(items[1][1].split()[3:17]) + " zz " + prose(rng, 300), None, None, 0, 0, "r"))
    return data, items


def test_equals_brute_force(spark):
    data, items = case()
    got = decontaminate.contamination(documents(spark, data), spark.createDataFrame(items, "item_id long, text string")).select(
        "__llm_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    assert sorted(map(tuple, got), key=key) == brute([(r[0], r[1]) for r in data], items)


def test_stage(spark):
    data, items = case()
    docs = documents(spark, data)
    kept = decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.schema == docs.schema
    clean = [r[0] for r in brute([(r[0], r[1]) for r in data], items) if not r[5]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).collect() == []
    assert {r["n_hit"] for r in decontaminate.contamination(documents(spark), items).collect()} == {0}
