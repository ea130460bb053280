import random

from helpers import SCHEMA, documents, key, prose, rows
from test_linededup_passages import brute

from panelcf.llm import linededup


def case():
    rng = random.Random(6)
    passage = [prose(rng, 100) for _ in range(3)] + ["\n".join(prose(rng, 6) for _ in range(20))]
    data = [(d, t) for d, t, *_ in rows()]
    for i in range(40):
        own = "\n".join(prose(rng, rng.choice([4, 8, 60])) for _ in range(rng.randint(1, 6)))
        middle = rng.choice(passage) if i % 2 else ""
        data.append((500 + i, "\n".join(x for x in (own, middle, prose(rng, 9)) if x)))
    data.append((700, passage[0] + " " + prose(rng, 40)))
    data.append((701, "word " * 70))
    data.append((702, "Word.\n" + "word " * 70))
    return data, passage


def fill(data):
    return [(d, t, "en", "s", None if t is None else len(t), 0, "r") for d, t in data]


def test_equals_brute_force(spark):
    data, _ = case()
    out = linededup.drop_repeats(documents(spark, fill(data)))
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)
    assert got == brute(data)
    assert {r["n_chars"] - len(r["text"]) for r in out.collect() if r["text"] is not None} == {0}


def test_passages_stay_once(spark):
    data, passage = case()
    docs = documents(spark, fill(data))
    out = linededup.drop_repeats(docs)
    assert out.schema.names == docs.schema.names
    texts = [r["text"] or "" for r in out.collect()]
    for p in passage:
        assert sum(p in t for t in texts) == 1
    left = [sum(s in t for t in texts) for p in passage[:3] for s in p.split(". ")[:1]]
    assert max(left) <= 2


def test_distinct_texts_are_left_alone(spark):
    rng = random.Random(9)
    data = [(i, "\n".join(f"{i} {k} " + prose(rng, 12) for k in range(10))) for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeats(documents(spark, fill(data))).collect()}
    assert got == dict(data)


def test_unequal_bytes_under_one_hash_stay(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(linededup, "_hash", lambda bare: F.length(bare).cast("long"))
    a, b = "ab " * 20, "cd " * 20
    data = [(1, f"{a}\n{b}\n"), (2, f"{a[::-1]}\n{b[::-1]}\n"), (3, f"{a[::-1]}\n{b[::-1]}\n")]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeats(documents(spark, fill(data))).collect()}
    assert got == dict(data)


def test_clashing_column_names(spark):
    from pyspark.sql import functions as F

    more = {c: F.lit(c) for c in ("found", "hash", "start", "size", "p", "m", "at")}
    out = linededup.drop_repeats(documents(spark).withColumns(more))
    assert out.count() == len(rows()) and {r["found"] for r in out.collect()} == {"found"}


def test_empty_table(spark):
    assert linededup.drop_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
