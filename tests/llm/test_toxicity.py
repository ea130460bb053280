import random

import pytest
from helpers import SCHEMA, documents, prose, rows

from panelcf.llm import toxicity

BAD = ["stupid", "worthless", "pathetic", "disgusting", "scum"]


def case(n=500, seed=1):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.choice([15, 60, 200])).split(), i % 4 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        data.append((i, " ".join(words), "en", "s", 0, 0, "r"))
        labels.append((i, int(toxic)))
    return data, labels


def test_held_out_accuracy_and_misspellings(spark):
    data, labels = case()
    docs, marks = documents(spark, data), spark.createDataFrame([*labels, (3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_from(docs, marks)
    truth, held = dict(labels), [d for d, *_ in data if __import__("zlib").crc32(str(d).encode()) % 5 == 0]
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert sum((got[d] >= 0.5) == truth[d] for d in held) >= 0.97 * len(held)
    more = [(1, "orth stupidd wher the worthles reti of patheticc", None, None, 0, 0, "r"), (2, "orth ands wher the ingers reti of bleaou", None, None, 0, 0, "r")]
    odd = {r["doc_id"]: r["score"] for r in toxicity.scores(documents(spark, more), model).collect()}
    assert odd[1] > 0.5 > odd[2]


def test_held_out_rows_do_not_train(spark):
    data, labels = case(200)
    flipped = [(d, 1 - t if __import__("zlib").crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    a, b = (toxicity.fit_from(documents(spark, data), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_awkward_rows_and_stage(spark):
    data, labels = case(200)
    docs = documents(spark)
    model = toxicity.fit_from(documents(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_harmless(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r["score"] < 0.5 for r in got)


def test_two_toxic_rows_do_not_make_the_rest_toxic(spark):
    """Texts in which nothing tells stay with the other class, the two are found."""
    data = rows()
    model = toxicity.fit([r[1] for r in data[:40]], [int(r[0] in (21, 35)) for r in data[:40]])
    unknown = [(900, "no end " * 500, None, None, 0, 0, "r"), (901, "\u6f22\u5b57", None, None, 0, 0, "r"), (902, None, None, None, 0, 0, "r")]
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.scores(documents(spark, [*data[:40], *unknown]), model).collect()}
    assert {d for d in got if got[d]} == {21, 35}


def test_very_long_texts_and_clashing_columns(spark):
    """A few bad words among thousands of others are found; columns named like those of the operator stay as they are."""
    data, labels = case(600)
    model = toxicity.fit_from(documents(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rng = random.Random(5)
    words = prose(rng, 20_000).split()
    bad = [rng.choice(BAD) if rng.random() < 0.03 else w for w in words]
    docs = documents(spark, [(1, " ".join(words), "en", "s", 0, 0, "r"), (2, " ".join(bad), "en", "s", 0, 0, "r")])
    for name in ("score", "predicted", "toxic", "memo"):
        docs = docs.selectExpr("*", f"'{name}' AS {name}")
    assert [r["score"] >= 0.5 for r in sorted(toxicity.scores(docs, model).collect())] == [False, True]
    kept = toxicity.keep_harmless(docs, model).collect()
    assert [(r["doc_id"], r["score"], r["toxic"]) for r in kept] == [(1, "score", "toxic")]


def test_score_is_that_of_the_averaged_vectors(spark):
    """The scorer equals the mean over words of the mean over their buckets, taken word by word."""
    data, labels = case(200)
    model = toxicity.fit_from(documents(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(documents(spark, data), model).collect()}
    for doc_id, text, *_ in data[:40]:
        words = toxicity._words(text)
        logit = model.bias + sum(model.weight[toxicity._features(w)].astype(float).mean() for w in words) / (toxicity.PAD + len(words))
        assert abs(got[doc_id] - 1 / (1 + 2.718281828459045 ** -logit)) < 1e-9


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)])
def test_single_class(spark, labels, score):
    docs = documents(spark)
    model = toxicity.fit_from(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {round(r["score"], 6) for r in toxicity.scores(docs, model).collect()} == {score}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = toxicity.fit_from(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scores(none, model).collect() == []
