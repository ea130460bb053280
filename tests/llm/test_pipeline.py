import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from helpers import SCHEMA, documents, rows
from __spark_entry__ import oracle_sql, queries
from check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {n.split("_")[0] for n in queries()}


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n.startswith("op")])
def test_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_stages_keep_the_columns_and_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name.replace(" ", "-"))
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now <= before, name
        before = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(last) == sorted(whole) and len(last) == before


def test_toxic_labels_are_found_on_held_out_rows(spark):
    got = {r["doc_id"]: r["predicted"] for r in queries()["op7_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(d, t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d] == t for d, t in held) >= 0.9 * len(held)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="sample tables not present")
def test_recall_and_false_alarms_on_held_out_rows(spark):
    got = {r["doc_id"]: r["predicted"] for r in queries()["op7_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall()
    held = [(d, t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 == 0 and d in got]
    bad, good = [got[d] for d, t in held if t == 1], [got[d] for d, t in held if t == 0]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


def through(spark, docs):
    """The rows after each stage."""
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out, "awkward")
        seen.append((name, docs.collect()))
    return seen


def test_awkward_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, names that clash with those of the operators."""
    long = "A line of its own with number {}.\n"
    data = [*rows(), (900, "".join(long.format(i) for i in range(30_000)), "en", "s", None, 0, "r"), (901, "no end " * 40_000, None, None, 3, None, None)]
    more = documents(spark, data)
    for c in ("hash", "start", "n", "score", "component_id", "text_id", "__label"):
        more = more.selectExpr("*", f"'{c}' AS `{c}`")
    steps = through(spark, more)
    sizes = [len(data)] + [len(found) for _, found in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert sizes[1] == sizes[2] and sizes[-1] == sizes[-2]  # line dedup drops no row, nor does encoding
    deduped = steps[1][1]
    assert {r["hash"] for r in deduped} == {"hash"} and any(r["doc_id"] is None for r in deduped)
    assert any(r["text"] is None for r in deduped) and any(r["text"] == "" for r in deduped)
    assert {r["doc_id"] for r in deduped} >= {900, 901}


def test_empty_documents(spark):
    assert [found for _, found in through(spark, spark.createDataFrame([], SCHEMA))] == [[]] * 5
