"""Near-duplicate documents: SimHash fingerprints linked by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most two bits
differ in at most one bit of the first segment, or not at all in the second (if the first takes two of the bits,
none is left). So each fingerprint looks up the 33 values around its first segment and its own second segment in
the segment tables, and the matches are verified over all 64 bits.

A segment value shared by very many fingerprints would make pairs by the square of their number. Fingerprints
that meet such a crowded value are linked in another way, which is as exact: two fingerprints differ in at most two bits if
and only if some 64-bit value is within one bit of both, so all meet at the 65 values around them, and
each value (at most 65 members, as members are distinct) links its members to the least of them.

Defined results: a null text counts as empty; an empty text has fingerprint zero and links like any other; a
null doc_id takes part in links but is never the id of a component that has another id; equal rows are kept.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.llm.common import keyed, match_keys, stored
from panelcf.llm.components import connected

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
SHINGLE_WORDS = 3
#: A segment value with more fingerprints than this is linked through the values around whole fingerprints.
CROWD = 64
#: Hashes counted at once, so that very long texts stay within bounded memory.
BLOCK = 1 << 18


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set. Eight counters share a machine word for 255 rows at a time."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    packed = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
    return packed.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle_words, len(words))
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    first, last = starts[: len(words) - k + 1].tolist(), (starts[k:] - 1).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(first), BLOCK):
        part = [digest(line[a:b], SEED) for a, b in zip(first[lo:lo + BLOCK], last[lo:lo + BLOCK])]
        ones += _ones(np.array(part, np.uint64))
    return int(np.packbits(ones * 2 > len(first), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["__llm_id", "__llm_text", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(__llm_id, __llm_text, fp) per row of documents."""
    rows, names = keyed(docs)
    return rows.select(*names, "text").mapInArrow(_fingerprints, "__llm_id long, __llm_text long, fp long")


def _segments(fp):
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _key(segment: int, value):
    return value.bitwiseOR(F.lit(segment << 32).cast("long"))


def _flips(width: int):
    """Zero and the single bits of a field."""
    return F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(width)])


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (column fp, distinct) at two or fewer differing bits.

    Within uncrowded segment values every such pair is an edge; in crowded ones a pair may be connected
    over a third fingerprint that is within two bits of both.
    """
    fp = F.col("fp")
    high, low = _segments(fp)
    index = fps.select(F.explode(F.array(_key(0, high), _key(1, low))).alias("key"), fp)
    probes = fps.select(
        F.explode(F.concat(F.transform(_flips(32), lambda m: _key(0, high.bitwiseXOR(m))), F.array(_key(1, low)))).alias("key"),
        fp.alias("other"),
    )
    crowded = stored(index.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    near = F.bit_count(fp.bitwiseXOR(F.col("other"))) <= 2
    if crowded.isEmpty():
        return probes.join(index, "key").where(near & (fp != F.col("other"))).select(fp.alias("a"), F.col("other").alias("b"))
    few = index.join(crowded, "key", "left_anti")
    pairs = probes.join(few, "key").where(near & (fp != F.col("other"))).select(fp.alias("a"), F.col("other").alias("b"))
    meeting = probes.join(crowded, "key", "left_semi").select(F.col("other").alias("fp")).distinct()
    around = meeting.select(F.explode(F.transform(_flips(64), lambda m: fp.bitwiseXOR(m))).alias("mid"), fp)
    stars = (
        around.groupBy("mid").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    )
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Per row of documents: key columns, fp, root and component_id, the smallest doc_id reachable over links."""
    rows = stored(fingerprints(docs), "fingerprints")
    reps = stored(rows.groupBy("fp").agg(F.min("__llm_id").alias("least")), "distinct-fingerprints")
    roots = connected(links(reps.select("fp"), crowd)).withColumnRenamed("vertex", "fp")
    labelled = reps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp", "left")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """Documents without near duplicates: of each component the row with the smallest doc_id stays, columns unchanged."""
    found = near_duplicates(docs).where(F.col("__llm_id").eqNullSafe(F.col("component_id")))
    first = stored(found.groupBy("root", "__llm_id").agg(F.min("__llm_text").alias("__llm_text"), F.count("*").alias("n")), "kept")
    rows, names = keyed(docs)
    kept = match_keys(rows, first.select(*names), names, "left_semi")
    if not first.where("n > 1").isEmpty():  # rows repeated in full
        kept = kept.dropDuplicates(names)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
