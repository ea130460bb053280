"""Documents that contain benchmark passages: a prefix-filtered set join.

An item is cut into windows of 13 consecutive words (a shorter item is one window), a window into its word
shingles of five words (fewer words: the whole). A window occurs where all its shingles follow each other, so a
single one is a sufficient prefix at containment one: the rarest over all documents. A window with a shingle that no document
has is out of the race at once. Documents and windows join on the prefix; the prefix's place in the window fixes where the window must
start and end in the document (positional and length bound), and there the words are compared.

Words pass a bitmap of the hashed benchmark shingles before they become rows. Its size follows the number of
shingles up to a fixed bound of 32 MB; beyond that more words pass, with the same result.

Defined results: null or word-less texts have no words, are not contaminated and hold no item; word-less items are skipped;
items without an id count for hits but not among the items; equal rows of documents are each reported.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcf.llm.common import NOT_WORD_PATTERN, WORD_BYTES, keyed, match_keys, stored, words_of

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_WORDS = 13
SHINGLE_WORDS = 5
MIN_BITS, MAX_BITS = 20, 28
_MIX = 0x9E3779B97F4A7C15
_STEP = 0x100000001B3


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * np.uint64(_STEP) + each[i : len(words) - k + 1 + i]
    return (total ^ (total >> np.uint64(29))) * np.uint64(_MIX)


def windows(items: DataFrame, window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(window, item_id, n, k): the windows of each item as joined words, n words long, cut into shingles of k words."""
    w = F.col("w")
    rows = items.select(F.col("item_id").alias("item_id"), words_of(F.col("text"), NOT_WORD_PATTERN).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - window_words + 1))
    return rows.select(
        F.explode(F.transform(starts, lambda i: F.array_join(F.slice(w, i, window_words), " "))).alias("window"),
        "item_id", F.least(F.size(w), F.lit(window_words)).alias("n"),
        F.least(F.size(w), F.lit(window_words), F.lit(shingle_words)).alias("k"),
    ).distinct()


def _touched(bits: int):
    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in (_shingle_hashes(text.encode().split(b" "), k) >> np.uint64(64 - bits)).tolist():
                    seen.setdefault(at >> 16, np.zeros(1 << 16, bool))[at & 0xFFFF] = True
        if seen:
            packed = [np.packbits(x).tobytes() for x in seen.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(packed, pa.binary())], ["block", "bits"])

    return run


def _either(pdf):
    """Of one block of the bitmap, at most 8 KB from each task."""
    both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
    return pdf.iloc[:1].assign(bits=[both.tobytes()])


def _bitmap(found: DataFrame, n_shingles: int) -> tuple[int, np.ndarray]:
    bits = min(MAX_BITS, max(MIN_BITS, (64 * max(1, n_shingles) - 1).bit_length()))
    blocks = found.select("window", "k").mapInArrow(_touched(bits), "block long, bits binary")
    full = np.zeros((1 << bits) >> 3, np.uint8)
    for block, packed in blocks.groupBy("block").applyInPandas(_either, "block long, bits binary").collect():  # within 2**MAX_BITS bits
        full[block << 13 : (block + 1) << 13] = np.frombuffer(packed, np.uint8)
    return bits, full


RUNS = "array<struct<k:int,start:int,words:array<string>>>"
_RUNS = pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int32()), ("words", pa.list_(pa.string()))]))


def _scan(shared, bits: int, sizes: tuple[int, ...]):
    def runs_of(words):
        out, bitmap = [], shared.value
        for k in sizes:
            if len(words) < k:
                continue
            at = _shingle_hashes(words, k) >> np.uint64(64 - bits)
            hit = np.flatnonzero((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1)
            if len(hit):
                for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    lo, hi = int(run[0]), int(run[-1]) + k
                    out.append({"k": k, "start": lo, "words": [w.decode("utf-8", "surrogatepass") for w in words[lo:hi]]})
        return out

    def run(batches):
        for batch in batches:
            counts, runs = [], []
            for text in batch.column(3).to_pylist():
                words = _words(text)
                counts.append(len(words))
                runs.append(runs_of(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(runs, _RUNS)],
                ["row", "__llm_id", "__llm_text", "n_words", "runs"],
            )

    return run


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """Per row of documents: key columns, n_words, n_hit, n_items, item_ids (text, sorted)."""
    spark = docs.sparkSession
    found = stored(windows(items, window_words), "windows")
    n_shingles, sizes = found.agg(F.sum(F.col("n") - F.col("k") + 1), F.sort_array(F.collect_set("k"))).first()
    bits, bitmap = _bitmap(found, n_shingles or 0)
    rows, names = keyed(docs)
    schema = f"row long, __llm_id long, __llm_text long, n_words long, runs {RUNS}"
    scan = _scan(spark.sparkContext.broadcast(bitmap), bits, tuple(sizes or ()))
    scanned = stored(rows.select(F.monotonically_increasing_id().alias("row"), *names, "text").mapInArrow(scan, schema), "scanned")

    # each place of a benchmark shingle, with as many words around it as a window can take
    place = F.explode(F.sequence(F.lit(1), F.size("r.words") - F.col("r.k") + 1)).alias("i")
    at = scanned.select("row", F.explode("runs").alias("r")).select("row", "r", place)
    lead = F.least(F.col("i") - 1, F.lit(window_words) - F.col("r.k"))
    places = stored(at.select(
        "row", F.col("r.k").alias("k"), (F.col("r.start") + F.col("i") - 1).alias("at"), lead.alias("lead"),
        F.array_join(F.slice("r.words", F.col("i"), F.col("r.k")), " ").alias("shingle"),
        F.slice("r.words", F.col("i") - lead, lead + window_words).alias("around"),
    ), "places")

    w = F.split("window", " ")
    each = found.select("window", "n", "k").distinct().select(
        "window", "n", "k", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.col("n") - F.col("k") + 1), lambda i: F.array_join(F.slice(w, i, F.col("k")), " "),
        )).alias("offset", "shingle"))
    frequency = places.groupBy("shingle", "k").agg(F.count("*").alias("frequency"))
    ranked = each.join(frequency, ["shingle", "k"], "left").groupBy("window", "n", "k").agg(
        F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "shingle", "offset")).alias("p"))
    prefixes = ranked.where("p.frequency > 0").select("window", "n", "k", "p.shingle", "p.offset")

    meet = places.join(prefixes, ["shingle", "k"]).where("lead >= offset").where("lead - offset + n <= size(around)")
    begin = F.greatest(F.lit(1), F.col("lead") - F.col("offset") + 1)  # conditions may be evaluated in any order
    same = meet.where(F.array_join(F.slice("around", begin, F.col("n")), " ") == F.col("window"))
    hits = stored(same.select("row", "window", "n", (F.col("at") - F.col("offset")).alias("start")), "hits")

    earlier = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    spans = hits.groupBy("row", "start").agg(F.max("n").alias("n"))
    covered = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0)))))
    n_hit = covered.groupBy("row").agg(F.sum("new").alias("n_hit"))
    of_item = hits.select("row", "window").distinct().join(found.select("window", "item_id"), "window")
    names_of = of_item.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return (
        scanned.select("row", *names, "n_words").join(n_hit, "row", "left").join(names_of, "row", "left")
        .select(*names, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.size(F.coalesce("item_ids", F.array().cast("array<string>"))).cast("long").alias("n_items"),
                F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are not contaminated, columns unchanged."""
    rows, names = keyed(docs)
    bad = stored(contamination(docs, items).where("contaminated").select(*names).distinct(), "contaminated")
    return match_keys(rows, bad, names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
