"""Runs of words that repeat with a period, found by an online sparse diagonal DP, and texts without their repeats.

On the diagonal of lag q, word i matches if it equals word i - q. A run of period q is a maximal stretch whose words
match on that diagonal; its length is the match length plus q. Word by word, earlier occurrences of the word would
increment the match length of their lag, and a diagonal that ends with sufficient length would emit its run. For a word
that occurs very often that is quadratic, so only the occurrences that can lie on a sufficient diagonal are
touched, without loss:

- Lags are taken in bands, (2^(m-1), 2^m]. A run of exponent 3 or more goes on for 2^m words or more after its first
  period, so in the band of its period the last 2^m words must match together.
- Among the earlier occurrences of these 2^m words only the latest can lie on the run's diagonal: one at a smaller
  lag would make two rotations of the period equal, so the period would not be the smallest.

Each word thus increments at most one lag per band, and a run's diagonal is an unbroken stretch of words with the
same lag, which ends where the run ends. A stretch of a multiple of the smallest period never forms, as the latest occurrence is
nearer. The words of 2^m places get their numbers from those of 2^(m-1), so the whole takes n log n steps,
and only words whose last 2^(m-1) words occur twice reach band m.

Defined results: a null or blank text has no words and no runs; repeated rows and null ids are rows like any other; texts
of any length are worked on whole, each by itself; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import sys
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcf.llm.common import SPACE_PATTERN, text_groups

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run has this many words at least, and this many times its period.
LEAST_WORDS, EXPONENT = 6, 4
#: Bytes of text worked on together. A longer text is worked on by itself.
GROUP_BYTES = 1 << 21

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _latest(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places ``at`` (ascending) with keys: the distance to the latest place with the same key (0: none), and a
    number for the key (-1: occurs once)."""
    order = np.argsort(keys, kind="stable")
    same = np.concatenate(([False], keys[order[1:]] == keys[order[:-1]]))
    lag, number = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    later = np.flatnonzero(same)
    lag[order[later]] = at[order[later]] - at[order[later - 1]]
    often = same | np.concatenate((same[1:], [False]))
    number[order[often]] = np.cumsum(~same[often])
    return lag, number


def diagonals(codes: np.ndarray, owner: np.ndarray, starts: np.ndarray, least: int = LEAST_WORDS,
              exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, period) of all runs of texts laid end to end: ``codes`` tell words of a text apart, ``owner`` is the
    text of each word, ``starts`` the first word of each text and, last, the number of words."""
    if exponent < 3:
        raise ValueError("runs of exponent 3 or more only")
    found = [(np.zeros(0, np.int64),) * 3]
    sizes = np.diff(starts)
    at, number = np.arange(len(codes)), codes.astype(np.int64)
    keys, width = owner * (number.max(initial=0) + 1) + number, 1
    while len(at):
        lag, now = _latest(keys, at)
        on = (lag <= width) & (lag > width // 2)
        place, q = at[on], lag[on]
        breaks = np.flatnonzero((np.diff(place) != 1) | (np.diff(q) != 0)) + 1
        first = np.concatenate(([0], breaks)).astype(np.int64)[: len(place)]
        last = np.concatenate((breaks, [len(place)])) - 1
        if len(place):
            q = q[first]
            begin, end = place[first] - q - width + 1, place[last] + 1
            enough = end - begin >= np.maximum(least, exponent * q)
            found.append((begin[enough], end[enough], q[enough]))
        # the next band: twice the words, of texts long enough for its smallest lag
        number = np.full(len(codes), -1, np.int64)
        number[at] = now
        mine = owner[at]
        at = at[(now >= 0) & (sizes[mine] >= exponent * (width + 1)) & (at - starts[mine] >= 2 * width - 1)]
        at = at[number[at - width] >= 0]
        keys = number[at - width] * (number.max(initial=0) + 1) + number[at]
        width *= 2
    begin, end, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def _solved(texts: list[bytes], least: int, exponent: int) -> tuple[list, list, list]:
    split = [t.split() for t in texts]  # bytes: blank and the five control characters only
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    codes = pa.array([w for words in split for w in words], pa.large_binary()).dictionary_encode().indices.to_numpy()
    owner = np.repeat(np.arange(len(split)), sizes)
    begin, end, q = diagonals(codes, owner, starts, least, exponent)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, begin + q, 1)
    np.add.at(change, end, -1)
    stays = np.cumsum(change[:-1]) == 0
    mine = owner[begin]
    cuts = np.searchsorted(mine, np.arange(len(split) + 1))
    runs, collapsed = [], []
    for k, words in enumerate(split):
        a, b = cuts[k], cuts[k + 1]
        runs.append([{"start": int(s - starts[k]), "length": int(e - s), "period": int(p)} for s, e, p in zip(begin[a:b], end[a:b], q[a:b])])
        collapsed.append(b" ".join(compress(words, stays[starts[k]:starts[k + 1]].tolist()) if b > a else words))
    return sizes.tolist(), runs, collapsed


def _task(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            for a, b in text_groups(text, GROUP_BYTES):
                sizes, runs, collapsed = _solved([t or b"" for t in text[a:b].to_pylist()], least, exponent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return run


def repeats(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: the runs (start, length, period in words) by start, then period,
    and the text without the words that some run holds after its first period, joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_task(least, exponent), _SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, by the checksum of its id, goes on periodically from a word on; a null id is never chosen."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", SPACE_PATTERN), lambda w: w != "")
    chosen = docs.select(F.col("doc_id"), "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    placed = chosen.withColumns({"a": F.when(n > 0, F.col("g") % n).cast("int"), "n": F.when(n > 0, n).cast("int")})
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    placed = placed.withColumn("p", period)
    tail = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))
    edited = F.when(F.col("n").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " "))
    return placed.select("doc_id", F.coalesce(edited, "text").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and checksums of all runs and of the collapsed text."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div (-best.p)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
