"""Token sequences of bounded size from documents, packed by best-fit decreasing.

A document's ids, followed by an end id, are cut into full windows and a rest. The pieces are placed from the longest to the
shortest, each into the open window that it fits most tightly; a segment tree over remaining capacities finds that
window, and a new one is opened if there is none.

Pieces of equal length are interchangeable, so the placement needs only the number of pieces of each length, at most ``size``
numbers whatever the corpus, and windows with the same contents are kept as one range of numbers. The plan that
comes of it (``plan``) is the same as that of placing all pieces of the corpus one by one, and is bounded too. Every piece
then finds its place by itself: its rank among the pieces of its length is a running number within its task plus
the sum over the tasks before, and the plan says which ranks go where. No piece passes through the driver or a single task.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are documents of their own; equal
lengths are ranked by task and place within it; a text of any length is encoded whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import deque
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcf.llm.common import stored, text_groups

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE, END_ID = 1024, 0
#: Bytes of text whose pieces are handed on together. A longer text is handed on by itself.
GROUP_BYTES = 1 << 20
#: Beyond these characters, classes of letters may differ between libraries; such texts are left to the tokenizer itself.
_OTHER_CHARACTER = re.compile("[^\x00-\u024f]")
_ADJACENT_SPACES = re.compile(r"\s\s")
#: The pre-tokens of byte-level tokenizers of this kind (fixed value), ...
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ... and the same for texts without adjacent white space, up to U+024F: neither look-ahead nor large classes, which take time.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PLAIN_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s"


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The ids of the byte strings of a tokenizer file, if pairs are merged in the order of their ids and nothing else is done to a text."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not (spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"))
    if not plain or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(ids, ids[1:])):
        return None
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(shown)))}
    return {bytes(byte_of[c] for c in t): vocab[t] for t in [*byte_of, *(a + b for a, b in pairs)]}


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; a faster encoder where it gives the same ids as the tokenizer."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer, spec = Tokenizer.from_str(vocabulary), json.loads(vocabulary)
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = _byte_ranks(spec)
        self.quick = ranks is not None
        if ranks:
            import tiktoken

            self.any, self.plain = (tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (_PATTERN, _PLAIN_PATTERN))

    def __call__(self, text: str) -> bytes:
        if not self.quick or _OTHER_CHARACTER.search(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.any if _ADJACENT_SPACES.search(text) else self.plain)(text)
        return array("I", ids).tobytes()


class Capacities:
    """A segment tree over the capacities 0 to ``size``: which have an open window, and the least such one from a value on."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        k = self.leaves + capacity
        self.any[k] = is_open
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def at_least(self, capacity: int) -> int | None:
        k = self.leaves + capacity
        while not self.any[k]:
            while k & 1:  # a right child: what lies to its right hangs on an ancestor
                k //= 2
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k + (not self.any[2 * k])
        return k - self.leaves


class Segment(NamedTuple):
    """Pieces of one length from ``rank`` on: ``each`` a window, at ``offset`` and behind it, in windows from ``first`` on."""

    rank: int
    first: int
    each: int
    offset: int


@dataclass
class _Windows:
    size: int
    number: int = 0
    by_capacity: dict[int, deque] = field(default_factory=dict)

    def __post_init__(self):
        self.tree = Capacities(self.size)

    def put(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.by_capacity.setdefault(capacity, deque()).append((first, count))
            self.tree.mark(capacity, True)

    def take(self, length: int, pieces: int) -> tuple[int, int, int]:
        """(capacity, first, count) of the windows that the next pieces of this length fit most tightly."""
        capacity = self.tree.at_least(length)
        if capacity is None:
            count = -(-pieces // (self.size // length))
            first, self.number = self.number, self.number + count
            return self.size, first, count
        ranges = self.by_capacity[capacity]
        first, count = ranges.popleft()
        if not ranges:
            self.tree.mark(capacity, False)
        return capacity, first, count


def plan(counts: dict[int, int], size: int = SIZE) -> dict[int, list[Segment]]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length into windows of ``size``: per length the segments by rank.

    A window that takes one piece is the tightest for the next of that length as long as it fits, so a window takes all
    the pieces that it can hold before the next window's turn.
    """
    windows, out = _Windows(size), {}
    for length in sorted(counts, reverse=True):
        pieces, rank, segments = counts[length], 0, out.setdefault(length, [])
        while rank < pieces:
            left = pieces - rank
            capacity, first, count = windows.take(length, left)
            each, offset = capacity // length, size - capacity
            full = min(count, left // each)
            segments.append(Segment(rank, first, each, offset))
            windows.put(capacity - each * length, first, full)
            rank += full * each
            if full < count:  # the last pieces fill one window in part; the windows behind it stay as they are
                part = pieces - rank
                windows.put(capacity - part * length, first + full, 1 if part else 0)
                windows.put(capacity, first + full + (part > 0), count - full - (part > 0))
                rank = pieces
    return out


def _encoder(shared, size: int, end_id: int, keep_ids: bool):
    def run(batches):
        kept_encoder = shared.value  # a worker keeps its encoder from task to task
        if "encoder" not in kept_encoder:
            kept_encoder["encoder"] = Encoder(kept_encoder["vocabulary"])
        encoder, end = kept_encoder["encoder"], array("I", [end_id]).tobytes()
        seen, part = [0] * (size + 1), TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(1)
            for a, b in text_groups(texts, GROUP_BYTES):
                pieces, owner, kept = [], [], []
                for k, text in enumerate(texts[a:b].to_pylist(), a):
                    ids = encoder(text or "") + end
                    for at in range(0, len(ids), 4 * size):
                        cut = ids[at:at + 4 * size]
                        n = len(cut) // 4
                        pieces.append((at // 4, n, zlib.crc32(cut), len(ids) // 4, part, seen[n]))
                        seen[n] += 1
                        owner.append(k)
                        if keep_ids:
                            kept.append(np.frombuffer(cut, "<u4").astype(np.int32))
                columns = [pa.array(c, pa.int64()) for c in zip(*pieces)]
                names = ["start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], ["doc_id", *names])

    return run


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, nth[, ids]): full windows and rests, numbered within task and length.

    ``vocabulary`` is the text of a tokenizer file.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long" + (", ids array<int>" if keep_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary})
    return rows.mapInArrow(_encoder(shared, size, end_id, keep_ids), schema)


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Stored pieces with sequence_id and offset in place of part and nth."""
    spark = cut.sparkSession
    counted = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    segments = spark.createDataFrame([(n, s) for n, s in plan(counts, size).items()],
                                     "length long, segments array<struct<rank: long, first: long, each: long, offset: long>>")
    ranked = cut.join(earlier, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    found = ranked.join(segments, "length").withColumn(
        "s", F.element_at(F.filter("segments", lambda s: s["rank"] <= F.col("rank")), -1))
    step = F.col("rank") - F.col("s.rank")
    return found.withColumns({
        "sequence_id": F.col("s.first") + F.expr("(rank - s.rank) div s.each"),
        "offset": F.col("s.offset") + step % F.col("s.each") * F.col("length"),
    }).select(*[c for c in cut.columns if c not in ("part", "nth")], "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece of the documents."""
    return place(stored(pieces(docs, vocabulary, size, end_id, keep_ids), "pieces"), size)


def padded_size(tokens: int, size: int = SIZE) -> int:
    """Sequences are padded to ``size``, except at a power of two."""
    return tokens if tokens & (tokens - 1) == 0 else size


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_tokens, ids): pieces with ids joined in order and padded."""
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    power = F.bit_count("n_tokens") == 1
    missing = F.when(power, 0).otherwise(size - F.col("n_tokens")).cast("int")
    return whole.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), missing)))
