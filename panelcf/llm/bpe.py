"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Text is cut by the pre-token pattern. A pre-token that is a vocabulary entry as a whole is found by a minimal perfect hash
(one slot per entry, one comparison). Any other is merged from its bytes: a doubly linked list of parts and a
heap of neighbouring pairs by rank, so a pre-token of n bytes takes n log n steps however long it is.
The results for frequent pre-tokens stay in a bounded memo in front of both.

Defined results: null counts as the empty text; the empty text has no tokens; rows are independent of each other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from dataclasses import dataclass

import pyarrow as pa
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMO_TOKENS = 600_000
_GOLD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


@dataclass
class PerfectHash:
    """Minimal perfect hash by hash and displace: a small table of shifts sends each key to a slot of its own."""

    shifts: list[int]
    slots: list[bytes]

    @staticmethod
    def _slot(h: int, shift: int, n: int) -> int:
        if shift < 0:
            return -shift - 1
        x = ((h ^ (shift * _GOLD)) * _GOLD) & _MASK
        return (x ^ (x >> 32)) % n

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(n // 3 + 1)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % len(groups)].append((h, key))
        shifts, slots, last = [0] * len(groups), [None] * n, 0
        order = sorted(range(len(groups)), key=lambda g: -len(groups[g]))
        for g in order:
            if len(groups[g]) < 2:
                break
            shift = 1
            while True:
                spots = [cls._slot(h, shift, n) for h, _ in groups[g]]
                if len(set(spots)) == len(spots) and all(slots[s] is None for s in spots):
                    break
                shift += 1
            shifts[g] = shift
            for s, (_, key) in zip(spots, groups[g]):
                slots[s] = key
        for g in order:  # single keys take what is left
            if len(groups[g]) == 1:
                while slots[last] is not None:
                    last += 1
                shifts[g], slots[last] = -last - 1, groups[g][0][1]
        return cls(shifts, slots)

    def find(self, key: bytes) -> int:
        """The slot of a key, or -1 if it is none of the keys."""
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.shifts[h % len(self.shifts)], len(self.slots)) if self.slots else 0
        return s if self.slots and self.slots[s] == key else -1


@dataclass
class Vocabulary:
    pattern: str
    whole: PerfectHash
    ids: list[int]
    ranks: dict[bytes, int]

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file: a line has a token in base64 and its rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        whole = PerfectHash.build(list(ranks))
        return cls(pattern, whole, [ranks[k] for k in whole.slots], ranks)


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids after merging pairs of neighbours, lowest rank first, leftmost first among equals."""
    n = len(token)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i]
        if end[i] == 0 or j >= n or end[j] != stop:  # a part of the pair has grown or gone
            continue
        end[i], end[j], right[i] = stop, 0, right[j]
        if right[j] < n:
            left[right[j]] = i
            k = end[right[j]]
            if (r := ranks.get(token[i:k])) is not None:
                heapq.heappush(heap, (r, i, k))
        if left[i] >= 0 and (r := ranks.get(token[left[i]:stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i:end[i]]])
        i = right[i]
    return out


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.cut = regex.compile(vocabulary.pattern).findall
        self.v = vocabulary
        self.token_of = {i: t for t, i in vocabulary.ranks.items()}
        self.digits_of = {i: str(i) for i in self.token_of}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        slot = self.v.whole.find(raw)
        ids = (self.v.ids[slot],) if slot >= 0 else tuple(merge(raw, self.v.ranks))
        if len(self.memo) >= MEMO_TOKENS:
            self.memo.clear()
        self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out, known = [], self.memo.get
        for piece in self.cut(text or ""):
            out += known(piece) or self._ids(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))

    def digits(self, ids: list[int]) -> str:
        return " ".join(map(self.digits_of.__getitem__, ids))


def _broadcast(df: DataFrame, v: Vocabulary):
    """The vocabulary as plain values; a worker keeps its memo beside them from task to task."""
    return df.sparkSession.sparkContext.broadcast(
        {"pattern": v.pattern, "shifts": v.whole.shifts, "slots": v.whole.slots, "ids": v.ids, "ranks": v.ranks, "memo": {}})


def _codec(shared) -> Codec:
    v = shared.value
    codec = Codec(Vocabulary(v["pattern"], PerfectHash(v["shifts"], v["slots"]), v["ids"], v["ranks"]))
    codec.memo = v["memo"]
    return codec


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) per row."""
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            got = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become replacement characters, a null list the empty text."""
    shared = _broadcast(coded, vocabulary)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            got = [codec.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row the number of ids, and digests of the ids and of what they decode to; encodes and decodes in one pass."""
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            n, coded, back = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                coded.append(hashlib.sha256(codec.digits(ids).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)
