"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end mark. The bytes of a word and the blank behind it are predicted bit by bit. Each predictor
has counts of both bits by a hashed context: the last none to four bytes of the word, and all its bytes so far, each with the state of the text; and
all bytes so far without it. The state is the class of the last word before that tells one; classes (in effect languages) are groups of common words
that stand in the same documents. So a word's bits depend on the word and the state, and the work is done once for each distinct pair,
and in a run of sorted words once for the beginnings that they share.
The predictions are added as log-odds under weights that a gate chooses by how much the longest contexts have seen; the weights
are learned online, one step per small run of words, each word's own occurrence left out of the counts. A last stage
refines the mixed probability by adaptive maps: per previous byte and probability step, how often the bit really was one.

Counts, classes, weights and maps come from all words of all training documents: tasks learn weights from their own words, and these
are averaged by the occurrences behind them; counts and maps are added up. The probabilities of all next bytes add up to one,
so the score is a log-probability, and total bits a byte follow from it.

Defined results: a null text counts as empty and has the end mark alone; a null doc_id trains; without training
documents every bit has probability one half; equal rows are scored alike.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.llm.common import remainder, stored, text_groups

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD_OUT = 1
END = b"\n"
#: Orders of the contexts and the bits of their tables; -1 is the word so far, -2 the same without the state.
ORDERS = ((0, 12), (1, 17), (2, 19), (3, 20), (4, 21), (-2, 22), (-1, 22))
#: The most frequent words, at most so many, are looked up in memory; the others meet their scores in a join.
HEAD_WORDS = 1 << 17
#: Bytes of text whose words a task counts together, and of a piece, of which it holds numbers for each byte and word.
TEXT_BYTES, PIECE_BYTES = 16 << 20, 2 << 20
#: Distinct words behind one partial table, and behind the weights of one task.
TABLE_WORDS, LEARN_WORDS = 1_000_000, 400_000
#: Words, in their order, whose bits are worked on together, and in one step of learning.
RUN_WORDS, STEP_WORDS = 4000, 500
#: The most frequent words, and the groups to begin with, of which classes are made.
COMMON_WORDS, GROUPS = 400, 8
#: Common words that a text of a class has at least.
LEAST_COMMON = 8
#: A word that tells a class is at least one in so many words.
LEAST_PART = 150_000
PRIOR = 0.1
BLOCK = 1 << 15
GATES, STEPS = 25, 33
#: Numbers that a learner finds: weights and their mass, hits and tries of the maps.
LEARNED = GATES * (len(ORDERS) + 1) + 2 * 257 * STEPS
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_OFFSETS = np.cumsum([0] + [1 << b for _, b in ORDERS])
SLOTS = int(_OFFSETS[-1])
_SHIFT = np.arange(8, dtype=np.uint8)
#: A-Z become a-z, ASCII white space becomes blanks.
_PLAIN = np.array([b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256)], np.uint8)


def words_of(text: str | None) -> list[bytes]:
    """Words cut at ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each value begins and the last one ends."""
    _, at, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    at = np.frombuffer(at, np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


@dataclass
class Tokens:
    words: pa.Array  # distinct ones, the end mark last
    ids: np.ndarray  # of all texts, one after the other
    n: np.ndarray  # per text, with the end mark
    n_bytes: np.ndarray  # per text: its words and a byte behind each and for the end

    def text(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def found_in(self, words: pa.Array) -> np.ndarray:
        """The place in ``words`` of each distinct word, or -1."""
        return pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False)


def tokens_of(texts: pa.Array) -> Tokens:
    """The words of many texts (``words_of``) and their end marks."""
    data, at = _bytes_of(pc.fill_null(texts, ""))
    data = _PLAIN[data]
    inside = data != 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = at[:-1][at[:-1] < len(data)]
    first[begin] = inside[begin]
    spelled = data[inside]
    cuts = np.append(np.flatnonzero(first[inside]), len(spelled))
    words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(spelled)]).dictionary_encode()
    upto = np.searchsorted(np.flatnonzero(first), at)
    n = np.diff(upto) + 1
    ends = np.cumsum(n) - 1
    ids = np.full(len(cuts) - 1 + len(n), len(words.dictionary), np.int64)
    within = np.ones(len(ids), bool)
    within[ends] = False
    ids[within] = words.indices.to_numpy()
    return Tokens(pa.concat_arrays([words.dictionary, pa.array([END], pa.binary())]), ids, n, np.diff(cuts[upto]) + n)


def _pieces(texts: pa.Array) -> Iterator[tuple[slice, Tokens]]:
    """Texts of about PIECE_BYTES together: their tokens and what follows from these take many times the bytes."""
    for lo, hi in text_groups(texts, PIECE_BYTES):
        yield slice(lo, hi), tokens_of(texts[lo:hi])


def _groups(texts: pa.Array, found) -> Iterator[tuple[pa.Array, list]]:
    """Of texts of about TEXT_BYTES together: the distinct words, and for each piece the places there of its words and
    what ``found`` gives for its rows and tokens."""
    for lo, hi in text_groups(texts, TEXT_BYTES):
        words, out = [], []
        for rows, tokens in _pieces(texts[lo:hi]):
            words.append(tokens.words)
            out.append(found(slice(lo + rows.start, lo + rows.stop), tokens))
        joined = pa.concat_arrays(words).dictionary_encode()
        places = np.split(joined.indices.to_numpy(), np.cumsum([len(w) for w in words])[:-1])
        yield joined.dictionary, list(zip(places, out))


def _commons(tokens: Tokens, common: pa.Array) -> np.ndarray:
    """Which texts have which common words: 0 or 1."""
    place = tokens.found_in(common)[tokens.ids]
    has = np.zeros((len(tokens.n), len(common)), np.float32)
    has[tokens.text()[place >= 0], place[place >= 0]] = 1
    return has


def _together(tokens: Tokens, common: pa.Array) -> np.ndarray:
    """In how many texts two common words both stand."""
    has = _commons(tokens, common)
    return (has.T @ has).astype(np.int64)


def _centres(together: np.ndarray) -> np.ndarray:
    """A vector over the common words for each class. ``together``: in how many documents two of the words both stand.

    Words are grouped by the words beside which they stand (k-means on the sphere, begun with words far apart); the groups with
    the most similar centres are joined as long as these are similar. Groups of fewer than LEAST_COMMON words make no class.
    """
    often = np.diag(together).copy()
    x = (together.astype(float) - np.diag(often)) / np.sqrt(np.maximum(1, often))
    length = np.linalg.norm(x, axis=1)
    x = x[(often > 1) & (length > 0)] / length[(often > 1) & (length > 0), None]
    if not len(x):
        return np.zeros((0, len(together)))
    centres = [x[int((x @ x.mean(0)).argmax())]]
    while len(centres) < min(GROUPS, len(x)):
        centres.append(x[int((x @ np.stack(centres).T).max(1).argmin())])
    centre = np.stack(centres)
    for _ in range(12):
        group = (x @ centre.T).argmax(1)
        centre = np.stack([x[group == k].mean(0) if (group == k).any() else centre[k] for k in range(len(centre))])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    while True:
        names = np.unique(group)
        centre = np.stack([x[group == k].sum(0) for k in names])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
        like = np.triu(centre @ centre.T, 1)
        i, j = np.unravel_index(like.argmax(), like.shape)
        if like[i, j] <= 0.5:
            return centre[[(group == k).sum() >= LEAST_COMMON for k in names]]
        group[group == names[j]] = names[i]


def _by_class(tokens: Tokens, common: pa.Array, centre: np.ndarray, words: pa.Array) -> np.ndarray:
    """How often each of ``words`` stands in texts of each class; texts with fewer than LEAST_COMMON common words have none."""
    has = _commons(tokens, common)
    of = np.where(has.sum(1) >= LEAST_COMMON, (has @ centre.T).argmax(1), -1)[tokens.text()]
    place = tokens.found_in(words)[tokens.ids]
    here = (of >= 0) & (place >= 0)
    return np.bincount(place[here] * len(centre) + of[here], minlength=len(words) * len(centre)).reshape(-1, len(centre))


def _telling(words: list[bytes], n: np.ndarray, least: float) -> dict[bytes, int]:
    """Words that tell a class, with it from 1 on: at least nine in ten of their occurrences are in it."""
    total = n.sum(1)
    at = np.flatnonzero((total >= max(4, least)) & (n.max(1, initial=0) >= 0.9 * total))
    return {words[i]: int(n[i].argmax()) + 1 for i in at}


def _ranked(counted: Iterable[tuple[bytes, int]]) -> list[bytes]:
    """Words without the end mark, the most frequent first."""
    return [w for w, _ in sorted(counted, key=lambda x: (-x[1], x[0])) if w != END]


def find_classes(texts: list[str | None]) -> dict[bytes, int]:
    """The classes of a few texts."""
    tokens = tokens_of(pa.array(texts, pa.string()))
    words = _ranked(zip(tokens.words.to_pylist(), np.bincount(tokens.ids, minlength=len(tokens.words)).tolist()))
    common = pa.array(words[:COMMON_WORDS], pa.binary())
    centre = _centres(_together(tokens, common))
    return _telling(words, _by_class(tokens, common, centre, pa.array(words, pa.binary())), 0) if len(centre) else {}


def _states(told: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The state before each token: what the last one in its text that tells a class has told. ``n``: tokens per text."""
    last = np.maximum.accumulate(np.where(told > 0, np.arange(len(told)), -1))
    before = np.concatenate(([-1], last[:-1]))[:len(told)]
    return np.where(before >= np.repeat(np.cumsum(n) - n, n), told[before], 0)


def _told(tokens: Tokens, classes: dict[bytes, int]) -> np.ndarray:
    """The class that each token tells, or 0."""
    return np.array([*classes.values(), 0], np.int64)[tokens.found_in(pa.array([*classes], pa.binary()))][tokens.ids]


def by_state(words: list[bytes], classes: dict[bytes, int]) -> list[tuple[int, list[bytes]]]:
    """Runs of a text's words with the state before each of them."""
    states = _states(np.array([classes.get(w, 0) for w in words], np.int64), np.array([len(words)]))
    cuts = [0, *(np.flatnonzero(np.diff(states)) + 1).tolist(), len(words)]
    return [(int(states[a]), words[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def _contexts(words):
    """Of all bytes to predict: the byte, its place in the word, where each word starts, the words' lengths and states,
    the hashed contexts by order, and the byte before.

    A word has its state as a byte in front.
    """
    spelled, at = _bytes_of(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))
    lengths, state = np.diff(at), spelled[at[:-1]].astype(np.uint64)
    data = np.roll(spelled, -1)
    data[at[1:] - 1] = 0x20
    ends = np.flatnonzero((lengths == 2) & (data[at[:-1]] == END[0]))
    data = np.delete(data, at[ends] + 1)
    lengths[ends] = 1
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    before, hashes = [], []
    for j in range(1, 5):
        before.append(np.where(place >= j, np.roll(data, j).astype(np.uint64) + np.uint64(1), np.uint64(0)))
    so_far = np.full(len(data), 7, np.uint64)
    for p in range(1, int(lengths.max(initial=0))):
        at = starts[lengths > p] + p
        so_far[at] = (so_far[at - 1] * _STEP) + data[at - 1].astype(np.uint64) + np.uint64(1)
    of_state = np.repeat(state, lengths) * np.uint64(0xA24BAED4963EE407)
    for order, _ in ORDERS:
        h = np.full(len(data), order + 11, np.uint64)
        for j in range(max(0, order)):
            h = h * _STEP + before[j]
        hashes.append(so_far if order == -2 else (so_far if order == -1 else h) + of_state)
    return data, place, starts, lengths, state, hashes, before[0].astype(np.int64)


def _slots(data: np.ndarray, hashes: list[np.ndarray]):
    """Table slots (byte, bit, order) and bits."""
    node = ((256 | data.astype(np.uint64))[:, None] >> (np.uint64(8) - _SHIFT.astype(np.uint64))[None, :]) * np.uint64(0xD6E8FEB86659FD93)
    slots = np.empty((len(ORDERS), len(data), 8), np.int32)
    for k, ((_, bits), h) in enumerate(zip(ORDERS, hashes)):
        x = ((h * _MIX)[:, None] ^ node) * _MIX
        slots[k] = (x >> np.uint64(64 - bits)).astype(np.int32) + np.int32(_OFFSETS[k])
    return np.moveaxis(slots, 0, 2), (data[:, None] >> (7 - _SHIFT)[None, :]) & 1


def _events(words):
    """Of all bytes to predict: table slots (byte, bit, order), the bits, the previous byte, and where each word starts."""
    data, _, starts, lengths, _, hashes, previous = _contexts(words)
    return *_slots(data, hashes), previous, starts, lengths


def _shared_events(words):
    """As ``_events``, but bytes of a beginning that a word shares with the one before it come once; behind the previous
    byte, for each byte of the words, which one is meant."""
    data, place, starts, lengths, state, hashes, previous = _contexts(words)
    of = np.repeat(np.arange(len(lengths)), lengths)
    ago = np.maximum(of - 1, 0)
    with_last = (of > 0) & (state[of] == state[ago]) & (place < lengths[ago])
    alike = with_last & (data[np.where(with_last, starts[ago] + place, 0)] == data)
    new = place >= np.minimum.reduceat(np.where(alike, len(data), place), starts)[of]
    order = np.argsort(place.astype(np.uint16) if len(data) <= 1 << 16 else place, kind="stable")
    meant = np.empty(len(data), np.int64)
    meant[order] = np.cumsum(new[order]) - 1
    kept = order[new[order]]
    return *_slots(data[kept], [h[kept] for h in hashes]), previous[kept], meant, starts, lengths


def _weighed(meant: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each shared byte occurs."""
    return np.bincount(meant, np.repeat(times, lengths)).astype(np.float32)


def _seen(n: np.ndarray) -> np.ndarray:
    """Steps of how much a context has seen: 0, 1, 2-4, 5-24, more."""
    return np.searchsorted(np.array([0.5, 1.5, 4.5, 24.5]), n).astype(np.uint8)


def _logit(ones, zeros):
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))).astype(np.float32)


def _short(x: np.ndarray) -> np.ndarray:
    """The upper half of 32-bit floats: counts are exact up to 256, then to 0.4 %."""
    return ((x.view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16)


def _long(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(16)).view(np.float32)


@dataclass
class Mixer:
    logit: np.ndarray  # by slot
    seen: np.ndarray  # by slot
    weights: np.ndarray  # gate, order
    maps: np.ndarray  # previous byte, step: log-odds

    @staticmethod
    def _squash(x):
        return 1 / (1 + np.exp(-np.clip(x, -20, 20)))

    @staticmethod
    def _steps(x):
        at = (np.clip(x, -15.99, 15.99) + 16) * ((STEPS - 1) / 32)
        low = at.astype(np.int64)
        return low, (at - low).astype(np.float32)

    def refined(self, x, previous):
        low, part = self._steps(x)
        m = self.maps[previous[:, None], low] * (1 - part) + self.maps[previous[:, None], low + 1] * part
        return self._squash((x + m) / 2)

    def log10(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The log10 probability of each word with the blank behind it, or of the end mark."""
        if not len(words):
            return np.zeros(0)
        slots, bit, previous, meant, starts, _ = _shared_events(words)
        gate = self.seen[slots[:, :, -1]].astype(np.int64) * 5 + self.seen[slots[:, :, -3]]
        x = sum(self.logit[slots[:, :, k]].astype(np.float32) * self.weights[:, k][gate] for k in range(len(ORDERS)))
        p = self.refined(x, previous)
        return np.add.reduceat(np.log10(np.where(bit == 1, p, 1 - p)).sum(1)[meant], starts)


class Learner:
    """Weights learned online from runs of words, and what the maps are made of; those of several learners can be put together."""

    def __init__(self, counts: np.ndarray, rate: float = 0.3):
        """``counts``: zeros and ones by slot, short."""
        self.pairs, self.rate = np.ascontiguousarray(counts).view(np.uint32).ravel(), rate
        self.weights = np.full((GATES, len(ORDERS)), 0.3, np.float32)
        self.speed, self.mass = np.full((GATES, 1), 1e-8), np.zeros(GATES)
        self.hits, self.tries = np.zeros((257, STEPS)), np.zeros((257, STEPS))

    def step(self, words: list[bytes] | pa.Array, times: np.ndarray) -> None:
        slots, bit, previous, meant, _, lengths = _shared_events(words)
        share = _weighed(meant, lengths, times)[:, None]
        logits, seen = [], []
        for k in range(len(ORDERS)):
            pair = self.pairs[slots[:, :, k]]  # the lower half has the zeros, on machines that store it first
            ones = np.maximum((pair & np.uint32(0xFFFF0000)).view(np.float32) - bit, 0)
            zeros = np.maximum((pair << np.uint32(16)).view(np.float32) - (1 - bit), 0)
            logits.append(_logit(ones, zeros))
            seen.append(_seen(ones + zeros) if k in (len(ORDERS) - 1, len(ORDERS) - 3) else None)
        gate = seen[-1].astype(np.int64) * 5 + seen[-3]
        x = sum(z * self.weights[:, k][gate] for k, z in enumerate(logits))
        err = (bit - Mixer._squash(x)) * share
        step = np.stack([np.bincount(gate.ravel(), (err * z).ravel(), GATES) for z in logits], 1)
        self.speed += (step**2).sum(1, keepdims=True)
        self.weights += (self.rate * step / np.sqrt(self.speed)).astype(np.float32)
        near = np.broadcast_to(share, bit.shape).ravel()
        self.mass += np.bincount(gate.ravel(), near, GATES)
        low, part = Mixer._steps(x)
        key = np.repeat(previous, 8) * STEPS + (low + (part > 0.5)).ravel()
        self.tries += np.bincount(key, near, 257 * STEPS).reshape(257, STEPS)
        self.hits += np.bincount(key, near * bit.ravel(), 257 * STEPS).reshape(257, STEPS)

    def found(self) -> np.ndarray:
        """All that was learned, to be added up over learners."""
        return np.concatenate([(self.weights * self.mass[:, None]).ravel(), self.mass, self.hits.ravel(), self.tries.ravel()])


def mixer_of(counts: np.ndarray, found: np.ndarray) -> Mixer:
    """``counts``: zeros and ones by slot, short; ``found``: the sum over learners."""
    logit, seen = np.empty(len(counts), np.float16), np.empty(len(counts), np.uint8)
    for lo in range(0, len(counts), 1 << 20):
        part = _long(counts[lo:lo + (1 << 20)])
        logit[lo:lo + len(part)], seen[lo:lo + len(part)] = _logit(part[:, 1], part[:, 0]), _seen(part.sum(1))
    mixer = Mixer(logit, seen, np.full((GATES, len(ORDERS)), 0.3, np.float32),
                  np.tile(((np.arange(STEPS) * 32 / (STEPS - 1)) - 16).astype(np.float32), (257, 1)))
    weights, mass, hits, tries = np.split(found, np.cumsum([GATES * len(ORDERS), GATES, 257 * STEPS]))
    weights, met = weights.reshape(mixer.weights.shape), mass > 0
    mixer.weights[met] = weights[met] / mass[met, None]
    p = (hits.reshape(257, STEPS) + 20 * mixer._squash(mixer.maps)) / (tries.reshape(257, STEPS) + 20)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    mixer.maps = np.log(p / (1 - p)).astype(np.float32)
    return mixer


def learn(counts: np.ndarray, words: list[bytes], times: np.ndarray, batch: int = 200) -> Mixer:
    """Weights and maps from a few words and how often they occur. ``counts``: zeros and ones by slot, short."""
    learner = Learner(counts)
    for lo in range(0, len(words), batch):
        learner.step(words[lo:lo + batch], times[lo:lo + batch])
    return mixer_of(counts, learner.found())


# ---- on Spark -------------------------------------------------------------------------------------------------------


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(remainder(F.col("doc_id")) != HELD_OUT)


def _frequent(batches):
    """Words with their counts, the end mark too; of a group of texts, without those that are too small a part of its words to matter."""
    for batch in batches:
        for words, parts in _groups(batch.column(0), lambda _, tokens: np.bincount(tokens.ids, minlength=len(tokens.words))):
            n = np.zeros(len(words), np.int64)
            for at, part in parts:
                n[at] += part
            some = np.flatnonzero((n * 2 * LEAST_PART >= n.sum()) | pc.equal(words, pa.scalar(END, pa.binary())).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some]), pa.array(np.full(len(some), n.sum()))], ["word", "n", "of"])


def _added_up(texts: DataFrame, found, size: int) -> np.ndarray:
    """The sum over all pieces of ``size`` whole numbers that ``found`` gives for one."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, tokens in _pieces(batch.column(0)):
                total += found(tokens).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    parts = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[parts.column("at").to_numpy()] = parts.column("n").to_numpy()
    return out


def classes_of(docs: DataFrame) -> dict[bytes, int]:
    """The classes of all training documents, and the words that tell them: of those that are at least one in LEAST_PART
    of all words, so these stay few. Their counts by class are exact; the count that ranks them may lack half of that part."""
    texts = _training(docs).select("text")
    counted = texts.mapInArrow(_frequent, "word binary, n long, of long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    counted = stored(counted, "frequent")
    size = (counted.where(F.col("word") == F.lit(END)).select("of").first() or [0])[0]  # of all words: each group has its end marks
    top = counted.where(F.col("n") * (2 * LEAST_PART) >= size).select("word", "n").toArrow()
    words = _ranked(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))
    common, some = pa.array(words[:COMMON_WORDS], pa.binary()), pa.array(words, pa.binary())
    together = _added_up(texts, lambda tokens: _together(tokens, common), len(common) ** 2)
    centre = _centres(together.reshape(len(common), len(common)))
    if not len(centre):
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(some)
    n = _added_up(texts, lambda tokens: _by_class(tokens, common, centre, shared.value), len(some) * len(centre))
    return _telling(words, n.reshape(-1, len(centre)), size / LEAST_PART)


def _key(state: int) -> bytes:
    return bytes([48 + state])


def _count(classes, n_states):
    def counted(trains, tokens):
        size = len(tokens.words)
        pair = tokens.ids * n_states + _states(_told(tokens, classes.value), tokens.n)
        here = (np.bincount(pair, minlength=size * n_states) > 0).reshape(size, n_states) @ (1 << np.arange(n_states))
        n = np.bincount(pair[np.repeat(trains, tokens.n)], minlength=size * n_states).reshape(size, n_states)
        return here.astype(np.int32), n.astype(np.int32)

    def run(batches):
        for batch in batches:
            trains = batch.column(0).to_numpy(zero_copy_only=False)
            for words, parts in _groups(batch.column(1), lambda rows, tokens, trains=trains: counted(trains[rows], tokens)):
                here, n = np.zeros(len(words), np.int64), np.zeros((len(words), n_states), np.int64)
                for at, (part_here, part) in parts:
                    here[at] |= part_here
                    n[at] += part
                yield pa.RecordBatch.from_arrays([words, pa.array(here), *[pa.array(n[:, k].copy()) for k in range(n_states)]],
                                                 ["word", "here", *[f"n{k}" for k in range(n_states)]])

    return run


def word_counts(docs: DataFrame, classes: dict[bytes, int]) -> DataFrame:
    """(key, n, c, first), stored: distinct words by state (key: the state's byte and the word) with their counts in training documents,
    the count of the word in any state, and whether the state is the word's first. Sorted by key within files."""
    rows = docs.select((remainder(F.col("doc_id")) != HELD_OUT).alias("trains"), "text")
    shared, states = docs.sparkSession.sparkContext.broadcast(classes), range(max([0, *classes.values()]) + 1)
    counted = rows.mapInArrow(_count(shared, len(states)), "word binary, here long, " + ", ".join(f"n{k} long" for k in states))
    words = counted.groupBy("word").agg(F.bit_or("here").alias("here"), *[F.sum(f"n{k}").alias(f"n{k}") for k in states])
    per_state = F.filter(F.array(*[
        F.when(F.col("here").bitwiseAND(F.lit(1 << k)) != 0, F.struct(
            F.concat(F.lit(_key(k)), "word").alias("key"), F.col(f"n{k}").alias("n"))) for k in states]), lambda x: x.isNotNull())
    total = sum((F.col(f"n{k}") for k in states[1:]), F.col("n0"))
    keys = words.select(total.alias("c"), F.posexplode(per_state).alias("at", "s"))
    keys = keys.select("s.key", "s.n", "c", (F.col("at") == 0).alias("first"))
    return stored(keys.sortWithinPartitions("key"), "word-counts")


def _tables(batches):
    """One partial table of a task's words, in blocks."""
    table, any_ = np.zeros(2 * SLOTS, np.float32), False
    for batch in batches:
        for lo in range(0, len(batch), RUN_WORDS):
            run = batch.slice(lo, RUN_WORDS)
            slots, bit, _, meant, _, lengths = _shared_events(run.column(0))
            times = np.broadcast_to(_weighed(meant, lengths, run.column(1).to_numpy())[:, None], bit.shape).ravel()
            for k in range(len(ORDERS)):
                np.add.at(table, (slots[:, :, k] * 2 + bit).ravel().astype(np.intp), times)
            any_ = True
    if any_:
        for k in range(0, 2 * SLOTS, BLOCK):
            part = table[k:k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])


def _added(batches):
    """Sums of equal blocks that follow each other, short."""

    def row(at, total):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_short(total).tobytes()], pa.binary())], ["block", "counts"])

    at, total = None, None
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            if block != at:
                if at is not None:
                    yield row(at, total)
                at, total = block, None
            more = np.frombuffer(part.as_py(), np.float32)
            total = more.copy() if total is None else total + more
    if at is not None:
        yield row(at, total)


_BLOCKS = "block long, counts binary"


def fit(counts: DataFrame, n_words: int) -> Mixer:
    """The model of all training words. 2 * SLOTS numbers, the model's fixed size, come to the driver, and what was learned, added up."""
    trained = counts.where("n > 0").select("key", "n")
    parts = trained.coalesce(math.ceil(n_words / TABLE_WORDS) or 1).mapInArrow(_tables, _BLOCKS)
    table = np.zeros(2 * SLOTS, np.uint16)
    for block, part in stored(parts.repartition("block").sortWithinPartitions("block").mapInArrow(_added, _BLOCKS), "tables").toLocalIterator():
        table[block * BLOCK:block * BLOCK + len(part) // 2] = np.frombuffer(part, np.uint16)
    shared = counts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        """Runs of words in random order; their words stay sorted, since they share beginnings."""
        rows = [batch.columns for batch in batches if len(batch)]
        if not rows:
            return
        keys, times = (pa.concat_arrays(x) for x in zip(*rows))
        learner, times = Learner(shared.value.reshape(-1, 2)), times.to_numpy().astype(np.float32)
        for lo in np.random.default_rng(0).permutation(np.arange(0, len(keys), STEP_WORDS)):
            learner.step(keys.slice(lo, STEP_WORDS), times[lo:lo + STEP_WORDS])
        found = learner.found()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["at", "x"])

    parts = trained.coalesce(math.ceil(n_words / LEARN_WORDS) or 1).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    found = np.zeros(LEARNED)
    found[parts.column("at").to_numpy()] = parts.column("x").to_numpy()
    shared.unpersist()
    return mixer_of(table.reshape(-1, 2), found)


def word_scores(counts: DataFrame, mixer: Mixer) -> DataFrame:
    """(key, n, c, lp): the model's log10 probability of each distinct word in its state, stored."""
    shared = counts.sparkSession.sparkContext.broadcast((mixer.logit, mixer.seen, mixer.weights, mixer.maps))

    def run(batches):
        mixer = Mixer(*shared.value)
        for batch in batches:
            words = batch.column(0)
            got = [mixer.log10(words.slice(lo, RUN_WORDS)) for lo in range(0, len(words), RUN_WORDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*got, []]), pa.float64())], ["key", "n", "c", "lp"])

    return stored(counts.select("key", "n", "c").mapInArrow(run, "key binary, n long, c long, lp double"), "word-scores")


_DOC = ("row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, "
        "tail array<struct<key:binary,n:long>>")
_DOC_FIELDS = ("row", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score", "tail")


def _look_up(shared):
    """The sums over the words of each text that are kept in memory, and its other words. ``shared``: classes; by state words, their base and score."""

    def run(batches):
        known_classes, known = shared.value
        fronts = pa.array([_key(k) for k in range(len(known))], pa.binary())
        for batch in batches:
            for rows, tokens in _pieces(batch.column(3)):
                state, text, many = _states(_told(tokens, known_classes), tokens.n), tokens.text(), len(tokens.n)
                places = [tokens.found_in(words) for words, _, _ in known]
                base, lp = (np.stack([x[k][at] for x, at in zip(known, places)])[state, tokens.ids] for k in (1, 2))
                here = ~np.isnan(lp)
                sums = [np.bincount(text[here], x[here], many) for x in (base, lp)]
                rest, times = np.unique((text[~here] * len(known) + state[~here]) * len(tokens.words) + tokens.ids[~here], return_counts=True)
                rest, word = np.divmod(rest, len(tokens.words))
                of, front = np.divmod(rest, len(known))
                keys = pc.binary_join_element_wise(fronts.take(pa.array(front)), tokens.words.take(pa.array(word)), pa.scalar(b"", pa.binary()))
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(many + 1)), pa.int32()),
                                                pa.StructArray.from_arrays([keys, pa.array(times, pa.int64())], ["key", "n"]))
                ints = (tokens.n_bytes, tokens.n, np.bincount(text[here], minlength=many))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k)[rows] for k in range(3)], *[pa.array(c, pa.int64()) for c in ints], *[pa.array(c, pa.float64()) for c in sums], tail],
                    list(_DOC_FIELDS))

    return run


def scores(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    classes = classes_of(docs)
    counts = word_counts(docs, classes)
    n, pairs, v = counts.where("c > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.count(F.when(F.col("first"), 1))).first()
    scored = word_scores(counts, fit(counts, pairs))
    size = n + 0.5 * (v + 1)

    least, held = None, 0  # the least count with at most HEAD_WORDS keys at it or above
    for n_key, many in scored.where("n > 0").groupBy("n").count().orderBy(F.desc("n")).limit(HEAD_WORDS).toLocalIterator():
        if held + many > HEAD_WORDS:
            break
        least, held = n_key, held + many
    top = scored.where(F.lit(False) if least is None else F.col("n") >= least).select(
        F.substring("key", 1, 1).alias("state"), F.substring("key", 2, (1 << 31) - 1).alias("word"), "c", "lp").toArrow()
    head = []
    for k in range(max([0, *classes.values()]) + 1):
        mine = top.filter(pc.equal(top.column("state"), pa.scalar(_key(k), pa.binary())))
        base = np.log10((mine.column("c").to_numpy() + 0.5) / size)
        head.append((mine.column("word").combine_chunks(), np.append(base, np.nan), np.append(mine.column("lp").to_numpy(), np.nan)))
    shared = docs.sparkSession.sparkContext.broadcast((classes, head))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    looked = stored(rows.mapInArrow(_look_up(shared), _DOC), "looked-up")
    tail = looked.select("row", F.explode("tail").alias("t")).select("row", "t.key", "t.n").join(scored.drop("n"), "key")
    rest = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(float(size)))).alias("b"), F.sum(F.col("n") * F.col("lp")).alias("s"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return looked.drop("tail").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "k").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base_score", "b").alias("base_score"), plus("score", "s").alias("score"),
        (-plus("score", "s") * math.log2(10) / F.greatest(F.lit(1), F.col("n_bytes"))).alias("bits_per_byte"))
