"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams (word ends marked), each hashed to a row of an embedding
table, and its vector is the average of the bag; a document is the average over its words, repeats included; a softmax over two classes follows.
Table and softmax are trained together on a bounded sample of labelled rows. A word that never occurred in training still shares n-grams with
those that did, so misspellings are seen. A group lasso shrinks the vectors of n-grams that tell nothing to zero; without it the many words that
occur in few documents are learnt by heart and drown the telling ones in long texts.

For scoring, table and softmax fold into one number per hashed n-gram (the model is linear in the average), so a word
costs one sum, kept in a bounded memo.

Defined results: empty or null texts get the softmax of the bias alone; labels that are null are not used; with no labels of one of the classes
all scores are the other class's (0.0 without any label). Repeated rows are scored alike. A score of exactly 0.5 counts as toxic.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.llm.common import WORD_BYTES, remainder

# Ship the task-side functions with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of the classes that training takes, the least by a hash of doc_id. Bounds what the driver holds.
TOXIC_SAMPLE, OTHER_SAMPLE = 1500, 3000
BUCKET_BITS = 20
DIMENSIONS = 8
#: Words without meaning in every average, so that very short texts stay near the prior.
PAD = 20
NGRAMS = (3, 4, 5, 6)
#: A bucket gets a vector if it occurs in one of this many training documents, and in LEAST_ROWS at least.
ONE_IN, LEAST_ROWS = 80, 3
#: Mini-batches seen in training; small samples are gone through more often.
STEPS = 900
BATCH = 50
RATE = 0.005
#: What each step takes from the length of every vector, as a share of RATE.
SHRINK = 0.9
MEMO_WORDS = 400_000


def _features(word: bytes) -> list[int]:
    """Bucket numbers of a word: itself and its n-grams between end marks."""
    marked, mask, crc = b"<" + word + b">", (1 << BUCKET_BITS) - 1, zlib.crc32
    out = [crc(marked) & mask]
    for n in NGRAMS:
        out += [crc(marked[i:i + n], n) & mask for i in range(len(marked) - n + 1)]
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Model:
    """weight: one number per bucket; the logit of a document is bias + the padded mean over its words of their buckets' means."""

    weight: np.ndarray
    bias: float


def _rows(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per document its buckets and their shares of it."""
    memo: dict[bytes, np.ndarray] = {}
    buckets, shares = [], []
    for text in texts:
        bags, parts, n_words = [np.zeros(0, np.int32)], [np.zeros(0)], 0
        for w, n in sorted(Counter(_words(text)).items()):
            if w not in memo:
                memo[w] = np.array(_features(w), np.int32)
            bags.append(memo[w])
            parts.append(np.full(len(memo[w]), n / len(memo[w])))
            n_words += n
        found, at = np.unique(np.concatenate(bags), return_inverse=True)
        buckets.append(found)
        shares.append((np.bincount(at, np.concatenate(parts), len(found)) / (PAD + n_words)).astype(np.float32))
    return buckets, shares


def _number_frequent(buckets: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """Takes rare buckets out of the documents and numbers the others anew, document by document in place; returns what stays."""
    n_docs = np.zeros(1 << BUCKET_BITS, np.int32)
    for found in buckets:
        n_docs[found] += 1
    stays = n_docs >= max(LEAST_ROWS, len(buckets) / ONE_IN)
    number = np.cumsum(stays, dtype=np.int32) - 1
    for i, found in enumerate(buckets):
        kept = stays[found]
        buckets[i], shares[i] = number[found[kept]], shares[i][kept]
    return np.flatnonzero(stays)


def fit(texts: list[str | None], toxic: list[int], seed: int = 7) -> Model:
    """Embedding table and softmax, trained together with Adam on mini-batches in which both classes weigh alike.

    Of a class with fewer than LEAST_ROWS rows no n-gram of its own has a vector; weighed up it would only shift the bias, so rows weigh alike then.
    The average and the softmax are linear, so the gradient of a bucket's embedding is one number times the
    difference of the two class vectors; it is summed per bucket first and spread over the dimensions afterwards.
    After each step every embedding is shortened by the same length, to zero if it is shorter.
    """
    weight, y = np.zeros(1 << BUCKET_BITS, np.float32), np.array(toxic, np.float32)
    if len(set(toxic)) < 2:
        return Model(weight, 50.0 if toxic and toxic[0] else -50.0)
    rng = np.random.default_rng(seed)
    buckets, shares = _rows(texts)
    names = _number_frequent(buckets, shares)
    n_toxic, n_other = int((y == 1).sum()), int((y == 0).sum())
    size, class_weight = len(names), np.where(y == 1, n_other / n_toxic if min(n_toxic, n_other) >= LEAST_ROWS else 1.0, 1.0)
    table = np.zeros((size, DIMENSIONS), np.float32)
    # a bucket's part in a mean of hundreds of features is small; the softmax starts and learns on that scale
    soft, bias, gain = rng.normal(0, 0.3, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32), np.float32(30.0)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    step = 0
    for _ in range(-(-STEPS * BATCH // len(y))):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo:lo + BATCH]
            doc = np.repeat(np.arange(len(pick)), [len(buckets[i]) for i in pick])
            b, s = np.concatenate([buckets[i] for i in pick]), np.concatenate([shares[i] for i in pick]) * gain
            mean = np.stack([np.bincount(doc, s * table[b, d], len(pick)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            logit = mean @ soft.T + bias
            p = 1 / (1 + np.exp(np.clip(logit[:, 0] - logit[:, 1], -50, 50)))
            err = ((p - y[pick]) * class_weight[pick] / len(pick)).astype(np.float32)
            pull = np.bincount(b, s * err[doc], size).astype(np.float32)
            side = err @ mean
            grads = (np.outer(pull, soft[1] - soft[0]), np.stack([-side, side]), np.array([-err.sum(), err.sum()]))
            step += 1
            for x, g, (m, v) in zip((table, soft, bias), grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            length = np.sqrt((table * table).sum(1, keepdims=True))
            table *= np.maximum(0, 1 - RATE * SHRINK / np.maximum(length, 1e-9)).astype(np.float32)
    weight[names] = gain * (table @ (soft[1] - soft[0]))
    return Model(weight, float(bias[1] - bias[0]))


def fit_from(docs: DataFrame, labels: DataFrame, held_out_fold: int | None = 0) -> Model:
    """Fit on at most TOXIC_SAMPLE and OTHER_SAMPLE labelled documents of the two classes outside the held-out fold.

    The classes are nearer to balance than in the corpus, so that few toxic rows suffice.
    """
    known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out_fold is not None:
        known = known.where(remainder(F.col("doc_id")) != held_out_fold)
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.struct(F.xxhash64("doc_id"), "doc_id")
    picked = None
    for kind in (0, 1):
        part = there.where(F.col("toxic") == kind).orderBy(order).limit(TOXIC_SAMPLE if kind else OTHER_SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("doc_id").collect()  # the two samples
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def _broadcast(df: DataFrame, model: Model):
    """The model as plain values, without the buckets of weight zero; a worker keeps its memo beside them from task to task."""
    used = np.flatnonzero(model.weight)
    weight = dict(zip(used.tolist(), model.weight[used].astype(np.float64).tolist()))
    return df.sparkSession.sparkContext.broadcast({"weight": weight, "bias": model.bias, "memo": {}})


def _scorer(shared):
    weight, bias, memo = shared.value["weight"].get, shared.value["bias"], shared.value["memo"]

    def score(text: str | None) -> float:
        total, words = 0.0, _words(text)
        for w, n in sorted(Counter(words).items()):
            known = memo.get(w)
            if known is None:
                f = _features(w)
                known = sum([weight(i, 0.0) for i in f]) / len(f)
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                memo[w] = known
            total += n * known
        return 1 / (1 + float(np.exp(-np.clip(bias + total / (PAD + len(words)), -500, 500))))

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row."""
    shared = _broadcast(docs, model)

    def run(batches):
        score = _scorer(shared)
        for batch in batches:
            got = pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_harmless(docs: DataFrame, model: Model) -> DataFrame:
    """Documents that score below one half, columns unchanged."""
    shared = _broadcast(docs, model)
    at = docs.columns.index("text")

    def run(batches):
        score = _scorer(shared)
        for batch in batches:
            yield batch.filter(pc.less(pa.array([score(t) for t in batch.column(at).to_pylist()], pa.float64()), 0.5))

    return docs.mapInArrow(run, docs.schema)
