import math
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from helpers import SCHEMA, documents, rows

from panelcf.llm import mixing


def brute(data):
    tokens = {i: [*(w.decode() for w in (t or "").encode().lower().split()), None] for i, (_, t, *_) in enumerate(data)}
    fold = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 5 for i, (d, *_) in enumerate(data)}
    c = Counter(w for i, ws in tokens.items() if fold[i] != 1 for w in ws)
    n, v = c.total(), len(c)
    return sorted((str(data[i][0]), fold[i] == 1, len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens.items())


@pytest.mark.parametrize("head", [1 << 18, 5])
def test_base_columns_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(mixing, "HEAD_WORDS", head)
    got = mixing.scores(documents(spark)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute(rows())
    assert all(r["score"] < 0 and math.isfinite(r["bits_per_byte"]) for r in got)


def trained():
    words = Counter(w for d in rows() for w in mixing.words_of(d[1]))
    keys = [b"0" + w for w in words] + [b"0" + mixing.END]
    times = np.array([*words.values(), 20], np.float32)
    counts = np.zeros(2 * mixing.SLOTS, np.float32)
    slots, bit, _, _, lengths = mixing._events(keys)
    np.add.at(counts, (slots * 2 + bit[:, :, None]).ravel(), np.repeat(times, lengths * 8 * len(mixing.ORDERS)))
    return mixing.learn(mixing._short(counts).reshape(-1, 2), keys, times), keys


def test_next_byte_probabilities_add_up_to_one():
    mixer, _ = trained()
    # the words of one byte and the blank: P(byte) * P(blank | byte); take the first byte's part out of all two-byte spellings
    for first in (b"t", b"z"):
        spelled = [b"0" + first + bytes([x]) for x in range(256) if x not in (0x20, 0x0A)]
        data = [k for k in spelled]
        slots, bit, previous, starts, _ = mixing._events(data)
        gate = mixer.seen[slots[:, :, -1]].astype(np.int64) * 5 + mixer.seen[slots[:, :, -3]]
        p = mixer.refined(np.einsum("abk,abk->ab", mixer.logit[slots].astype(np.float32), mixer.weights[gate]), previous)
        byte = np.where(bit == 1, p, 1 - p).prod(1)[starts + 1]
        blank, line = (10 ** mixer.log10([b"0" + first])[0] / 10 ** mixer.log10([b"0" + mixing.END])[0], 0)
        assert 0 < byte.sum() <= 1 + 1e-6 and blank > 0


def test_frequent_words_cost_less_than_strange_ones():
    mixer, _ = trained()
    assert mixer.log10([b"0the"])[0] > mixer.log10([b"0thqxz"])[0] > mixer.log10([b"0qqqqqqqq"])[0]


def test_classes_separate_languages():
    en, fr = "the of and to in is that for it was on are".split(), "le de et la les des en un une du est pour".split()
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(p, 40)) for p in (en, fr) for _ in range(60)]
    got = mixing.find_classes(texts)
    assert len({got[w.encode()] for w in en}) == 1 and len({got[w.encode()] for w in fr}) == 1 and got[b"the"] != got[b"le"]


def test_state_is_causal():
    runs = mixing.by_state([b"x", b"the", b"y", b"le", b"z", mixing.END], {b"the": 1, b"le": 2})
    assert runs == [(0, [b"x", b"the"]), (1, [b"y", b"le"]), (2, [b"z", mixing.END])]


def test_empty_table(spark):
    assert mixing.scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_weights_and_maps_learn_from_every_occurrence(spark, monkeypatch):
    words = [*{w for d in rows() for w in mixing.words_of(d[1])}, mixing.END]
    counts = spark.createDataFrame([(b"0" + w, k % 7) for k, w in enumerate(words)], "key binary, n long").repartition(5).sortWithinPartitions("key")
    monkeypatch.setattr(mixing, "LEARN_WORDS", len(words) // 3)
    monkeypatch.setattr(mixing, "STEP_WORDS", 16)
    seen = []
    monkeypatch.setattr(mixing, "mixer_of", lambda counts, found, make=mixing.mixer_of: seen.append(found) or make(counts, found))
    mixing.fit(counts, len(words))
    bits = sum(8 * (len(w) + (w != mixing.END)) * (k % 7) for k, w in enumerate(words))
    mass = seen[0][mixing.GATES * len(mixing.ORDERS):][:mixing.GATES]
    tries = seen[0][-257 * mixing.STEPS:]
    assert mass.sum() == pytest.approx(bits) and tries.sum() == pytest.approx(bits)


def test_classes_come_from_all_documents(spark, monkeypatch):
    en, fr = "the of and to in is that for it was on are".split(), "le de et la les des en un une du est pour".split()
    rng = np.random.default_rng(2)
    data = [(i, " ".join([*rng.choice(fr if i % 9 == 0 else en, 40), f"w{i % 90}"]), None, None, None, 0, "r") for i in range(2500)]
    learnt = [d[1] for d in data if zlib.crc32(str(d[0]).encode()) % 5 != 1]
    monkeypatch.setattr(mixing, "TEXT_BYTES", 20_000)
    got = mixing.classes_of(documents(spark, data))
    assert got == mixing.find_classes(learnt) and len({got[w.encode()] for w in en}) == len({got[w.encode()] for w in fr}) == 1
    assert got[b"w9"] == got[b"le"] != got[b"the"] == got[b"w10"]


def test_shared_beginnings_change_no_word():
    mixer, keys = trained()
    keys = sorted([*keys, b"1the", b"0the" * 40, b"0th", b"1" + mixing.END, b"0" + "é漢".encode()]) + [b"0the", b"0the", b"0a"]
    slots, bit, previous, starts, _ = mixing._events(keys)
    shared = mixing._shared_events(keys)
    assert len(shared[0]) < len(slots) and (shared[0][shared[3]] == slots).all() and (shared[1][shared[3]] == bit).all()
    assert (shared[2][shared[3]] == previous).all() and (shared[4] == starts).all()
    assert mixer.log10(keys) == pytest.approx(np.concatenate([mixer.log10([k]) for k in keys]))


def test_tokens_of_many_texts_equal_those_of_each():
    texts = [None, "", " \t", "A b\x0bc", "É x\x1cY z", "end", "\n next\n"]
    tokens = mixing.tokens_of(mixing.pa.array(["cut", *texts], mixing.pa.string())[1:])
    words = tokens.words.take(mixing.pa.array(tokens.ids)).to_pylist()
    each = [[*mixing.words_of(t), mixing.END] for t in texts]
    assert words == [w for ws in each for w in ws] and tokens.n.tolist() == [len(ws) for ws in each]
    assert tokens.n_bytes.tolist() == [sum(map(len, ws)) + len(ws) - 1 for ws in each]


def texts_in_one_batch(n, seed=5):
    """(trains, text) with a null, an empty text and words met in all pieces or in one."""
    rng = np.random.default_rng(seed)
    common, rare = [f"c{k}" for k in range(50)], [f"r{k}" for k in range(5000)]
    texts = [" ".join([*rng.choice(common, 300), *rng.choice(rare, 40), f"own{k}"]) for k in range(n - 2)]
    return mixing.pa.RecordBatch.from_pydict({"trains": [k % 5 != 1 for k in range(n)], "text": [*texts[:n // 2], None, "", *texts[n // 2:]]})


def tasks(batch, classes):
    """The functions of the tasks that read texts, each with its batch."""
    words = mixing.pa.array([b"c1", b"c3", b"r9"], mixing.pa.binary())
    head = [(words, np.array([-1.0, -2, -3, np.nan]) - k, np.array([-1.5, -2.5, -3.5, np.nan]) - k) for k in range(3)]
    ids = mixing.pa.array(range(len(batch)))
    rows = mixing.pa.RecordBatch.from_arrays([ids, ids, *batch.columns], ["row", "doc_id", "held_out", "text"])
    return [(mixing._frequent, batch.select(["text"])), (mixing._count(SimpleNamespace(value=classes), 3), batch),
            (mixing._look_up(SimpleNamespace(value=(classes, head))), rows)]


@pytest.mark.parametrize("piece", [1, 7000])
def test_pieces_change_no_count_and_no_sum(monkeypatch, piece):
    jobs = tasks(texts_in_one_batch(60), {b"c1": 1, b"c2": 2, b"r7": 1})

    def found():
        out = [[r | {"tail": sorted(map(str, r.get("tail", [])))} for b in run([batch]) for r in b.to_pylist()] for run, batch in jobs]
        return [sorted(map(str, rows)) for rows in out]

    monkeypatch.setattr(mixing, "LEAST_PART", 500)
    whole = found()
    monkeypatch.setattr(mixing, "PIECE_BYTES", piece)
    assert found() == whole and len(whole[0]) < len(whole[1]) and len(whole[2]) == 60


def test_tasks_hold_numbers_for_a_piece_of_text_at_a_time():
    """Arrays for each byte and word of these 16 MB at once took 132 MB in the first task and 234 MB in the second."""
    batch = texts_in_one_batch(12_000)
    assert 16e6 < batch.column(1).nbytes < mixing.TEXT_BYTES
    for run, rows in tasks(batch, {b"c1": 1, b"c2": 2}):
        tracemalloc.start()
        for _ in run([rows]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6
