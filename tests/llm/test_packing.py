import json
import random
import zlib
from bisect import insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, documents, key, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcf.llm import packing
from panelcf.llm.queries import ENTRIES, piece_vocabulary


def one_by_one(lengths, size):
    """Best-fit decreasing as it is told: sorted open capacities, one piece at a time. The fills, sorted."""
    capacities = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, c in enumerate(capacities) if c >= n), None)
        insort(capacities, (size if k is None else capacities.pop(k)) - n)
    return sorted(size - c for c in capacities)


def laid_out(counts, size):
    """The plan's pieces per window: (offset, length)."""
    windows = defaultdict(list)
    for n, segments in packing.plan(counts, size).items():
        ends = [s.rank for s in segments[1:]] + [counts[n]]
        for s, end in zip(segments, ends):
            for rank in range(s.rank, end):
                step = rank - s.rank
                windows[s.first + step // s.each].append((s.offset + step % s.each * n, n))
    return windows


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 40).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=120))))
def test_plan_equals_one_by_one(case):
    size, lengths = case
    windows = laid_out(Counter(lengths), size)
    assert sorted(windows) == list(range(len(windows)))
    for held in windows.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size
    assert sorted(sum(n for _, n in held) for held in windows.values()) == one_by_one(lengths, size)


def test_tightest_capacity():
    rng = random.Random(1)
    for size in (1, 2, 3, 7, 8, 100):
        tree, marked = packing.Capacities(size), set()
        for _ in range(300):
            c = rng.randint(0, size)
            (marked.discard if c in marked else marked.add)(c)
            tree.mark(c, c in marked)
            ask = rng.randint(0, size)
            assert tree.at_least(ask) == min((m for m in marked if m >= ask), default=None)


def test_plan_stays_small():
    rng = random.Random(2)
    segments = packing.plan({n: rng.randint(1, 10**9) for n in range(1, 1025)})
    assert sum(map(len, segments.values())) < 20_000


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = packing.Encoder(piece_vocabulary())


@pytest.fixture(scope="module")
def tokenizer():
    return TOKENIZER


ODD = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n\n b c", "a\u00a0b c", "a\u3000 b", "a \u2028b", "a\x1c b", "it's we 'll do n't", "1 23  456 7",
       "x<|endoftext|> <|endoftext|>y", "漢字 かな", "\t\ta b", "é è\u0301 \U0001f600 \U0001f600", "a\r\n b", "\x00 \x00a"]


@settings(max_examples=1000, deadline=None)
@given(text=st.one_of(st.sampled_from(ODD), st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\u00a0\u2003'sdé1漢-ab"), st.characters(max_codepoint=0x24F)), max_size=30)))
def test_ids_are_the_tokenizers(text):
    assert ENCODER(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_character_of_the_plain_pattern():
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f"a {c} 1{c}2", f".{c}.", f"'{c}{c}"):
            assert ENCODER(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_token_and_other_tokenizers():
    """Each entry of the vocabulary as a text; a file of another kind is left to the tokenizer."""
    spec = json.loads(piece_vocabulary())
    for t in list(spec["model"]["vocab"])[::7]:
        text = TOKENIZER.decode([spec["model"]["vocab"][t]], skip_special_tokens=False)
        assert ENCODER(text) == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        other = f.read()
    encoder = packing.Encoder(other)
    assert not encoder.quick
    assert encoder("Some  words\n here") == np.array(Tokenizer.from_str(other).encode("Some  words\n here", add_special_tokens=False).ids, "<u4").tobytes()


def check(data, got, tokenizer, size=1024):
    """Every id in exactly one piece, sequences gapless; the fills are those of one-by-one packing."""
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        per_doc[r.doc_id].append(r)
        per_sequence[r.sequence_id].append((r.offset, r.length))
    want, lengths = defaultdict(Counter), []
    for row in data:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), size):
            cut = ids[a:a + size]
            want[row[0]][a, len(cut), zlib.crc32(cut.tobytes()), len(ids)] += 1
            lengths.append(len(cut))
    assert {d: Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rs) for d, rs in per_doc.items()} == want
    assert sorted(per_sequence) == list(range(len(per_sequence)))
    for held in per_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size
    assert sorted(sum(n for _, n in held) for held in per_sequence.values()) == one_by_one(lengths, size)


def test_query_packs_everything(spark, tmp_path, tokenizer):
    """Nulls, empty and very long texts, repeated rows, clashing columns, many partitions."""
    data = rows() * 3
    documents(spark, data).withColumn("length", F.lit("x")).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    check(data, ENTRIES["op12_packing"].run(spark, str(tmp_path)).collect(), tokenizer)


def test_sequences_hold_the_ids(spark, tokenizer):
    data = rows()[:40]
    packed = packing.pack(documents(spark, data), piece_vocabulary(), size=64, keep_ids=True)
    made = {r.sequence_id: r for r in packing.sequences(packed, 64).collect()}
    assert all(len(r.ids) == packing.padded_size(r.n_tokens, 64) and not any(r.ids[r.n_tokens:]) for r in made.values())
    again = defaultdict(dict)
    for r in packed.collect():
        again[r.doc_id][r.start] = made[r.sequence_id].ids[r.offset:r.offset + r.length]
    want = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in data}
    assert {d: [i for _, ids in sorted(cuts.items()) for i in ids] for d, cuts in again.items()} == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert ENTRIES["op12_packing"].run(spark, str(tmp_path)).collect() == []
