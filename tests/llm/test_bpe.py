import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import SCHEMA, documents, key, rows

from panelcf.llm import bpe
from panelcf.llm.queries import vocabulary


@pytest.fixture(scope="module")
def v():
    return vocabulary()


@pytest.fixture(scope="module")
def peer(v):
    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_perfect_hash_is_minimal(v):
    assert sorted(v.whole.slots) == sorted(v.ranks)
    assert all(v.ids[v.whole.find(k)] == r for k, r in v.ranks.items())
    assert v.whole.find(b"no such entry at all") == -1 and bpe.PerfectHash.build([]).find(b"x") == -1


def test_ids_equal_the_library(v, peer):
    rng, codec = random.Random(1), bpe.Codec(v)
    for _ in range(1500):
        s = "".join(rng.choice("aabbc th'sé\n\t 12\x1c\x1f\x85​漢字👍!?٣_") for _ in range(rng.randint(0, 60)))
        assert codec.encode(s) == peer.encode_ordinary(s) and codec.decode(codec.encode(s)) == s.encode()


def test_long_pre_tokens(v, peer):
    for s in ("ab" * 4000, "z" * 5000, " " * 3000, "<|endoftext|>"):
        assert bpe.Codec(v).encode(s) == peer.encode_ordinary(s)


def test_bounded_memo(v, peer, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_TOKENS", 2)
    s = "the orth wher stion inger blea the orth"
    assert bpe.Codec(v).encode(s) == peer.encode_ordinary(s)


def test_digests_and_round_trip(spark, v, peer):
    docs = documents(spark)
    want = []
    for d, t, *_ in rows():
        ids = peer.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, v).collect()), key=key) == sorted(want, key=key)
    back = sorted(map(tuple, bpe.decode(bpe.encode(docs, v), v).collect()), key=key)
    assert back == sorted(((d, t or "") for d, t, *_ in rows()), key=key)
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), v).collect() == []


def test_vocabulary_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(str(tmp_path / "v"), ".")
