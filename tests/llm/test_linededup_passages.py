"""Repeated passages in unlike surroundings, against the rule written down anew."""

import random
import re
from collections import defaultdict

import xxhash
from helpers import documents, key, prose, rows

from panelcf.llm import linededup


def fill(data):
    return [(d, t, "en", "s", None if t is None else len(t), 0, "r") for d, t in data]


def cleaned(spark, data):
    return sorted(((r["doc_id"], r["text"]) for r in linededup.drop_repeats(documents(spark, fill(data))).collect()), key=key)


def number(text):
    """XXH64 as a signed number."""
    h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def spans(bare):
    """(first, end) of the chunks: between neighbours of one class, and long pieces."""
    out, last = [], {}
    for i, p in enumerate(bare):
        h = number(p)
        if len(p) >= 150:
            out.append((i, i + 1))
        if len(p) >= 16 or h // 2 % 4 == 0:
            if h % 2 in last:
                out.append((last[h % 2], i + 1))
            last[h % 2] = i
    return out


def brute(data):
    """The chunks of all documents as texts in a dictionary; marked pieces, and stretches of them, one by one."""
    texts = sorted({x for x in data if len(x[1] or "") >= 64}, key=lambda x: (x[0] is not None, x[0] or 0, number(x[1])))
    cut = [re.split(r"(?:(?<=\n)|(?<=[.!?] ))(?=[ \t\r]*\S)", t) for _, t in texts]
    bare = [[p.strip(" \t\r\n") for p in pieces] for pieces in cut]
    places = defaultdict(list)
    for at, pieces in enumerate(bare):
        for i, e in spans(pieces):
            places[tuple(pieces[i:e])].append((at, i))
    gone = defaultdict(set)
    for chunk, found in places.items():
        d, s = min(found)
        for at, i in found:
            if d != at or i >= s + len(chunk):
                gone[at].update(range(i, i + len(chunk)))
    new = {}
    for at, (x, pieces) in enumerate(zip(texts, cut)):
        marks = "".join("x" if i in gone[at] else "." for i in range(len(pieces)))
        for run in re.finditer("x+", marks):
            if len("".join(pieces[run.start():run.end()]).strip(" \t\r\n")) < 64:
                marks = marks[:run.start()] + "." * len(run[0]) + marks[run.end():]
        new[x] = "".join(p for p, m in zip(pieces, marks) if m == ".")
    return sorted(((d, new.get((d, t), t)) for d, t in data), key=key)


def sentences(rng, n, each):
    return [" ".join(f"{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(each)) + "." for _ in range(n // each)]


def lines(rng, n, each):
    return [s[:-1] for s in sentences(rng, n, each)]


def left_over(spark, passages, around):
    """Each passage in six unlike surroundings: nothing else may change, the first stays, and of the others the share of words left over."""
    rng, data, stays = random.Random(1), [], {}
    for k, passage in enumerate(passages):
        for i in range(6):
            own, more = around(rng), around(rng)
            text = passage[1].join([*own, *passage[0], *more])
            data.append((10 * k + i, text))
            stays[10 * k + i] = (own, more, passage, i)
    words = left = untouched = 0
    for d, t in cleaned(spark, data):
        own, more, (pieces, sep), i = stays[d]
        assert t.startswith(sep.join(own)) and t.endswith(sep.join(more))
        if i == 0:
            assert t == dict(data)[d]
            continue
        n = sum(len(p.split()) for p in pieces if p in t)
        words, left, untouched = words + sum(len(p.split()) for p in pieces), left + n, untouched + (n == sum(len(p.split()) for p in pieces))
    return left / words, untouched


def test_short_lines(spark):
    rng = random.Random(1)
    passages = [(lines(rng, n, each), "\n") for n, each in ((60, 4), (60, 6), (60, 12), (104, 4), (48, 12)) for _ in range(8)]
    share, untouched = left_over(spark, passages, lambda r: lines(r, 24, 8))
    assert share < 0.05 and untouched == 0


def test_inside_longer_paragraphs(spark):
    rng = random.Random(2)
    passages = [(sentences(rng, n, each), " ") for n, each in ((60, 12), (60, 20), (100, 20), (60, 30)) for _ in range(8)]
    share, untouched = left_over(spark, passages, lambda r: sentences(r, 60, 12))
    assert share < 0.05 and untouched == 0


def test_a_single_long_line(spark):
    rng = random.Random(7)
    passages = [(lines(rng, n, n), "\n") for n in (50, 80)]
    assert left_over(spark, passages, lambda r: lines(r, 24, 8)) == (0, 0)


def test_lists_of_one_or_two_words(spark):
    rng = random.Random(8)
    passages = [(lines(rng, 60, each), "\n") for each in (1, 2) for _ in range(8)]
    share, untouched = left_over(spark, passages, lambda r: lines(r, 24, 8))
    assert share < 0.3 and untouched <= 5


def test_end_of_a_text_is_like_its_middle(spark):
    rng, data, want = random.Random(3), [], []
    for k, end in enumerate(("\n", "\r\n", " ")):
        passage = " ".join(sentences(rng, 60, 20))
        data += [(10 * k, "Own words.\n" + passage), (10 * k + 1, passage + end + "Other words."), (10 * k + 2, "Third.\n" + passage + "\n")]
        want += [data[-3], (10 * k + 1, "Other words."), (10 * k + 2, "Third.\n")]
    assert cleaned(spark, data) == want


def test_short_agreement_stays(spark):
    rng = random.Random(4)
    data = [(i, " ".join([*sentences(rng, 24, 12), "It is so.", "Not at all.", "Who knows?", *sentences(rng, 24, 12)])) for i in range(5)]
    assert cleaned(spark, data) == data


def test_rows_of_one_id_and_null_ids(spark):
    rng = random.Random(11)
    passage = " ".join(sentences(rng, 96, 12))
    data = [(d, " ".join([*sentences(rng, 24, 12), passage])) for d in (1, 1, 2, None, None)]
    data += [data[1], data[3]]
    got = cleaned(spark, data)
    assert got == brute(data)
    assert len({t for _, t in got if passage in t}) == 1


def test_frequent_chunks_are_broadcast(spark, monkeypatch):
    rng = random.Random(12)
    stock = [" ".join(sentences(rng, 60, 12)) for _ in range(3)]
    data = [(i, " ".join([*sentences(rng, 24, 12), rng.choice(stock)])) for i in range(60)]
    for parts in (1, 50, 10**6):
        monkeypatch.setattr(linededup, "HOT_PARTS", parts)
        assert cleaned(spark, data) == brute(data)


def test_equals_the_rule(spark):
    rng = random.Random(5)
    data = [(d, t) for d, t, *_ in rows()]
    stock = [prose(rng, rng.choice([20, 50, 60, 120])) for _ in range(5)] + ["\n".join(prose(rng, 5) for _ in range(20)), "Again and again. " * 60]
    for i in range(60):
        parts = [prose(rng, rng.choice([3, 8, 60])) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(stock))
        data.append((500 + i, "".join(p + rng.choice([" ", "\n", "\r\n", "\n\n", "\n   "]) for p in parts)))
    assert cleaned(spark, data) == brute(data)
