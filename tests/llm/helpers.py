"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random
import re

WORDS = "the of and to in orth wher stion inger blea ndoth eshan thore er lyou idiot anth reti onsh".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        out += [rng.choice(WORDS) + rng.choice(["", "a", "is", "ou"]) for _ in range(rng.randint(3, 9))]
        out[-1] += "."
    return " ".join(out[:n])


def rows(n=60, seed=3):
    """(doc_id, text, lang, source, n_chars, fp, row): the last two clash with names the operators use."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 5, 14, 40, 200])) for _ in range(n)]
    texts += [texts[3], texts[4], texts[5] + " extra words at the end", None, None, "", " \t\n", "É Straße 漢字 ÀB", "x" * 3000, prose(rng, 20000)]
    texts += [texts[9]] * 20
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t), i % 3, "r") for i, t in enumerate(texts)]
    return out + [out[2], (None, texts[1], None, None, None, 0, "r"), (None, None, None, None, None, 0, "r")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, row string"


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(x):
    return tuple((v is not None, v) for v in x)
