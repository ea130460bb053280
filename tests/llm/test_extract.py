import random

import numpy as np
import pytest
from helpers import prose

from panelcf.llm import extract
from panelcf.llm.dom import parse


def page(rng, k):
    body = [prose(rng, 6)] + [prose(rng, rng.choice([12, 40, 90])) for _ in range(k)]
    article = f"<h1>{body[0]}</h1>" + "".join(f"<p>{t.replace('the', 'the&nbsp;', 1) if False else t}</p>" for t in body[1:])
    return (
        f"<!DOCTYPE html><html><head><title>{body[0]}</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>{prose(rng, 2)}</a></li></ul></nav>"
        f"<div class='ad'>{prose(rng, 8)}</div><article>{article}</article><footer>&copy; {prose(rng, 5)}</footer></body></html>", "\n".join(body))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return extract.fit([page(rng, rng.randint(1, 9))[0] for _ in range(60)])


def text(model, source):
    nodes = parse(source)
    return extract.main_text(nodes, model.log_odds(extract.features(nodes)))


def test_held_out_pages(model):
    rng = random.Random(2)
    cases = [page(rng, rng.randint(1, 9)) for _ in range(80)]
    assert sum(text(model, s) == t for s, t in cases) >= 78


def test_held_out_layouts(model):
    rng = random.Random(3)
    material = [[prose(rng, 6)] + [prose(rng, rng.choice([12, 40, 90])) for _ in range(6)] for _ in range(30)]
    right = wrong = missed = 0
    for _ in range(120):
        nodes = parse(extract._layout(rng, material))
        want = extract._targets(nodes, ["main-text" in n.attributes for n in nodes])
        kept = extract.decode(nodes, model.log_odds(extract.features(nodes)))
        for n, k, w in zip(nodes, kept, want):
            if n.tag == "#text":
                right, wrong, missed = right + (k and w), wrong + (k and not w), missed + (w and not k)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 9
        nodes = parse("<div>" * 0)
        nodes = [type(nodes[0])("div", "", -1 if i == 0 else int(rng.integers(0, i)), 0, 0) for i in range(n)]
        odds = rng.normal(0, 2, n)
        kept = extract.decode(nodes, odds)

        def value(choice, odds=odds):
            return sum(-np.logaddexp(0, -o) if c else -np.logaddexp(0, o) for c, o in zip(choice, odds))

        every = [[bool(b >> i & 1) for i in range(n)] for b in range(1 << n)]
        best = max(value(c) for c in every if all(not c[i] or c[nodes[i].parent] for i in range(1, n)))
        assert value(kept) == pytest.approx(best)


def test_blocks_and_references():
    nodes = parse("a<p>one &amp; two&eacute;<br>three <b>bold</b>\n\t x<p>next<ul><li>i<li>j</ul>tail<script>no</script><!-- no --><div>unclosed <a href='x>y'>link")
    assert [n.text for n in nodes if n.tag == "#text"] == ["a", "one & twoé three bold x", "next", "i", "j", "tail", "unclosed link"]
    assert [n.linked for n in nodes if n.tag == "#text"][-1] == 4


def test_awkward_rows(spark, model):
    data = [(1, "u", None, 1), (2, None, "", 1), (3, "u", "   ", 1), (None, "u", "<<<>>> < p", 1), (4, "u", "<p>" * 3000 + "deep", 1), (4, "u", "<p>" * 3000 + "deep", 1),
            (5, "u", page(random.Random(5), 400)[0], 1)]
    got = extract.extract(spark.createDataFrame(data, "page_id long, url string, html string, text int"), model).collect()
    assert len(got) == len(data) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2, 3)} == {""}
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []


def test_fit_without_pages(spark):
    assert extract.fit_from(spark.createDataFrame([], "page_id long, html string")).base < 5


def test_controls_and_drawings_end_where_they_end():
    def texts(source):
        return [n.text for n in parse(source) if n.tag == "#text"]

    assert texts("<p>a<svg/><p>b<math /><p>c") == ["a", "b", "c"]
    assert texts("<div><button>no</div><p>yes<div><select><option>no</div>more") == ["yes", "more"]
    assert texts("<div>a<button><div>no</div>no</button>b<svg><g/><title>no</title><path d=''/></svg>c</div>d") == ["a b c", "d"]
    assert texts("<svg><g>no<p>yes") == ["yes"]
    assert texts("<svg><foreignObject><p>no</p></foreignObject></svg>yes<video>no<source src=x>no</video>too") == ["yes too"]
    assert texts("<p>a<object>no<object>no</object>no</object>b<script>x</p>") == ["a b"]
