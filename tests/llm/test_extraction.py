"""Block labelling: parsing, gradients against finite differences, given pages against their markup, held-out layouts."""

import html
import random
import re

import numpy as np
import pytest

from kolanut.llm import extraction, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet(f"{SF}/pages.parquet"))


def _texts(page):
    return [b.text for b in extraction.blocks(page)]


def test_blocks():
    assert _texts("<p>a <b>b</b>c<p>d&amp;e &lt;x&gt;</p> f") == ["a bc", "d&e <x>", "f"]
    assert _texts("<p><b>open<br><p>next</p>") == ["open", "next"]
    assert _texts("a<!-- no -->b<script>var t='</p>';</script>c<style>p{}</style>") == ["ab", "c"]
    assert _texts("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>") == ["x", "y", "z", "w"]
    assert _texts("one<br>two\n\t three&nbsp;four") == ["one two three four"]
    assert _texts("<a href='x>y'>link</a> 1 < 2 <unclosed") == ["link 1 < 2 <unclosed"]
    assert _texts("<title>t</title><noscript>n</noscript><p></p> <p> </p>") == []
    assert [b.path for b in extraction.blocks('<body><div class="Side bar"><p>x</div><p>y')] == [("body", "div side bar", "p"), ("body", "p")]
    assert extraction.blocks("<p><a>abc</a>d</p>")[0].linked == 3
    assert _texts("<p>" * 5000 + "deep") == ["deep"] and _texts("<div>" * 3000 + "x") == ["x"]


def test_names_decide_from_within():
    assert extraction.told_by_names(("body", "article", "p")) == 1
    assert extraction.told_by_names(("body", "article", "div comments", "p")) == 0
    assert extraction.told_by_names(("body", "aside", "article", "p")) == 1
    assert extraction.told_by_names(("body", "div", "p")) is None


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    model = extraction.Labeller.fresh()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, sizes = model.padded([rng.normal(0, 1, (n, extraction.WIDTH)) for n in (5, 3, 1)])
    labels = np.where(rng.random(x.shape[:2]) < 0.5, 1, 0)
    labels[2, 0] = -1
    _, grads = model.gradients(x, sizes, labels)
    for name, weights in model.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            kept, losses = weights[at], []
            for step in (1e-5, -1e-5):
                weights[at] = kept + step
                losses.append(model.gradients(x, sizes, labels)[0])
            weights[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-5, name


def test_scores_are_those_of_one_page_at_a_time(model):
    """Padding, order and grouping change nothing: against a plain walk over one page in both directions."""
    rng = np.random.default_rng(2)
    pages = [rng.random((n, extraction.WIDTH)).astype(np.float32) for n in (1, 40, 7, 7, 200, 0)]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for page, told in zip(pages, model.scores(pages)):
        total = np.full(len(page), model.w["bias"][0], dtype=np.float64)
        for side, part, steps in (("f", slice(0, extraction.HIDDEN), range(len(page))), ("b", slice(extraction.HIDDEN, None), range(len(page) - 1, -1, -1))):
            h = c = np.zeros(extraction.HIDDEN)
            for t in steps:
                i, f, o, g = np.split(page[t] @ model.w[f"x{side}"] + model.w[f"b{side}"] + h @ model.w[f"h{side}"], 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                total[t] += h @ model.w["out"][part, 0]
        assert np.allclose(told, sigmoid(total), atol=1e-4)


def _by_markup(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?h1>|</?p>|<br>", inner)]
    return "\n".join(p for p in parts if p)


def test_every_given_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op12_html_extraction"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.text == _by_markup(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_layouts_not_learned_from(spark, model):
    """Texts of pages outside the sample in layouts of another seed."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 1000").limit(120).collect()]
    held_out = extraction.examples(pages, seed=99)[len(pages):]
    features = extraction.Features()
    scores = model.scores([features.rows(b) for b, _ in held_out])
    right = [(s >= 0.5) == (np.array(y) == 1) for s, (_, y) in zip(scores, held_out)]
    assert len(held_out) > 300 and np.mean(np.concatenate(right)) > 0.98


def test_odd_rows_and_clashing_names(spark, model):
    words = ["The story of it goes on here, and on.", "Nothing of that was so, they said."]
    rng = random.Random(1)
    body = "".join(f"<p>{rng.choice(words)}</p>" for _ in range(20_000))
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u", "plain & simple", 0), (4, "u", f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article>{body}</article>", 0),
            (None, "u", "<article><h1>T</h1><p>Text of it, all.</p></article><footer>&copy; me</footer>", 0)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int").repartition(3)
    pages = pages.withColumn("_page", pages.text).withColumn("_main", pages.text).withColumn("n_chars", pages.text)
    got = extraction.extract(pages, model).collect()
    assert len(got) == 10 and all((r.text == "") for r in got if r.page_id in (1, 2))
    assert all(r.text.count("\n") == 19_999 and "Home" not in r.text for r in got if r.page_id == 4)
    assert extraction.extract(pages.limit(0), model).collect() == []
    assert extraction.train(pages.limit(0)) is None
    assert {r.text for r in extraction.extract(pages, None).collect()} == {""}
