"""Page reading, the conditional random field and the extraction against plain versions."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from compare import connect, difference
from conftest import DATA

from sondeo.llm import html_extraction as H
from sondeo.llm.oracles import ORACLES
from sondeo.llm.queries import QUERIES


def texts(source):
    return [b.text for b in H.Page(source).blocks]


@pytest.mark.parametrize(("source", "wanted"), [
    ("", []), ("plain  text\n only", ["plain text only"]), ("a < b & c &lt;d&gt; &amp;amp; &#233;&eacute;", ["a < b & c <d> &amp; éé"]),
    ("<p>one<p>two <b>bold<br>break</b>x</p>three", ["one", "two bold breakx", "three"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<script>var t='</p><p>no';</script><p>yes<style>p{}</style></p>", ["yes"]), ("<title>t</title><p>x</p><textarea><p>y</p></textarea>", ["x"]),
    ("a<!-- <p>no</p> -->b<!-->c", ["abc"]), ("a<!-- never ends <p>b", ["a"]), ("a<script>never ends <p>b", ["a"]), ("<a title='x > y' href=\"z>\">link</a> on", ["link on"]),
    ("<p class=\"open>one</p><p>two</p>", ["one", "two"]), ("a<b", ["a"]), ("a</>b</ >c<?php echo ?>d<!DOCTYPE html>e", ["abcde"]), ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
    ("<svg><text>no</text></svg><select><option>no</select>yes", ["yes"]), ("x&nbsp;&nbsp;y z", ["x y z"]), ("<P>Upper</P><DIV>case</DIV>", ["Upper", "case"]), ("&am<b></b>p;", ["&amp;"]),
    ("<div/>a<br/>b<span/>c", ["a bc"]), ("</p></div>stray", ["stray"]), ("<dl><dt>t<dd>d</dl>", ["t", "d"]), ("<", ["<"]), ("<3 hearts <", ["<3 hearts <"]),
])
def test_leaf_blocks(source, wanted):
    assert texts(source) == wanted


def test_long_and_deep_pages_are_read_whole():
    assert texts("<div>" * 20_000 + "deep" + "</div>" * 20_000) == ["deep"]
    assert len(texts("<p>word " * 50_000)) == 50_000
    assert texts("<p>" + "long " * 200_000)[0].count("long") == 200_000
    assert texts('<a "' * 20_000 + ">x") == ["x"] and len(texts("<i class='a" * 20_000)) == 0
    assert len(texts("".join(f"<div class=c{i}>{i}" for i in range(3000)))) == 3000


def all_scores(model, blocks):
    """Label sequences and their scores, one by one."""
    single = list(model.scores(blocks))
    for labels in itertools.product((0, 1), repeat=len(blocks)):
        score = model.start * labels[0] + sum(s for s, y in zip(single, labels) if y)
        score += sum(model.steps[int(a.parent == b.parent)][x][y] for a, b, x, y in zip(blocks, blocks[1:], labels, labels[1:]))
        yield score, list(labels)


def some_pages(count, seed=0):
    rng = random.Random(seed)
    words = [[("h1", f"Title {i}")] + [("p", " ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))) + ".") for _ in range(rng.randrange(1, 6))] for i in range(count)]
    return [page for i, m in enumerate(words) for page in H.layouts(m, H.FILLER, seed + i, 1)]


def test_decoding_finds_the_best_of_all_sequences():
    rng = np.random.default_rng(1)
    pages = [p for p in some_pages(30) if 0 < len(p[0]) <= 11]
    names = sorted({f for b, _ in pages for x in b for f in H.of_elements(x.around, x.tag)} | {f for b, _ in pages for t in H.of_text(b) for f in t})
    for blocks, _ in pages:
        model = H.Model(dict(zip(names, rng.normal(size=len(names)))), rng.normal(size=(2, 2, 2)), float(rng.normal()))
        assert model.decoded(blocks) == max(all_scores(model, blocks))[1]


def test_fit_reaches_the_top_of_the_plain_likelihood():
    pages = [p for p in some_pages(60, 3) if 0 < len(p[0]) <= 8][:12]
    ridge = 0.5

    def likelihood(model):
        total = 0.0
        for blocks, labels in pages:
            scores = list(all_scores(model, blocks))
            total += dict((tuple(y), s) for s, y in scores)[tuple(labels)] - math.log(sum(math.exp(s) for s, _ in scores))
        return total - ridge / 2 * (sum(w * w for w in model.weights.values()) + float((model.steps**2).sum()) + model.start**2)

    model = H.fitted(pages, ridge, 1500)
    top = likelihood(model)
    for name in list(model.weights)[::7]:  # no small step along any weight goes higher
        for step in (-1e-2, 1e-2):
            assert likelihood(H.Model({**model.weights, name: model.weights[name] + step}, model.steps, model.start)) < top
    for at in np.ndindex(2, 2, 2):
        for step in (-1e-2, 1e-2):
            moved = model.steps.copy()
            moved[at] += step
            assert likelihood(H.Model(model.weights, moved, model.start)) < top
    assert likelihood(H.Model(model.weights, model.steps, model.start + 1e-2)) < top > likelihood(H.Model(model.weights, model.steps, model.start - 1e-2))


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_pages_laid_out_in_other_ways(model):
    """Layouts of unseen texts: with and without telling wrappers."""
    pages = some_pages(200, 10_000)
    blocks = sum(len(b) for b, _ in pages)
    wrong = sum(x != y for b, labels in pages for x, y in zip(labels, model.decoded(b)))
    assert wrong < 0.02 * blocks


MAIN = ["A title", "First paragraph of some length, with commas, and an end.", "Second one. It is as long as the first, or longer than that."]
BODY = "<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in MAIN[1:])
AROUND = (
    '<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-banner">We use cookies. <button>OK</button></div>{}'
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this text, it was good.</p></div></section><aside class="sidebar"><h3>More</h3><a href="/x">Another text</a></aside>'
    '<form><label>Your mail</label><input><button>Send</button></form><div class="ad">Buy now, cheap.</div><footer>&copy; site</footer>'
)


@pytest.mark.parametrize("wrapper", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="main"><article>{}</article></div>', '<div class="content">{}<div class="ad">Buy this.</div></div>', '<article>{}<aside>Also read</aside></article>'])
def test_common_sites(model, wrapper):
    blocks = H.Page("<html><head><title>t</title></head><body>" + AROUND.format(wrapper.format(BODY)) + "</body></html>").blocks
    assert [b.text for b, y in zip(blocks, model.decoded(blocks)) if y] == MAIN


def test_query_equals_sql_and_plain_python(spark):
    got = QUERIES["op11_html_extraction"](spark, DATA)
    assert difference(got, connect(DATA), ORACLES["op11_html_extraction"]) is None
    for r in got.join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        lines = [" ".join(H.references.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_messy_pages(spark, model):
    schema = "page_id long, url string, html string, t string, text string, n_chars long, `a.b` int"
    page = "<html><body>" + AROUND.format(f"<article>{BODY}</article>") + "</body></html>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "u", page), (4, "u", "<<<>>>&&&\x00"), (5, "u", "<article>" + "<p>Long text, whole.</p>" * 30_000 + "</article>")]
    docs = spark.createDataFrame([(*r, "clash", "clash", 7, 1) for r in rows], schema).repartition(3)
    got = sorted((str(r.page_id), r.text, r.n_chars, r.url) for r in H.extracted(docs, model).collect())
    main = "\n".join(MAIN)
    wanted = [("1", "", 0, "u"), ("2", "", 0, None), ("3", main, len(main), "u"), ("3", main, len(main), "u"), ("None", main, len(main), "u")]
    assert [x for x in got if x[0] not in "45"] == wanted
    assert next(x for x in got if x[0] == "5")[1].count("\n") == 29_999
    none = docs.limit(0)
    assert H.extracted(none, model).count() == 0
    fallback = H.fit(none)
    blocks = H.Page(page).blocks
    assert [b.text for b, y in zip(blocks, fallback.decoded(blocks)) if y] == MAIN


def test_labels_by_hand(spark):
    """Pages whose main text is given may use any markup."""
    rng = random.Random(1)
    prose = lambda: " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(5, 40))) + "."
    pages, texts = [], []
    for i in range(60):
        main = [prose() for _ in range(rng.randrange(1, 5))]
        pages.append((i, "u", f"<div class=zork><p>{prose()}</p></div><div class=quux>" + "".join(f"<p>{m}</p>" for m in main) + f"</div><div class=zork><p>{prose()}</p></div>"))
        texts.append((i, "\n".join(main)))
    docs, known = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(texts, "page_id long, text string")
    fitted = H.fit(docs, known.filter("page_id < 40"))
    got = {r.page_id: r.text for r in H.extracted(docs, fitted).collect()}
    assert sum(got[i] == t for i, t in texts if i >= 40) >= 19
