"""The main text of web pages by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: stretches of text without a block element inside. Each block has features of its open
elements (tags, words of their classes, ids and roles, the block's own tag) and of its text (length, share of links,
marks, capitals, place on the page). A chain of two labels, main text or not, weighs the features and the steps from block to
block, apart for steps inside one parent element; Viterbi decoding gives the labels.

The field is fitted on labelled pages: pages with a known main text, or pages whose own markup says what is what
(article and main against nav, header, footer, aside, form and advert boxes). Each labelled page is also laid out anew, with
other wrappers around the same kinds of blocks and with the kinds it lacks, so that the model knows notices, comments,
sidebars and pages without telling tags. Fitting takes a bounded number of pages; every page is decoded, whole, in one map.
"""

from __future__ import annotations

import html as references
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.arrow import mapped
from sondeo.llm.words import column, text_or_empty

# Labelled pages that are fitted on, at most, and layouts made of each.
FIT_PAGES = 250
LAYOUTS = 4
# Names of open elements that a block takes as features; the outermost count where elements nest deeper than that.
MOST_NAMES = 256
RIDGE, ROUNDS, RATE = 0.02, 120, 0.25

# Elements of the markup language by how they show.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption button select".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video head select".split())
LITERAL = set("script style textarea title noscript iframe noembed noframes xmp".split())
#: Start tags that end an open element, up to an element that bounds the search.
ENDS = {
    **dict.fromkeys(BLOCKS, ({"p"}, {"table", "td", "th", "button"})), "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
# Wrappers that sites use for each kind of block.
WRAPPERS: dict[str, list[str]] = {
    "main": ["article", "article", "article", "main", "div class=content", "div id=content", "div class=post-content", "div class=entry-content", "div class=article-body", "section class=story", "div id=main", "div class=post-body", "div role=main", "div class=text", "div class=article", "div", "section", ""],
    "menu": ["nav", "nav", "div class=menu", "ul class=nav", "div id=navigation", "div class=navbar", "div class=breadcrumbs", "div role=navigation", "div class=topnav", "div class=pagination", "div class=toc"],
    "header": ["header", "header", "div class=header", "div id=header", "div class=masthead", "div class=site-header", "div role=banner", "div class=top-bar"],
    "footer": ["footer", "footer", "div class=footer", "div id=footer", "div class=site-footer", "div role=contentinfo", "div class=copyright", "div class=legal"],
    "sidebar": ["aside", "aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related", "div class=related-posts", "div role=complementary", "div class=recommended", "section class=more-stories", "div class=trending"],
    "notice": ["div class=cookie-notice", "div class=cookie-banner", "div id=cookie-consent", "div class=notice", "div class=gdpr", "div class=alert", "div class=popup", "div role=alert", "div class=modal", "dialog", "div class=message", "div class=privacy"],
    "advert": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div id=ad", "div class=banner", "div class=sponsored", "div class=promo", "aside class=ad", "ins class=adsbygoogle", "div class=ad-slot"],
    "form": ["form", "form", "form class=newsletter", "div class=newsletter-signup", "form class=search", "div class=subscribe", "form id=login", "div class=search-form", "div role=search"],
    "comments": ["section class=comments", "div id=comments", "div class=comments", "div class=comment-list", "ol class=commentlist", "div class=discussion", "div class=replies", "section id=disqus-thread", "div class=user-comments", "div class=responses"],
    "share": ["div class=share", "div class=social", "ul class=social-links", "div class=share-buttons", "div class=tags", "div class=author-bio", "div class=byline-share"],
}
# Which wrappers say by themselves what they hold, when a page brings no labels.
MAIN_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
OTHER_WORDS = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "cookie", "notice", "consent", "comment", "comments", "sidebar", "menu", "nav", "navigation", "footer", "header", "share", "social", "newsletter", "related"}
#: Text for layouts when no page is labelled.
FILLER = ["A short report on the weather of the past week.", "Rain fell on most days, and the river rose by a hand.", "On Friday the sun came out, and people went to the hills.", "Nobody expects more before the end of the month."]

NOTHING: frozenset[str] = frozenset()
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TAG = re.compile(r"""[^"'>]*+(?:"[^"]*"[^"'>]*+|'[^']*'[^"'>]*+)*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """Text without block elements inside, the features of its open elements, and the number of the element it lies in."""

    text: str
    around: frozenset[str]
    tag: str
    parent: int
    linked: int


@dataclass
class Open:
    tag: str
    around: frozenset[str]
    number: int
    shows: bool


@lru_cache(4096)
def within(outer: frozenset[str], tag: str, attributes: str) -> frozenset[str]:
    """``outer`` with the names of one more open element: its tag and the words of its class, id and role."""
    own = {f"in {tag}"}
    for match in ATTRIBUTE.finditer(attributes):
        own.update(f"named {word.lower()}" for word in NAME_WORDS.findall(match[2] or match[3] or match[4] or ""))
    return outer | own if len(outer) < MOST_NAMES else outer


@lru_cache(64)
def end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


class Page:
    """The leaf blocks of one page, read from left to right in a single pass.

    Character references are decoded piece by piece and white space becomes one space. Comments and elements that show no text are
    left out. A comment or script that never ends, or a tag that never does, takes the rest of the page. Once the
    quotes of a tag never close, later tags end at their first ">". A "<" that starts no tag is text.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.open: list[Open] = []
        self.pieces: list[str] = []
        self.linked = self.links = self.made = 0
        self.quotes = True
        at = 0
        while (start := source.find("<", at)) >= 0:
            end = self.markup(source, start)
            self.text(source[at:start] if end > start else source[at : start + 1])
            if end > start:
                self.apply(source, start, end)
                end = self.past_literal(source, end)
            at = max(end, start + 1)
        self.text(source[at:])
        self.flush()

    def markup(self, source: str, start: int) -> int:
        """Where the markup that starts here ends, or ``start`` if it is text."""
        here = source[start + 1 : start + 4]
        if here == "!--":
            end = source.find("-->", start + 4 if source[start + 4 : start + 5] != ">" else start + 2)
            return len(source) if end < 0 else end + 3
        if here[:1] in ("!", "?") or here[:1] == "/" and not here[1:2].isalpha():
            end = source.find(">", start)
            return len(source) if end < 0 else end + 1
        if not (here[:1].isascii() and here[:1].isalpha() or here[:1] == "/"):
            return start
        match = TAG.match(source, start + 1) if self.quotes else None
        if match:
            return match.end()
        self.quotes = False
        end = source.find(">", start)
        return len(source) if end < 0 else end + 1

    def past_literal(self, source: str, at: int) -> int:
        """Past the text of an element that holds no markup."""
        if not self.open or self.open[-1].tag not in LITERAL:
            return at
        end = end_of(self.open[-1].tag).search(source, at)
        return end.start() if end else len(source)

    def text(self, piece: str) -> None:
        if piece and (not self.open or self.open[-1].shows):
            piece = references.unescape(piece) if "&" in piece else piece
            self.pieces.append(piece)
            if self.links:
                self.linked += len(piece)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            at = len(self.open) - 1
            while at >= 0 and self.open[at].tag not in BLOCKS:
                at -= 1
            around = self.open[-1].around if self.open else NOTHING
            self.blocks.append(Block(text, around, self.open[at].tag if at >= 0 else "", self.open[at - 1].number if at > 0 else -1, self.linked))
        self.pieces, self.linked = [], 0

    def close(self, to: int) -> None:
        for element in self.open[to:]:
            self.links -= element.tag == "a"
        del self.open[to:]

    def apply(self, source: str, start: int, end: int) -> None:
        closing = source[start + 1] == "/"
        match = NAME.match(source, start + 1 + closing)
        if not match:
            return
        tag = match[0].lower()
        if tag in BLOCKS or tag in UNSEEN:
            self.flush()
        if tag == "br":
            self.pieces.append(" ")
        if closing:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == tag:
                    self.close(i)
                    break
            return
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in ended:
                    self.close(i)
                    break
                if self.open[i].tag in bounds:
                    break
        if tag in EMPTY or source[end - 2] == "/" and tag not in BLOCKS and tag not in LITERAL:
            return
        outer = self.open[-1] if self.open else None
        attributes = source[match.end() : end - 1] if tag != "a" else ""
        self.made += 1
        self.links += tag == "a"
        self.open.append(Open(tag, within(outer.around if outer else NOTHING, tag, attributes), self.made, tag not in UNSEEN and (not outer or outer.shows)))


def of_elements(around: frozenset[str], tag: str) -> list[str]:
    """Features of the open elements of a block and of its own tag."""
    return [f"tag {tag}", *around, *(f"{f} {tag}" for f in around if f.startswith("in "))]


def of_text(blocks: list[Block]) -> Iterator[tuple[str, ...]]:
    """Features of the text and the place of each block of a page."""
    for i, b in enumerate(blocks):
        n, head = len(b.text), b.text[:400]
        yield (
            WORDS[min((b.text.count(" ") + 1).bit_length(), 8)], LINKED[min(4, 5 * b.linked // n)], PLACES[5 * i // len(blocks)], COMMAS[min(2, b.text.count(","))],
            "stops" if b.text[-1] in ".!?…。" else "stops not", "first" if i == 0 else "last" if i == len(blocks) - 1 else "between",
            "copyright" if "©" in head else "no copyright", "capitals" if head.isupper() else "no capitals",
        )


WORDS, LINKED, PLACES, COMMAS = ([f"{name} {i}" for i in range(9)] for name in ("words", "linked", "place", "commas"))


@dataclass
class Model:
    """Weights of main text over other text: of features, of steps (other parent or the same, from label, to label), of the first label."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))
    start: float = 0.0
    seen: dict[tuple, float] = field(default_factory=dict)

    def scores(self, blocks: list[Block]) -> Iterator[float]:
        """How much each block alone speaks for main text; what open elements say is kept for the next page."""
        get, seen = self.weights.get, self.seen
        if len(seen) > 10_000:
            seen.clear()
        for b, text in zip(blocks, of_text(blocks)):
            key = b.around, b.tag
            known = seen.get(key)
            if known is None:
                known = seen[key] = sum(get(f, 0.0) for f in of_elements(*key))
            yield known + sum(get(f, 0.0) for f in text)

    def decoded(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of all blocks together."""
        if not blocks:
            return []
        back, scores, steps = [], list(self.scores(blocks)), self.steps.tolist()
        zero, one = 0.0, self.start + scores[0]
        for before, block, score in zip(blocks, blocks[1:], scores[1:]):
            (a, b), (c, d) = steps[before.parent == block.parent]
            from_zero, from_one = (zero + a, one + c), (zero + b, one + d)
            back.append((from_zero[1] > from_zero[0], from_one[1] > from_one[0]))
            zero, one = max(from_zero), max(from_one) + score
        label = int(one > zero)
        labels = [label]
        for choice in reversed(back):
            label = int(choice[label])
            labels.append(label)
        return labels[::-1]


def fitted(pages: list[tuple[list[Block], list[int]]], ridge: float = RIDGE, rounds: int = ROUNDS) -> Model:
    """The field of largest penalised likelihood, by steps along the gradient that adapt to each weight.

    Forward and backward sums run over all pages at once, block by block, the longest page first, so that pages that have
    ended cost nothing.
    """
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    if not pages:
        return Model()
    known: dict[str, int] = {}
    rows, cols = [], []
    lengths = np.array([len(b) for b, _ in pages])
    shape = (lengths[0], len(pages))
    label, there, same = np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, np.int64)
    for j, (blocks, labels) in enumerate(pages):
        for i, (b, text) in enumerate(zip(blocks, of_text(blocks))):
            names = [*of_elements(b.around, b.tag), *text]
            cols += [known.setdefault(f, len(known)) for f in names]
            rows += [i * len(pages) + j] * len(names)
        label[: len(labels), j], there[: len(labels), j] = labels, True
        same[1 : len(blocks), j] = [a.parent == b.parent for a, b in zip(blocks, blocks[1:])]
    rows, cols = np.array(rows), np.array(cols)
    n, across, left = len(known), np.arange(len(pages)), [int((lengths > i).sum()) for i in range(lengths[0])]
    w, square = np.zeros(n + 9), np.full(n + 9, 1e-8)

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([np.logaddexp(x[:, 0], y[:, 0]), np.logaddexp(x[:, 1], y[:, 1])], 1)

    for _ in range(rounds):
        steps, start = w[n : n + 8].reshape(2, 2, 2), w[-1]
        emit = np.zeros((*shape, 2))
        emit[:, :, 1] = np.bincount(rows, w[cols], minlength=there.size).reshape(shape)
        alpha, beta = np.zeros((*shape, 2)), np.zeros((*shape, 2))
        alpha[0] = emit[0] + [0.0, start]
        for i in range(1, shape[0]):
            m, step = left[i], steps[same[i, : left[i]]]
            alpha[i, :m] = both(alpha[i - 1, :m, :1] + step[:, 0], alpha[i - 1, :m, 1:] + step[:, 1]) + emit[i, :m]
        for i in range(shape[0] - 2, -1, -1):
            m, step = left[i + 1], steps[same[i + 1, : left[i + 1]]]
            after = emit[i + 1, :m] + beta[i + 1, :m]
            beta[i, :m] = both(step[:, :, 0] + after[:, :1], step[:, :, 1] + after[:, 1:])
        total = np.logaddexp.reduce(alpha[lengths - 1, across], 1)
        one = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total, 0.0)) * there
        gradient = np.zeros(n + 9)
        gradient[:n] = np.bincount(cols, (label - one).ravel()[rows], minlength=n)
        for s in (0, 1):
            i, j = np.nonzero((same[1:] == s) & there[1:])
            pair = np.exp(np.minimum(alpha[i, j, :, None] + steps[s] + (emit[i + 1, j] + beta[i + 1, j])[:, None, :] - total[j, None, None], 0.0))
            seen = np.bincount(2 * label[i, j] + label[i + 1, j], minlength=4).reshape(2, 2)
            gradient[n + 4 * s : n + 4 * s + 4] = (seen - pair.sum(0)).ravel()
        gradient[-1] = (label[0] - one[0]).sum()
        gradient -= ridge * w
        square += gradient**2
        w += RATE * gradient / np.sqrt(square)
    return Model({f: float(w[i]) for f, i in known.items()}, w[n : n + 8].reshape(2, 2, 2).copy(), float(w[-1]))


def marked(blocks: list[Block]) -> list[int] | None:
    """Labels that the page's own markup gives, or None if it does not tell main text from the rest."""
    def label(b: Block) -> int:
        main = any(f"in {t}" in b.around for t in MAIN_TAGS)
        other = any(f"in {t}" in b.around for t in OTHER_TAGS) or any(f"named {w}" in b.around for w in OTHER_WORDS)
        return int(main and not other)
    labels = [label(b) for b in blocks]
    return labels if any(labels) else None


def laid_out(main: list[tuple[str, str]], others: list[str], seed: int) -> str:
    """A page with ``main`` (tag, text) as its main text and, around it, other blocks made of the texts ``others``."""
    rng = random.Random(seed)
    escape = references.escape

    def sentence() -> str:
        words = rng.choice(others).split()
        n = rng.choice([2, 4, 8, 15, 30])
        at = rng.randrange(max(1, len(words) - n))
        return escape(" ".join(words[at : at + n]))

    def wrapped(kind: str, inside: str) -> str:
        tag, _, attribute = rng.choice(WRAPPERS[kind]).partition(" ")
        name, _, value = attribute.partition("=")
        return f'<{tag}{f" {name}={chr(34)}{value}{chr(34)}" if name else ""}>{inside}</{tag}>' if tag else inside

    def links() -> str:
        item = lambda: f'<a href="/{rng.randrange(99)}">{" ".join(sentence().split()[:4])}</a>'
        each = [item() for _ in range(rng.randint(1, 8))]
        return rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>", " | ".join(each), "".join(f"<div>{x}</div>" for x in each)])

    def prose(most: int) -> str:
        return "".join(f"<p>{sentence()}</p>" if rng.random() < 0.7 else f"<div>{sentence()}</div>" for _ in range(rng.randint(1, most)))

    def comment() -> str:
        tag = rng.choice(["div class=comment", "li", "article class=comment", "div", "p"])
        name, _, attribute = tag.partition(" ")
        return f'<{name} {attribute}><b>{sentence().split()[0]}</b> {prose(2) if name != "p" else sentence()}</{name}>'

    made = {
        "menu": links, "header": lambda: rng.choice([sentence, links])() + (f"<h1>{sentence()}</h1>" if rng.random() < 0.3 else ""), "footer": lambda: rng.choice(["&copy; ", ""]) + sentence() + rng.choice(["", links()]),
        "sidebar": lambda: f"<h3>{sentence()}</h3>" + rng.choice([links, lambda: prose(3)])(), "notice": lambda: rng.choice([sentence(), prose(2)]) + rng.choice(["", "<button>OK</button>"]),
        "advert": lambda: rng.choice([sentence(), prose(2)]), "form": lambda: f'<label>{sentence()}</label><input name="q"><button>{sentence().split()[0]}</button>',
        "comments": lambda: f"<h2>{sentence()}</h2>" + "".join(comment() for _ in range(rng.randint(1, 6))) + (wrapped("form", made["form"]()) if rng.random() < 0.4 else ""),
        "share": lambda: rng.choice([links(), sentence()]),
    }
    other = lambda kind: wrapped(kind, made[kind]())
    body = [f"<{tag}>{escape(text)}</{tag}>" if tag in ("h1", "h2", "h3", "p", "li", "pre", "blockquote", "td", "dd") else f"<p>{escape(text)}</p>" for tag, text in main]
    if len(body) > 1:
        # the main text itself may hold lists, quotes and, as sites do, boxes of another kind
        for i in range(1, len(body)):
            if rng.random() < 0.08:
                body[i] = f"<{(t := rng.choice(['blockquote', 'figcaption', 'li', 'td', 'h2', 'pre', 'div']))}>" + re.sub(r"</?\w+>", "", body[i]) + f"</{t}>"
        for kind, share in (("advert", 0.2), ("share", 0.15), ("sidebar", 0.1), ("comments", 0.1)):
            if rng.random() < share:
                body.insert(len(body) if kind == "comments" else rng.randint(1, len(body)), f'<i data-other="1"></i>{other(kind)}<i data-main="1"></i>')
    content = "<i data-main='1'></i>" + wrapped("main", "".join(body)) + "<i data-other='1'></i>"
    before = [other(k) for k, share in (("notice", 0.4), ("header", 0.7), ("menu", 0.8), ("advert", 0.5), ("sidebar", 0.2)) if rng.random() < share]
    after = [other(k) for k, share in (("share", 0.2), ("comments", 0.5), ("sidebar", 0.3), ("form", 0.4), ("notice", 0.2), ("advert", 0.3), ("footer", 0.8)) if rng.random() < share]
    return "<html><body>" + "".join(before) + content + "".join(after) + "</body></html>"


class LabelledPage(Page):
    """A laid-out page, whose blocks know on which side of the layout's own marks they stand."""

    def __init__(self, source: str):
        self.main, self.labels = False, []
        super().__init__(source)

    def apply(self, source: str, start: int, end: int) -> None:
        if source.startswith("<i data-", start):
            self.flush()
            self.main = source.startswith("main", start + 8)
        super().apply(source, start, end)

    def flush(self) -> None:
        before = len(self.blocks)
        super().flush()
        self.labels += [int(self.main)] * (len(self.blocks) - before)


def layouts(main: list[tuple[str, str]], others: list[str], seed: int, count: int) -> list[tuple[list[Block], list[int]]]:
    pages = [LabelledPage(laid_out(main, others, seed + i)) for i in range(count)]
    return [(p.blocks, p.labels) for p in pages]


def sample(pages: DataFrame, texts: DataFrame | None, count: int, id_column: str, html_column: str) -> list[tuple[str, str | None]]:
    """(html, known main text or None) of at most ``count`` pages, those with the smallest hashes of their ids."""
    rows = pages.select(column(pages, id_column).alias("_id"), column(pages, html_column).alias("_html")).filter("_id is not null and _html <> ''")
    if texts is None:
        rows = rows.withColumn("_text", F.lit(None).cast("string"))
    else:
        rows = rows.join(texts.select(column(texts, id_column).alias("_id"), column(texts, "text").alias("_text")), "_id")
    chosen = rows.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "_html").limit(count)
    return [(r["_html"], r["_text"]) for r in chosen.select("_html", "_text").toLocalIterator()]


def fit(pages: DataFrame, texts: DataFrame | None = None, count: int = FIT_PAGES, id_column: str = "page_id", html_column: str = "html") -> Model:
    """A model fitted on at most ``count`` labelled pages and layouts of their texts.

    ``texts`` (the id, text) gives main texts: a block is main text if it is one of that text's lines. Without it, the
    markup of the pages labels them, and pages whose markup tells nothing are passed over. If no page is left, layouts of a few fixed
    sentences are fitted.
    """
    known, mains, others = [], [], []
    for source, text in sample(pages, texts, count, id_column, html_column):
        blocks = Page(source).blocks
        lines = None if text is None else set(text.split("\n"))
        labels = marked(blocks) if lines is None else [int(b.text in lines) for b in blocks]
        if labels and any(labels):
            known.append((blocks, labels))
            mains.append([(b.tag, b.text) for b, y in zip(blocks, labels) if y])
            others += [b.text for b, y in zip(blocks, labels) if not y]
    mains = mains or [[("h1", FILLER[0])] + [("p", t) for t in FILLER[1:]]] * 40
    # other kinds of blocks speak like any text of the corpus
    others += [text for m in mains for _, text in m[:3]]
    made = [p for i, m in enumerate(mains) for p in layouts(m, others, zlib.crc32(m[0][1].encode()) + i * LAYOUTS, LAYOUTS)]
    return fitted(known + made)


def extracted(pages: DataFrame, model: Model, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text (blocks of the main text, joined by line ends), n_chars, n_blocks and n_kept of every row of ``pages``.

    Null html counts as empty and gives an empty text. Repeated rows and null ids each give their row. Pages are read whole, whatever their
    length. An empty table gives no rows; columns beyond the named ones are ignored, whatever they are called.
    """
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts, blocks, kept = [], [], []
            for value in batch.column("t"):
                found = Page(value.as_py().decode()).blocks
                chosen = [b.text for b, y in zip(found, model.decoded(found)) if y]
                texts.append("\n".join(chosen))
                blocks.append(len(found))
                kept.append(len(chosen))
            return {
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": blocks, "n_kept": kept,
            }
        return work

    rows = pages.select(column(pages, id_column).cast("long").alias("page_id"), column(pages, url_column).alias("url"), text_or_empty(column(pages, html_column)).cast("binary").alias("t"))
    return mapped(rows, make, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
