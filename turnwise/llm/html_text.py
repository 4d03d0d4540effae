"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: runs of text between tags that start or end a block. A block is described
by its ancestors (tags, class and id words, roles) and by its text (length, link share, punctuation,
digits, words of fixed phrases). The field labels each block as article text or not; neighbouring
labels depend on each other, and Viterbi decoding finds the best labels of the page.

The field is trained here, by gradient ascent on the exact likelihood (forward-backward), on labelled
pages: ``labelled_pages`` lays out articles with menus, headers, sidebars, notices, adverts, forms,
comments and footers in many ways, with the label of each part known.

Null and empty pages give an empty text. Broken markup never fails: unclosed tags close with the
block-level tag around them, unknown tags are inline, stray quote marks in a tag open nothing. Text of
mathematics, drawings, buttons and of what stands in for scripts and objects is labelled like other text.
Whole pages are read, however long or deep: time and memory are linear in the page. Repeated rows are
extracted each; an empty table gives an empty result; extra columns take no part in ``main_texts``.
"""

from __future__ import annotations

import functools
import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import texts_of, with_found

#: Tags that start and end a block, tags whose content isn't text, tags without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset("script style template textarea title iframe select option".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start of the first tag closes an open one of the second kind.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"),
          "tr": ("tr", "td", "th"), "option": ("option",)}
#: Words of class, id and role that tell what a part of a page is.
CONTENT_WORDS = frozenset("article content main post entry story body text page".split())
MARGIN_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb comment comments cookie consent footer form header login menu nav "
    "navigation newsletter notice popup promo related reply respond share sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Phrases of page furniture.
PHRASES = re.compile(
    r"©|copyright|all rights reserved|cookie|subscribe|sign (?:in|up)|log ?in|newsletter|advert|sponsor|privacy|"
    r"terms of|read more|related|share (?:this|on)|repl(?:y|ies)|comments?\b|posted by|menu|home\b|search|contact",
    re.IGNORECASE,
)
_HINTS = CONTENT_WORDS | MARGIN_WORDS
#: Characters below which a block is read for the phrases.
SHORT = 160
#: A quote opens a value only right after "="; anywhere else it is part of a name or an unquoted value. Possessive
#: repeats keep the scan linear on broken markup.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_NAMED = frozenset(("class", "id", "role"))
_PIECES = re.compile(r"[a-z]+")
_HEADING = re.compile("h[1-6]$")
_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style", "title", "textarea")}


#: Ancestor tags that a block's features name.
ANCESTORS = frozenset(
    "article main nav header footer aside form section ul ol table blockquote figure pre dl a fieldset dialog menu head".split()
)


@dataclass
class Block:
    """A leaf block: its nearest tag and block-level tag, and which of the fixed tags and words are above it."""

    text: str
    leaf: str
    inner: str
    above: frozenset[str]
    hints: frozenset[str]
    linked: int = 0


@dataclass
class _Open:
    """An open tag with what it and all tags above it say; shared with the parent where it adds nothing."""

    tag: str
    inner: str = "none"
    above: frozenset[str] = frozenset()
    hints: frozenset[str] = frozenset()


def _below(parent: _Open, tag: str, attributes: str) -> _Open:
    words = {
        w for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in _NAMED
        for w in _PIECES.findall((m[2] or m[3] or m[4] or "").lower())
    } & _HINTS
    return _Open(
        tag, tag if tag in BLOCK_TAGS else parent.inner,
        parent.above | {tag} if tag in ANCESTORS and tag not in parent.above else parent.above,
        parent.hints | words if words - parent.hints else parent.hints,
    )


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Time is linear in the page, however deep its tags lie."""
    out: list[Block] = []
    open_: list[_Open] = [_Open("none")]
    places: dict[str, list[int]] = {}  # where each tag stands in open_
    walls: list[int] = [0]  # where block-level tags do
    stops: list[int] = [0]  # the same without headings
    parts: list[str] = []
    links = silent = linked = 0
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            top = open_[-1]
            out.append(Block(text, top.tag, top.inner, top.above, top.hints, linked))
        parts, linked = [], 0

    def close(place: int) -> None:
        """Closes the tag at a place with all inside it."""
        nonlocal links, silent
        while len(open_) > place:
            tag = open_.pop().tag
            places[tag].pop()
            links -= tag == "a"
            silent -= tag in SILENT_TAGS
            for held in (walls, stops):
                if held[-1] == len(open_):
                    held.pop()

    def add(text: str) -> None:
        nonlocal linked
        if not silent and text:
            parts.append(text)
            if links:
                linked += len(text)

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        add(page[at:token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name = name.lower()
        if token[1]:
            if name in VOID_TAGS:
                continue
            if name in BLOCK_TAGS:
                flush()
            # an end tag closes the nearest open tag of its name, unless an outer block lies between
            if places.get(name) and (name in BLOCK_TAGS or places[name][-1] > walls[-1]):
                close(places[name][-1])
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
            nearest = open_[stops[-1]].tag  # a block start ends an open paragraph with all inside it
            if nearest == "p" or nearest in CLOSES.get(name, ()):
                close(stops[-1])
        if name in VOID_TAGS:
            continue
        if name in _END:
            end = _END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if token[3].endswith("/"):
            continue
        places.setdefault(name, []).append(len(open_))
        if name in BLOCK_TAGS:
            walls.append(len(open_))
            if not _HEADING.match(name):
                stops.append(len(open_))
        open_.append(_below(open_[-1], name, token[3]))
        links += name == "a"
        silent += name in SILENT_TAGS
    add(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for k, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.split()
        names = ["bias", f"tag={b.inner}", f"leaf={b.leaf}"]
        names += [f"in={t}" for t in sorted(b.above)]
        names += [f"content:{w}" for w in sorted(b.hints & CONTENT_WORDS)]
        names += [f"margin:{w}" for w in sorted(b.hints & MARGIN_WORDS)]
        if b.hints & MARGIN_WORDS:
            names.append("margin")
        if b.hints & CONTENT_WORDS:
            names.append("content")
        names.append(f"length={min(6, n.bit_length() - 3) if n >= 8 else 0}")
        names.append(f"words={min(5, len(words).bit_length())}")
        share = b.linked / n
        names.append("links=all" if share > 0.8 else "links=many" if share > 0.3 else "links=some" if share else "links=none")
        if b.text[-1] in ".!?…\"”":
            names.append("ends")
        if sum(map(b.text.count, ",;:")) * 12 > len(words):
            names.append("clauses")
        if n < SHORT and PHRASES.search(b.text):
            names.append("phrase")
        if _HEADING.match(b.inner):
            names.append("heading")
        names.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "inside")
        out.append(names)
    return out


@dataclass
class Chain:
    """Weights of a two-label chain: per feature and label, per pair of labels, and for the first label."""

    names: dict[str, int]
    state: np.ndarray
    move: np.ndarray
    start: np.ndarray

    @functools.cached_property
    def weights(self) -> dict[str, list[float]]:
        return dict(zip(self.names, self.state.tolist(), strict=True))

    def scores(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        """Both labels' weights of each block; unknown features count nothing."""
        known = [[w for n in row if (w := self.weights.get(n)) is not None] for row in rows]
        return [(sum(w[0] for w in ws), sum(w[1] for w in ws)) for ws in known]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels of a page by Viterbi."""
        if not rows:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        each = self.scores(rows)
        a, b = each[0][0] + self.start[0], each[0][1] + self.start[1]
        back = []
        for zero, one in each[1:]:
            from0, from1 = (a + m00 >= b + m10), (a + m01 >= b + m11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = zero + (a + m00 if from0 else b + m10), one + (a + m01 if from1 else b + m11)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.3, ridge: float = 0.01) -> Chain:
    """Maximises the likelihood of the labels by AdaGrad over pages; exact gradients by forward-backward."""
    names: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for n in row:
                names.setdefault(n, len(names))
    data = []
    for rows, labels in pages:
        place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        data.append((place, np.array([names[n] for row in rows for n in row]), np.array(labels)))
    state, move, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full_like(x, 1e-6) for x in (state, move, start)]
    order = random.Random(7)
    for _ in range(rounds):
        order.shuffle(data)
        for place, ids, labels in data:
            n = len(labels)
            unary = np.zeros((n, 2))
            np.add.at(unary, place, state[ids])
            forward, backward = unary.copy(), np.zeros((n, 2))
            forward[0] += start
            for i in range(1, n):
                forward[i] += np.logaddexp(forward[i - 1, 0] + move[0], forward[i - 1, 1] + move[1])
            for i in range(n - 2, -1, -1):
                after = unary[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(move[:, 0] + after[0], move[:, 1] + after[1])
            total = np.logaddexp(*forward[-1])
            gold = np.eye(2)[labels]
            wrong = gold - np.exp(forward + backward - total)
            pairs = np.exp(forward[:-1, :, None] + move + (unary + backward)[1:, None, :] - total).sum(axis=0)
            seen = gold[:-1].T @ gold[1:]
            slope = np.zeros_like(state)
            np.add.at(slope, ids, wrong[place])
            slopes = slope - ridge * state * (np.abs(slope) > 0), seen - pairs, wrong[0]
            for weights, square, g in zip((state, move, start), squares, slopes, strict=True):
                square += g * g
                weights += rate * g / np.sqrt(square)
    return Chain(names, state, move, start)


# --- labelled pages --------------------------------------------------------------------------------------------------

_WORDS = ("the of and to in a is that it was for on are with as by at this be from or an which were not have but all "
          "their one when they can more time people year water light house story market river garden letter window "
          "music history science paper morning winter travel kitchen engine school village number ground").split()


class _Writer:
    """Random sentences, titles and short labels."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(_WORDS) for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(4, 18)
        if self.r.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        return text.capitalize() + self.r.choice("....!?")

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))

    def maybe(self, p: float) -> bool:
        return self.r.random() < p


def _menu(w: _Writer) -> str:
    items = "".join(f'<li><a href="/{k}">{w.words(1, 2)}</a></li>' for k in range(w.r.randint(3, 8)))
    return w.r.choice(("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="nav">{}</ul>',
                       '<div role="navigation"><ul>{}</ul></div>')).format(items)


def _header(w: _Writer) -> str:
    return w.r.choice((
        f"<header><a href='/'>{w.words(1, 3)}</a><p>{w.words(3, 8)}</p></header>",
        f'<div class="header"><h2>{w.words(1, 3)}</h2><form><input name="q"><label>Search</label></form></div>',
        f'<div id="header"><p>{w.sentence()}</p></div>',
    ))


def _advert(w: _Writer) -> str:
    return w.r.choice((
        f'<div class="ad">{w.sentence()}</div>', f'<div class="advert"><p>{w.sentence()}</p><a href="/x">{w.words(1, 3)}</a></div>',
        f'<aside class="sponsored"><p>{w.paragraph()}</p></aside>', f'<div id="ads"><p>{w.paragraph()}</p></div>',
    ))


def _notice(w: _Writer) -> str:
    return w.r.choice((
        f'<div class="cookie-notice"><p>This site uses cookies. {w.sentence()}</p><button>OK</button></div>',
        f'<div class="notice">{w.sentence()}</div>', f'<div class="banner"><p>{w.sentence()}</p></div>',
        f'<div id="consent"><p>{w.paragraph()}</p><a href="/p">Privacy</a></div>',
    ))


def _side(w: _Writer) -> str:
    links = "".join(f'<li><a href="/{k}">{w.words(2, 7)}</a></li>' for k in range(w.r.randint(2, 6)))
    return w.r.choice((
        f"<aside><h3>{w.words(1, 2)}</h3><ul>{links}</ul></aside>", f'<div class="sidebar"><h3>Related</h3><ul>{links}</ul></div>',
        f'<aside><p>{w.paragraph()}</p></aside>', f'<div class="widget"><h4>{w.words(1, 3)}</h4><p>{w.sentence()}</p></div>',
    ))


def _form(w: _Writer) -> str:
    return w.r.choice((
        f'<form action="/s"><p>{w.sentence()}</p><input type="text"><button>Subscribe</button></form>',
        f'<form class="login"><label>{w.words(1, 2)}</label><input><label>{w.words(1, 2)}</label><input></form>',
        f'<div class="newsletter"><p>Subscribe to our newsletter. {w.sentence()}</p></div>',
    ))


def _comments(w: _Writer) -> str:
    each = "".join(w.r.choice((
        f'<div class="comment"><b>{w.words(1, 2)}</b><p>{w.paragraph()}</p></div>',
        f'<li class="comment"><p>{w.paragraph()}</p><a href="#">Reply</a></li>',
        f"<article class='comment'><p>{w.paragraph()}</p></article>",
    )) for _ in range(w.r.randint(1, 5)))
    return w.r.choice((f'<section class="comments"><h3>Comments</h3>{each}</section>', f'<div id="comments">{each}</div>',
                       f'<ol class="comment-list">{each}</ol>'))


def _footer(w: _Writer) -> str:
    return w.r.choice((
        f"<footer>&copy; {w.words(1, 2)} &middot; {w.sentence()}</footer>", f'<div class="footer"><p>{w.paragraph()}</p></div>',
        f"<footer><p>Copyright {w.words(1, 3)}</p><ul><li><a href='/'>Terms</a></li><li><a href='/'>Contact</a></li></ul></footer>",
        f'<div id="footer"><p>All rights reserved. {w.sentence()}</p></div>',
    ))


def _article(w: _Writer) -> str:
    parts = [f"<h1>{w.words(2, 9)}</h1>"] if w.maybe(0.85) else []
    if w.maybe(0.2):
        parts.append(f"<p>{w.words(1, 4)}</p>")
    for _ in range(w.r.randint(1, 10)):
        parts.append(w.r.choices((
            f"<p>{w.paragraph()}</p>", f"<p><b>{w.sentence()}</b> {w.paragraph()}<br>{w.sentence()}", f"<p>{w.words(1, 6)}.</p>",
            f"<h2>{w.words(1, 6)}</h2>", f"<ul><li>{w.words(2, 8)}</li><li>{w.sentence()}</li></ul>",
            f"<blockquote>{w.paragraph()}</blockquote>", f'<p>{w.sentence()} <a href="/a">{w.words(1, 4)}</a> {w.sentence()}</p>',
            f"<table><tr><td>{w.words(1, 3)}</td><td>{w.words(1, 3)}</td></tr></table>", f"<pre>{w.words(3, 9)}</pre>",
            f"<ol><li>{w.sentence()}</li><li>{w.sentence()}</li></ol>", f"<h3>{w.words(1, 5)}</h3>", f"<p>{w.words(3, 12).upper()}</p>",
        ), (10, 3, 2, 2, 1, 1, 2, 1, 1, 1, 1, 1))[0])
    return "".join(parts)


_KEY = "\x01"


def labelled_pages(count: int = 240, seed: int = 11) -> list[tuple[str, str]]:
    """Pages with the markup of their article marked: (page, article)."""
    out = []
    for k in range(count):
        w = _Writer(seed * 100_003 + k)
        article = _article(w)
        if w.maybe(0.25):  # furniture within the article's own element
            middle = w.r.choice((_advert, _form, _side, _notice, _comments))(w)
            inner = article + _KEY + middle
        else:
            inner = article
        frame = w.r.choice(("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>",
                            "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>',
                            '<section class="entry">{}</section>', '<div class="story-body">{}</div>', "<div>{}</div>"))
        before = [f(w) for f, p in ((_menu, 0.8), (_header, 0.5), (_notice, 0.3), (_advert, 0.5)) if w.maybe(p)]
        after = [f(w) for f, p in ((_side, 0.4), (_comments, 0.4), (_form, 0.25), (_advert, 0.3), (_footer, 0.9)) if w.maybe(p)]
        w.r.shuffle(before)
        whole = frame.format("\x02" + inner.replace(_KEY, "\x03", 1) + ("" if _KEY in inner else "\x03"))
        title = f"<head><title>{w.words(2, 6)}</title><style>p{{}}</style></head>"
        out.append(("<!DOCTYPE html><html>" + title + "<body>" + "".join(before) + whole + "".join(after) + "</body></html>", article))
    return out


def marked_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page and their labels; blocks between the marks are the article."""
    plain = page.replace("\x02", "").replace("\x03", "")
    start, end = page.index("\x02"), page.index("\x03") - 1
    tagged = plain[:start] + "<p>\x02</p>" + plain[start:end] + "<p>\x03</p>" + plain[end:]
    blocks, labels, inside = [], [], 0
    for block in blocks_of(tagged):
        if block.text == "\x02":
            inside = 1
        elif block.text == "\x03":
            inside = 0
        else:
            blocks.append(block)
            labels.append(inside)
    return blocks, labels


@functools.cache
def trained_field() -> Chain:
    """The field fitted on the labelled pages; once per process, on the driver."""
    pages = [marked_blocks(page) for page, _ in labelled_pages()]
    return fit([(features(blocks), labels) for blocks, labels in pages if blocks])


def main_text(page: str, model: Chain) -> str:
    """Article blocks in page order, one per line."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(features(blocks)), strict=True) if label)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """``row`` and the main text of each page as ``found``."""
    sent = pages.sparkSession.sparkContext.broadcast(trained_field())

    def make():
        model = sent.value

        def work(rows: pa.StructArray) -> pa.Array:
            return pa.array([main_text(t.decode("utf-8", "replace"), model) for t in texts_of(rows, column)], pa.string())

        return work

    return with_found(pages, make, "string")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    out = extracted(pages.select("page_id", "url", "html"))
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), F.col("found").alias("text"),
                      F.length("found").cast("long").alias("n_chars"))
