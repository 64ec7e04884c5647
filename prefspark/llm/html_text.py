"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features.

A page is flattened in one pass over its markup into blocks: stretches of text between block-level
tags, with character references decoded, white space turned into single spaces, and scripts, styles, form controls,
comments of the markup and hidden elements left out. A block's features are its words and link density, those
of the block before and after it, and what its markup says: how many enclosing elements are boilerplate or main
text by element name, role, class or id, which of the two the innermost one is, whether the page marks a
main text elsewhere, heading or list item. A decision tree (Gini impurity), trained from a small labelled table of
pages made by rule, gives the verdict; blocks of the main text are joined by blank lines.

Words are blank-separated; a block without blanks counts one word for every ``WORD_CHARS`` characters.
``<br>`` is white space. End tags that are missing or surplus are handled as browsers do in the common cases; a
tag whose quote is never closed ends at its next ``>``. An element that drops its content ends with its parent at the
latest. A null page is an empty one; its text is empty. Repeated pages give repeated rows. An empty table
gives no rows. Nothing is cut: the whole page is read, and blocks of any length are kept.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import prepare

WORD_CHARS = 8
MAX_DEPTH, MIN_LEAF = 7, 4
TRAINING_PAGES, SEED = 120, 12
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boilerplate_depth",
            "main_depth", "innermost", "main_elsewhere", "heading", "list_item")

# Elements by what they do to text.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
DROPPED = {"noscript", "template", "svg", "math", "select", "datalist", "button", "object", "video", "audio",
           "canvas", "map", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SAME_LEVEL = [{"p"}, HEADINGS, {"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}]
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "html", "legend", "li",
          "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
          "th", "thead", "tr", "ul"} | HEADINGS
BOILERPLATE = {"nav", "aside", "footer", "form", "dialog", "menu"}
MAIN = {"article", "main"}
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "alert": -1,
         "dialog": -1, "menu": -1, "main": 1, "article": 1}
BOILERPLATE_NAMES = set("""
    ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar
    navigation breadcrumb breadcrumbs sidebar widget widgets footer header masthead topbar cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing
    social related recommended recommendations comment comments commentlist reply replies respond disqus feedback
    pagination pager toolbar copyright disclaimer search tagcloud skip""".split())
MAIN_NAMES = {"article", "content", "post", "entry", "story", "main", "articlebody"}
LAYOUT_NAMES = {"has", "with", "no", "without"}  # "with-sidebar" tells how the page is laid out

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["']))|["'])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _standing(name: str, attributes: dict[str, str], inside_main: bool) -> int:
    """1 for a main element, -1 for boilerplate, 0 for neither."""
    if name in ("html", "body"):
        return 0
    role = ROLES.get(attributes.get("role", "").strip().lower(), 0)
    if role:
        return role
    parts = {p.lower() for key in ("class", "id", "itemprop") for p in _NAME_PARTS.findall(attributes.get(key, ""))}
    whole = {p.lower() for key in ("class", "id", "itemprop") for p in attributes.get(key, "").split()}
    parts |= whole
    is_main = bool(parts & MAIN_NAMES)
    low = parts & BOILERPLATE_NAMES if not parts & LAYOUT_NAMES else set()
    if is_main or inside_main:
        low = low - {"header"}
    if low or name in BOILERPLATE:
        return -1
    if name == "header":
        return 0 if inside_main else -1
    return 1 if is_main or name in MAIN else 0


class _Open:
    """An open element, with what all elements around its text add up to."""

    __slots__ = ("name", "boilerplate", "main", "innermost", "dropped")

    def __init__(self, name: str, around: _Open | None, standing: int = 0, dropped: bool = False):
        self.name = name
        self.boilerplate = (around.boilerplate if around else 0) + (standing < 0)
        self.main = (around.main if around else 0) + (standing > 0)
        self.innermost = standing or (around.innermost if around else 0)
        self.dropped = dropped or bool(around and around.dropped)


class Block:
    __slots__ = ("text", "words", "linked", "boilerplate", "main", "innermost", "heading", "item")


class Flattener:
    """Flattens one page into blocks."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack = [_Open("", None)]
        self.held: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = self.in_link = self.link_depth = 0

    def _text(self, raw: str) -> None:
        if self.stack[-1].dropped:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.in_link:
            self.linked += _words(text.split(), text)

    def _flush(self) -> None:
        if self.pieces and not self.stack[-1].dropped:
            words = "".join(self.pieces).split()
            if words:
                block, around = Block(), self.stack[-1]
                block.text = " ".join(words)
                block.words = _words(words, block.text)
                block.linked = min(self.linked, block.words)
                block.boilerplate, block.main, block.innermost = around.boilerplate, around.main, around.innermost
                block.heading = around.name in HEADINGS
                block.item = self.held.get("li", 0) > 0
                self.blocks.append(block)
            self.pieces, self.linked = [], 0

    def _close_to(self, name: str) -> None:
        while True:
            top = self.stack.pop()
            self.held[top.name] -= 1
            if len(self.stack) < self.link_depth:  # a link ends with the element that it began in
                self.in_link = 0
            if top.name == name:
                return

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self.pieces.append(" ")
            return
        if name == "a":
            self.in_link, self.link_depth = int("href" in rest.lower()), len(self.stack)
            return
        block, dropped = name in BLOCKS, name in DROPPED
        if name == "hr":
            self._flush()
        if name in VOID or not (block or dropped):
            return
        if block:
            self._flush()
            if self.stack[-1].name == "head":  # its end tag may be left out
                self._close_to("head")
            for family in SAME_LEVEL:
                top = self.stack[-1].name
                if top in family and (name in family or top == "p" or top in HEADINGS):
                    self._close_to(top)
                    break
            if self.stack[-1].name == "p" and name in ("li", "dd", "dt", "td", "th", "tr"):
                self._close_to("p")
            if name in ("td", "th", "tr", "li", "dd", "dt"):
                for family in SAME_LEVEL[2:]:
                    if name in family and self.stack[-1].name in family:
                        self._close_to(self.stack[-1].name)
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}
        around = self.stack[-1]
        hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").lower().replace(" ", "")
        self.stack.append(_Open(name, around, _standing(name, attributes, around.innermost > 0), dropped or hidden))
        self.held[name] = self.held.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
        elif name in BLOCKS or name in DROPPED:
            if name in BLOCKS:
                self._flush()
            if self.held.get(name, 0):
                self._close_to(name)

    def flatten(self, page: str) -> list[Block]:
        at, end, quotes = 0, len(page), True
        while at < end:
            tag = _TAG.search(page, at)
            if tag is None:
                self._text(page[at:])
                break
            if tag.start() > at:
                self._text(page[at:tag.start()])
            name = tag[2]
            if name is None:
                close = page.find("-->" if tag[3] else ">", tag.end() - (2 if tag[3] else 0))
                at = end if close < 0 else close + (3 if tag[3] else 1)
                continue
            rest = _REST.match(page, tag.end()) if quotes else None
            if rest is not None:
                at = rest.end()
            else:  # a quote without end: from here on tags end at their first ">"
                quotes = False
                close = page.find(">", tag.end())
                at = end if close < 0 else close + 1
            name = name.lower()
            if tag[1]:
                self._end(name)
            elif name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = end if close is None else close.start()
            else:
                self._start(name, page[tag.end():at - 1])
        self._flush()
        return self.blocks


def _words(words: list[str], text: str) -> int:
    return max(len(words), len(text) // WORD_CHARS) if words else 0


def features(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` a block."""
    out = np.zeros((len(blocks), len(FEATURES)))
    marked = sum(b.words for b in blocks if b.main and b.innermost > 0) > 0
    for k, b in enumerate(blocks):
        out[k, 0], out[k, 1] = b.words, b.linked / b.words
        out[k, 6:] = (b.boilerplate, b.main, b.innermost, marked and not b.main, b.heading, b.item)
    out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
    return out


# ---- the tree --------------------------------------------------------------------------------

class Tree:
    """A binary decision tree in arrays; ``value`` holds the share of ones of each leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, max_depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF):
        self.feature, self.threshold, self.children, self.value = [], [], [], []
        self._grow(x, y, max_depth, min_leaf)
        self.feature, self.threshold = np.array(self.feature), np.array(self.threshold)
        self.children, self.value = np.array(self.children), np.array(self.value)

    def _grow(self, x, y, depth, min_leaf) -> int:
        node = len(self.feature)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.children.append((node, node))
        self.value.append(float(y.mean()))
        split = _best_split(x, y, min_leaf) if depth and 0 < y.mean() < 1 else None
        if split:
            feature, threshold = split
            left = x[:, feature] <= threshold
            self.feature[node], self.threshold[node] = feature, threshold
            self.children[node] = (self._grow(x[left], y[left], depth - 1, min_leaf),
                                   self._grow(x[~left], y[~left], depth - 1, min_leaf))
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            right = x[inner, self.feature[node]] > self.threshold[node]
            at[inner] = self.children[node, right.astype(int)]


def _best_split(x: np.ndarray, y: np.ndarray, min_leaf: int):
    """(feature, threshold) of least Gini impurity, or None if no split leaves ``min_leaf`` rows on both sides
    and lowers it."""
    n, best, found = len(y), len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        value, ones = x[order, feature], np.cumsum(y[order])
        left = np.arange(1, n)
        able = (value[1:] > value[:-1]) & (left >= min_leaf) & (n - left >= min_leaf)
        if not able.any():
            continue
        p, q = ones[:-1] / left, (ones[-1] - ones[:-1]) / (n - left)
        impurity = np.where(able, 2 * (left * p * (1 - p) + (n - left) * q * (1 - q)), np.inf)
        k = int(impurity.argmin())
        if impurity[k] < best:
            best, found = impurity[k], (feature, float((value[k] + value[k + 1]) / 2))
    return found


# ---- the labelled table ----------------------------------------------------------------------

_MARK = "\ue000"  # ahead of every block of main text; part of a word, so it changes no feature


def _prose(rng: random.Random, words: int, mark: bool) -> str:
    text = " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(words))
    return (_MARK if mark else "") + text + "."


def _links(rng: random.Random, n: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{k}">{_prose(rng, rng.randint(1, 4), False)}</a></{item}>' for k in range(n))


def _main_text(rng: random.Random) -> str:
    def paragraph():
        text = _prose(rng, rng.choice([1, 2, 4, 7, 12, 20, 40, 80, 160]), True)
        if rng.random() < 0.3 and text.count(" ") > 6:
            words = text.split(" ")
            at = rng.randrange(1, len(words) - 2)
            words[at] = f'<a href="x">{words[at]}</a>'
            text = " ".join(words)
        return f"<p>{text}</p>"

    pieces = [f"<h1>{_prose(rng, rng.randint(1, 12), True)}</h1>"]
    for _ in range(rng.randint(2, 9)):
        pieces.append(paragraph())
        kind = rng.random()
        if kind < 0.15:
            pieces.append(f"<h2>{_prose(rng, rng.randint(1, 7), True)}</h2>")
        elif kind < 0.25:
            items = "".join(f"<li>{_prose(rng, rng.randint(2, 14), True)}</li>" for _ in range(rng.randint(2, 5)))
            pieces.append(f"<ul>{items}</ul>")
        elif kind < 0.32:
            pieces.append(f"<blockquote>{_prose(rng, rng.randint(8, 40), True)}</blockquote>")
    return "".join(pieces)


def _other(rng: random.Random) -> list[str]:
    """Kinds of boilerplate, marked as such by element, by name, or not at all."""
    def say(low, high):
        return _prose(rng, rng.randint(low, high), False)

    plain = [f"<div><ul>{_links(rng, rng.randint(3, 9))}</ul></div>",
             f"<div>{_links(rng, rng.randint(3, 8), 'span')}</div>", f"<div>{say(2, 7)}</div>"]
    text = say(4, 45)
    return [
        f"<nav><ul>{_links(rng, rng.randint(3, 9))}</ul></nav>",
        f'<div class="{rng.choice(["menu", "top-nav", "breadcrumbs"])}"><ul>{_links(rng, rng.randint(2, 7))}</ul></div>',
        f"<header><div>{say(1, 5)}</div><p>{say(2, 14)}</p></header>",
        f"<footer>{text} <a href='/'>{say(1, 2)}</a></footer>", f'<div id="footer"><p>{text}</p></div>',
        f"<aside><h3>{say(1, 4)}</h3><p>{say(5, 50)}</p><ul>{_links(rng, 3)}</ul></aside>",
        f'<div class="{rng.choice(["ad", "ads-box", "sponsored", "promo"])}">{text}</div>',
        f'<div class="{rng.choice(["cookie-notice", "alert", "newsletter"])}"><p>{text}</p></div>',
        f"<form><label>{say(1, 4)}</label><p>{say(2, 20)}</p></form>",
        f'<section id="comments"><h2>{say(1, 3)}</h2>' + "".join(
            f'<div class="comment"><b>{say(1, 2)}</b><p>{say(3, 70)}</p></div>' for _ in range(rng.randint(1, 4)))
        + "</section>", *plain]


def labelled_page(rng: random.Random) -> str:
    """A page; blocks of its main text hold ``_MARK``."""
    def others(n):
        return "".join(rng.choice(_other(rng)) for _ in range(n))

    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("", ""),
                               ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"),
                               ("<main><article>", "</article></main>")])
    inside = others(rng.choice([0, 0, 1])) if open_ and open_ != "<div>" else ""
    return f"<body>{others(rng.randint(1, 4))}{open_}{_main_text(rng)}{inside}{close}{others(rng.randint(1, 4))}</body>"


def labelled_table(pages: int = TRAINING_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the blocks of ``pages`` pages."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        blocks = Flattener().flatten(labelled_page(rng))
        x.append(features(blocks))
        y += [_MARK in b.text for b in blocks]
    return np.concatenate(x), np.array(y, float)


def trained() -> Tree:
    return Tree(*labelled_table())


# ---- pages -----------------------------------------------------------------------------------

def main_texts(pages: Sequence[str | None], tree: Tree) -> list[str]:
    flat = [Flattener().flatten(page) if page else [] for page in pages]
    sizes = [len(blocks) for blocks in flat]
    if not sum(sizes):
        return [""] * len(flat)
    kept = tree.predict(np.concatenate([features(blocks) for blocks in flat])) >= 0.5
    ends = np.cumsum(sizes)
    return ["\n\n".join(b.text for b, keep in zip(blocks, kept[e - n:e], strict=True) if keep)
            for blocks, n, e in zip(flat, sizes, ends, strict=True)]


def _extracted(batches, tree: Tree):
    for batch in batches:
        for begin in range(0, len(batch), 200):  # a few hundred pages' blocks in memory
            part = batch.slice(begin, 200)
            texts = main_texts(part.column(0).to_pylist(), tree)
            columns = [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in part.schema][1:], "text", "n_chars"])


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of every page, its main ``text`` and the text's code points, ``n_chars``. Kept columns of
    these names come back with ``_page`` behind their name."""
    prepare(pages.sparkSession)
    tree = trained()
    rows = pages.select(F.col(f"`{html_col}`").alias("html"),
                        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    kept = [f"c{k} {pages.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)]
    found = rows.mapInArrow(lambda it: _extracted(it, tree), ", ".join([*kept, "text string", "n_chars long"]))
    names = [c + "_page" if c.lower() in ("text", "n_chars") else c for c in keep]
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "text", "n_chars")
