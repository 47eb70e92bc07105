"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements. Each node is described by its tag, the tokens of its class, id and role and
those of its ancestors, its depth and place among siblings, and the text, link and sentence density of its
subtree. Tokens are hashed; what a token says, its log-odds of main text, is learned with the trees, which see the
least and the greatest of a node's own tokens and of its ancestors'; an unseen token says nothing. Boosted trees give each node the probability that its subtree holds main text. The labels are then chosen
together, for the greatest likelihood under one rule: below a node that is dropped nothing is kept.

The trees learn from pages of the module's own page maker, whose number is the bound of the training sample; no
row of the corpus is read for training.

Defined results: a null or empty page and a page without main text give the empty text; a page without a wrapper, or
of bare text, is its own article; an unclosed element ends with its parent; an unclosed comment or script swallows the
rest of the page, a tag that the page's end cuts is dropped, a quote that is never closed opens no value; repeated rows are extracted
alike; columns of the input with an output's name give way to the output.
"""

from __future__ import annotations

import functools
import html as _html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns

#: A comment ends as browsers end it, ``<!-->`` at once; what is no tag after ``</`` is a comment too.
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))"
#: A quote opens a value only after ``=``, and only if it is closed; the end of the page ends a tag.
_TAG = r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*)(?:>|\Z)"
_TOKEN = re.compile(f"{_COMMENT}|{_TAG}", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKENS = re.compile(r"[a-z]+")
_HIDDEN = {"script", "style", "template", "svg", "iframe"}
#: Their contents are no markup: only their own closing tag ends them.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "iframe")}
_INLINE = set("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr img br math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover semantics annotation".split())
#: Blocks of their own, which may stand within a paragraph.
_WITHIN = {"noscript", "object", "canvas"}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: An element of the first kind ends open ones of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "nav", "aside", "header", "footer", "form", "table", "td", "blockquote", "pre", "figure", "head", "body", "html", "dl", "select", "button", "dialog"]
_LIKE = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "th": "td", "tr": "table", "tbody": "table", "thead": "table", "dt": "li", "dd": "li", "figcaption": "figure", "menu": "nav", "fieldset": "form", "input": "form", "textarea": "form", "option": "select", "title": "head"}
#: Tokens are numbered by a hash of so many bits.
_TOKEN_BITS = 18
_BAD_TAGS = {"nav", "aside", "footer", "form", "head", "select", "button", "dialog"}


@dataclass
class _Node:
    tag: str
    tokens: frozenset[int]
    parent: int
    depth: int
    own: int = 0
    links: int = 0
    stops: int = 0
    words: int = 0


@dataclass
class Page:
    nodes: list[_Node] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)  # node and text, in page order; breaks are spaces


@functools.lru_cache(maxsize=1 << 16)
def _token(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << _TOKEN_BITS) - 1)


def parse_page(source: str) -> Page:
    page = Page()
    nodes, pieces = page.nodes, page.pieces
    nodes.append(_Node("html", frozenset(), -1, 0))
    stack, linked, at, hidden, inner = [0], False, 0, "", 0

    def say(text: str) -> None:
        if hidden or not text:
            return
        text = _html.unescape(text) if "&" in text else text
        pieces.append((stack[-1], text))
        n = len(text.strip())
        if n:
            node = nodes[stack[-1]]
            node.own += n
            node.words += text.count(" ") + 1
            node.stops += text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?")
            if linked:
                node.links += n

    while m := _TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[1] == "/"
        if hidden:
            if tag == hidden:
                inner += -1 if closing else not m[3].rstrip().endswith("/")
                hidden = hidden if inner else ""
            elif tag in _RAW and not closing and not m[3].rstrip().endswith("/"):
                end = _RAW[tag].search(source, at)
                at = end.start() if end else len(source)
            continue
        if tag in _HIDDEN:
            if closing or m[3].rstrip().endswith("/"):
                pass
            elif tag in _RAW:
                end = _RAW[tag].search(source, at)
                closed = _TOKEN.match(source, end.start()) if end else None
                at = closed.end() if closed else len(source)
            else:
                hidden, inner = tag, 1
            continue
        if tag in _INLINE:
            if tag == "a":
                linked = not closing
            elif tag == "br":
                pieces.append((stack[-1], " "))
            continue
        pieces.append((stack[-1], " "))
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            linked = False
            continue
        if tag == "html":
            continue
        # a block ends an open paragraph; list items and cells end their like, up to the list or table
        if nodes[stack[-1]].tag == "p" and tag not in _WITHIN:
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            above = nodes[stack[k]].tag
            if above in _ENDS.get(tag, ()):
                del stack[k:]
            elif above in ("ul", "ol", "dl", "table", "tbody", "select", "div", "article", "section", "main", "td"):
                break
        tokens = frozenset(_token(w) for a in _ATTRIBUTE.findall(m[3]) for w in _TOKENS.findall("".join(a).lower())) if "=" in m[3] else frozenset()
        nodes.append(_Node(tag, tokens, stack[-1], min(nodes[stack[-1]].depth + 1, 255)))
        if tag not in _VOID:
            stack.append(len(nodes) - 1)
    say(source[at:])
    return page


N_FEATURES = len(_TAGS) + 28


def token_odds(pages: list[Page], labels: list[np.ndarray]) -> dict[int, float]:
    """For each hashed token seen, the log-odds that a node with it holds main text, less those of all nodes."""
    seen = np.zeros((2, 1 << _TOKEN_BITS))
    for page, label in zip(pages, labels, strict=True):
        for v, y in zip(page.nodes, label.tolist(), strict=True):
            seen[int(y), list(v.tokens)] += 1
    share = np.mean(np.concatenate(labels)) if labels else 0.5
    prior = 2.0
    odds = np.log((seen[1] + prior * share) / (seen[0] + prior * (1 - share))) - np.log(share / (1 - share))
    known = np.flatnonzero(seen.sum(axis=0))
    return dict(zip(known.tolist(), odds[known].tolist(), strict=True))


def node_features(page: Page, odds: dict[int, float]) -> np.ndarray:
    """One row a node; ``odds``: what each token says."""
    nodes = page.nodes
    n = len(nodes)
    out = np.zeros((n, N_FEATURES))
    parent = np.array([v.parent for v in nodes])
    total = np.array([[v.own, v.links, v.stops, v.words, 1, v.tag == "p", v.tag == "li", v.tag in ("input", "textarea", "select", "button"), v.own > 0] for v in nodes], float)
    start = np.concatenate([[0.0], np.cumsum(total[:-1, 0])])
    own = total.copy()
    for k in range(n - 1, 0, -1):  # children come after their parents
        total[parent[k]] += total[k]
    children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n, int)
    seen: dict[int, int] = {}
    same: dict[tuple[int, str], int] = {}
    for v in nodes[1:]:
        same[v.parent, v.tag] = same.get((v.parent, v.tag), 0) + 1
    tag_at = {t: k for k, t in enumerate(_TAGS)}
    base = len(_TAGS)
    low, high = [0.0] * n, [0.0] * n  # least and greatest odds of the node's tokens and none
    above_low, above_high = [0.0] * n, [0.0] * n
    bad_tag = np.zeros(n)
    in_article = np.zeros(n)
    for k, v in enumerate(nodes):
        t = tag_at.get(_LIKE.get(v.tag, v.tag))
        if t is not None:
            out[k, t] = 1
        if v.tokens:
            said = [odds.get(t, 0.0) for t in v.tokens]
            low[k], high[k] = min(0.0, *said), max(0.0, *said)
        if k:
            p = v.parent
            above_low[k], above_high[k] = min(above_low[p], low[p]), max(above_high[p], high[p])
            bad_tag[k] = max(bad_tag[p], nodes[p].tag in _BAD_TAGS)
            in_article[k] = max(in_article[p], nodes[p].tag in ("article", "main"))
            place = seen[p] = seen.get(p, -1) + 1
            out[k, -1] = place / max(1, children[p] - 1)
            out[k, -2] = np.log1p(children[p])
            out[k, -3] = same[p, v.tag] / max(1, children[p])
    low, high = np.array(low), np.array(high)
    text, page_text = total[:, 0], max(1.0, total[0, 0])
    columns = (
        [v.depth for v in nodes],
        np.log1p(own[:, 0]),
        np.log1p(text),
        total[:, 1] / np.maximum(1, text),
        own[:, 1] / np.maximum(1, own[:, 0]),
        np.log1p(text / total[:, 4]),
        total[:, 2] / np.maximum(1, total[:, 3]) * 10,
        total[:, 3] / np.maximum(1, total[:, 8]),
        text / page_text,
        start / page_text,
        np.log1p(total[:, 5]),
        np.log1p(total[:, 6]),
        np.log1p(total[:, 7]),
        np.log1p(total[:, 4]),
        bad_tag,
        in_article,
        text[parent] / page_text,
        np.log1p(children),
        low,
        high,
        above_low,
        above_high,
        low[parent],
        high[parent],
        np.minimum(own[:, 2], 5),
    )
    for k, c in enumerate(columns):
        out[:, base + k] = c
    return out


@dataclass(frozen=True)
class BoostedTrees:
    """Trees of equal depth over binned features; ``edges``: the upper bounds of each feature's bins."""

    edges: np.ndarray
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # bins up to this go left
    leaf: np.ndarray  # (trees, leaves)
    base: float
    odds: dict[int, float]  # of the hashed tokens

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1)

    def features(self, page: Page) -> np.ndarray:
        return node_features(page, self.odds)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows = np.arange(len(b))
        total = np.full(len(b), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(b), np.int64)
            for _ in range(len(feature).bit_length()):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, odds: dict[int, float], trees: int = 50, depth: int = 4, rate: float = 0.25, n_bins: int = 24) -> BoostedTrees:
    """Logistic boosting with second-order leaf values, level by level on feature histograms."""
    # most nodes have 0 in most columns: bins go by the others
    edges = [np.unique(np.append(0.0, np.quantile(v[v != 0], np.linspace(0, 1, n_bins)[1:-1]) if v.any() else [])) for v in x.T]
    width = max(map(len, edges))
    edges = np.stack([np.append(e, np.full(width - len(e), np.inf)) for e in edges])
    model = BoostedTrees(edges, np.empty(0), np.empty(0), np.empty(0), 0.0, odds)
    b = model.bins(x)
    n, f = b.shape
    bins = width + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    logit = np.full(n, base)
    inner = (1 << depth) - 1
    features, cuts, leaves = [], [], []
    cell = b + np.arange(f) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins)
        for level in range(depth):
            first = (1 << level) - 1
            local = at - first
            flat = (local[:, None] * (f * bins) + cell).ravel()
            size = (1 << level) * f * bins
            gs, hs = (np.bincount(flat, np.repeat(v, f), minlength=size).reshape(1 << level, f, bins).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[:, :, -1] = 0
            best = gain.reshape(1 << level, -1).argmax(axis=1)
            feature[first : first + (1 << level)] = best // bins
            cut[first : first + (1 << level)] = best % bins
            at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
        spot = at - inner
        leaf = rate * np.bincount(spot, g, minlength=inner + 1) / (np.bincount(spot, h, minlength=inner + 1) + 1)
        logit += leaf[spot]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return BoostedTrees(edges, np.array(features), np.array(cuts), np.array(leaves), base, odds)


def decode(parent: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """The likeliest labels under which a dropped node's subtree is dropped too."""
    logit = np.clip(logit, -30, 30)
    keep, drop = -np.log1p(np.exp(-logit)), -np.log1p(np.exp(logit))
    for k in range(len(parent) - 1, 0, -1):
        keep[parent[k]] += max(keep[k], drop[k])
        drop[parent[k]] += drop[k]
    kept = np.zeros(len(parent), bool)
    kept[0] = keep[0] > drop[0]
    for k in range(1, len(parent)):
        kept[k] = kept[parent[k]] and keep[k] > drop[k]
    return kept


class _Maker:
    """Pages with known main text, in many layouts. A block is (html, kept)."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.syllables = ["ta", "ren", "o", "is", "mel", "ku", "é", "san", "der", "vi", "ño", "al", "th", "ing", "pro", "ü"]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def word(self) -> str:
        w = "".join(self.pick(self.syllables) for _ in range(int(self.rng.integers(1, 4))))
        return w + self.pick(["***", "%%%", "###", "!!"]) if self.noisy and self.rng.random() < 0.9 else w

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(lo, hi + 1))))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(1, 14).capitalize() + "." for _ in range(n))

    def links(self) -> str:
        n = int(self.rng.integers(2, 9))
        shape = self.pick(["<li><a href='#'>{}</a></li>", "<a href='/x'>{}</a> ", "<div><a href='#'>{}</a></div>"])
        inner = "".join(shape.format(self.words(1, 4)) for _ in range(n))
        return f"<ul>{inner}</ul>" if shape.startswith("<li") else inner

    def named(self, tag: str, names: list[str]) -> str:
        kind = self.pick(["class", "class", "id"])
        return f"{tag} {kind}='{self.pick(names)}'"

    def junk(self, where: str) -> tuple[str, bool]:
        def box(opening: str, inner: str) -> tuple[str, bool]:
            return f"<{opening}>{inner}</{opening.split()[0]}>", False

        short = self.sentences(int(self.rng.integers(1, 4)))
        options = {
            "ad": lambda: box(self.named("div", ["ad", "ads", "ad-slot", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo-box", "promoted", "promotion", "banner-ad"]), short),
            "nav": lambda: box(self.pick(["nav", "nav", self.named("div", ["menu", "nav", "navbar", "navigation", "main-menu", "breadcrumbs", "breadcrumb", "tabs", "pagination", "pager", "toc", "skip-links"]), self.named("ul", ["menu", "nav-links"])]), self.links()),
            "header": lambda: box(self.pick(["header", self.named("div", ["header", "masthead", "site-header", "topbar", "top", "banner", "brand", "logo"])]), self.pick([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", self.words(1, 5)]) + self.pick(["", self.links()])),
            "side": lambda: box(self.pick(["aside", self.named("div", ["sidebar", "widget", "widgets", "related", "side-bar", "rail", "related-posts", "widget-area", "recommended", "popular", "trending", "archive", "tags", "aside"]), self.named("section", ["related", "recommended"])]), f"<h3>{self.words(1, 3)}</h3>" + self.pick([self.links(), f"<p>{short}</p>"])),
            "footer": lambda: box(self.pick(["footer", "footer", self.named("div", ["footer", "foot", "bottom", "site-footer", "copyright", "page-footer", "colophon", "legal"])]), "&copy; " + self.pick([short, self.links(), f"<p>{short}</p>"])),
            "notice": lambda: box(self.pick([self.named("div", ["cookie-notice", "cookie-banner", "cookies", "consent", "notice", "newsletter", "popup", "modal", "overlay", "gdpr", "alert", "subscription", "paywall"]), "dialog"]), self.pick([short, f"<p>{short}</p><button>{self.words(1, 2)}</button>"])),
            "form": lambda: box(self.pick(["form", "form action='/s'", self.named("div", ["search-form", "search", "form", "login", "signup-form", "register", "contact-form", "subscribe"])]), f"<label>{self.words(1, 4)}</label><input type='text'><button>{self.words(1, 2)}</button>" + self.pick(["", f"<p>{self.words(3, 12)}</p>"])),
            "share": lambda: box(self.named("div", ["share", "sharing", "social", "share-buttons", "social-links", "follow", "print", "tools", "toolbar", "meta"]), self.links()),
            "comments": lambda: box(self.pick([self.named("section", ["comments", "comment-list", "commentlist", "responses", "replies", "discussion"]), self.named("div", ["comments", "disqus_thread", "comment-section", "reader-comments"]), self.named("ol", ["commentlist", "comments"])]), f"<h3>{self.words(1, 3)}</h3>" + "".join(self.pick(["<div class='comment'><p>{}</p></div>", "<li class='comment'>{}</li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>"]).format(self.sentences(int(self.rng.integers(1, 6)))) for _ in range(int(self.rng.integers(1, 6))))),
        }
        names = {"top": ["nav", "header", "ad", "notice", "form", "nav"], "in": ["ad", "share", "notice", "form", "side", "ad"], "end": ["footer", "side", "comments", "nav", "ad", "share", "notice", "form", "comments"]}[where]
        return options[self.pick(names)]()

    def main_block(self) -> tuple[str, bool]:
        r = self.rng.random()
        text = self.sentences(int(self.rng.integers(1, 9)))
        if r < 0.7:
            return self.pick(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p class='text'>{}</p>", "<div>{}</div>", "<p>{} <a href='#'>link</a></p>"]).format(text), True
        if r < 0.8:
            return f"<h2>{self.words(1, 8)}</h2>", True
        if r < 0.87:
            return "<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(4)) + "</ul>", True
        if r < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>", True
        if r < 0.96:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>", True
        return self.pick(["<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>"]).format(self.words(3, 20)), True

    def bare(self, mark) -> str:
        """A page without a wrapper: text, a few blocks, or a table of columns."""
        text = lambda: f"\x01{self.sentences(int(self.rng.integers(1, 9)))}"
        blocks = lambda: "".join(mark(self.main_block()) for _ in range(int(self.rng.integers(1, 6))))
        side = lambda: self.junk(self.pick(["top", "end"]))[0] if self.rng.random() < 0.4 else ""
        shapes = {
            "text": text,
            "broken": lambda: "<br>".join(text() for _ in range(3)),
            "paragraph": lambda: f"<p>{text()}</p>",
            "blocks": lambda: side() + blocks() + side(),
            "mixed": lambda: text() + blocks() + text(),
            "columns": lambda: f"<table><tr><td>{self.links()}</td><td>{blocks()}</td></tr></table>",
            "cells": lambda: "<table>" + "".join(f"<tr><td>{text()}</td><td>{text()}</td></tr>" for _ in range(3)) + "</table>",
        }
        page = shapes[self.pick(list(shapes))]()
        return self.pick(["{}", "{}", "<body>{}</body>", "<html><body>{}</body></html>", "<!doctype html><title>x</title>{}"]).replace("{}", page)

    def page(self) -> str:
        """Kept blocks stand between the control characters 1 and 2, which no tag hides."""
        rng = self.rng
        self.noisy = rng.random() < 0.15

        def mark(block: tuple[str, bool]) -> str:
            return re.sub(r">([^<]+)", lambda m: f">\x01{m[1]}" if m[1].strip() else m[0], block[0]) if block[1] else block[0]

        if rng.random() < 0.05:
            return self.bare(mark)
        title = self.words(1, 9)
        blocks = [(self.pick([f"<h1>{title}</h1>", f"<h1 class='title'>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>"]), True)] if rng.random() < 0.85 else []
        blocks += [self.main_block() for _ in range(int(rng.integers(1, 3 if rng.random() < 0.3 else 12)))]
        for _ in range(int(rng.integers(0, 3)) * (rng.random() < 0.5)):
            blocks.insert(int(rng.integers(0, len(blocks) + 1)), self.junk("in"))
        opening = self.pick(["article", "article", "article", "main", self.named("div", ["content", "post", "entry", "entry-content", "article", "article-body", "story", "main", "main-content", "text", "prose", "blog-post", "page-content", "news"]), self.named("section", ["content", "post-body", "story"]), "div"])
        body = f"<{opening}>" + "".join(map(mark, blocks)) + f"</{opening.split()[0]}>"
        if rng.random() < 0.06:  # blocks that nothing holds together
            body = "".join(map(mark, blocks))
        elif rng.random() < 0.25:
            body = f"<main>{body}</main>" if "main" not in opening else f"<div>{body}</div>"
        top = "".join(mark(self.junk("top")) for _ in range(int(rng.integers(0, 5))))
        end = "".join(mark(self.junk("end")) for _ in range(int(rng.integers(0, 5))))
        if rng.random() < 0.5:
            body = f"<div class='{self.pick(['wrapper', 'container', 'page', 'row', 'layout'])}'>{body}{mark(self.junk('end')) if rng.random() < 0.5 else ''}</div>"
        page = f"<html><head><title>{title}</title><style>p{{}}</style></head><body>{top}{body}{end}"
        return page + "</body></html>" * (rng.random() < 0.8)


@functools.lru_cache(maxsize=2)
def train_extractor(pages: int = 500, seed: int = 3) -> BoostedTrees:
    """Trees from ``pages`` made pages; the bound of the training sample."""
    maker = _Maker(seed)
    made, labels = [], []
    for _ in range(pages):
        page = parse_page(maker.page())
        label = np.zeros(len(page.nodes), bool)
        for node, text in page.pieces:
            label[node] |= "\x01" in text
        for k in range(len(label) - 1, 0, -1):
            label[page.nodes[k].parent] |= label[k]
        made.append(page)
        labels.append(label)
    odds = token_odds(made, labels)
    return fit_trees(np.concatenate([node_features(p, odds) for p in made]), np.concatenate(labels).astype(float), odds)


def _extract(pages: list[Page], model: BoostedTrees) -> list[str]:
    if not pages:
        return []
    logit = model.logit(np.concatenate([model.features(p) for p in pages]))
    out, at = [], 0
    for page in pages:
        n = len(page.nodes)
        kept = decode(np.array([v.parent for v in page.nodes]), logit[at : at + n])
        at += n
        out.append(" ".join("".join(t if kept[k] else " " for k, t in page.pieces).split()))
    return out


def extract_main_text(pages: DataFrame, model: BoostedTrees, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text of the whole page, and ``n_chars``, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some tens of small trees

    def make():
        def compute(sources):
            parsed = [parse_page(s or "") for s in sources]
            text = [t for at in range(0, len(parsed), 64) for t in _extract(parsed[at : at + 64], shared.value)]
            return [text, [len(t) for t in text]]

        return compute

    return map_columns(pages, [html], "text string, n_chars bigint", make, keep)
