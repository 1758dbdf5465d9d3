"""Main-text extraction with a tree-structured graphical model over DOM nodes.

A page is read into a tree of block elements. Each node is content or not;
its potential comes from its tag, class words, text and links, and each edge has a
potential over the labels of parent and child, by kind of child. Messages are
passed upward and then downward (sum-product), which on a tree gives the exact
marginals; the blocks of nodes more likely content than not make the text. The
weights are trained by gradient ascent on the likelihood of labelled pages,
which ``training_pages`` makes: they are pages of many layouts, seeded.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm import common

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
WORDS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

# Elements by role.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp", "noembed", "object"}
#: Those of them that hold plain text: where one is not closed, the rest of the page is its text.
TO_THE_END = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr", "picture", "source",
}
VOID = {"area", "base", "col", "embed", "hr", "input", "link", "meta", "param", "track"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Opening one of these ends an open one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "dl", "select", "body", "html", "div", "section", "article", "main", "td", "th"}
#: Class, id and role words that hint at a kind of block.
HINTS = {
    "nav": {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "topbar", "links", "tabs"},
    "header": {"header", "masthead", "head", "logo", "branding", "site"},
    "footer": {"footer", "foot", "copyright", "legal", "colophon", "contentinfo", "bottom"},
    "side": {"sidebar", "side", "aside", "rail", "widget", "widgets", "complementary", "related", "recommended", "trending", "popular", "more", "recirc", "teaser"},
    "ad": {"ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored", "sponsors", "adsense", "commercial", "outbrain", "taboola"},
    "notice": {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "toast", "disclaimer", "warning", "privacy", "paywall", "dialog"},
    "comment": {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "feedback", "responses", "commentlist", "reviews", "review"},
    "form": {"form", "login", "signup", "subscribe", "subscription", "newsletter", "search", "register", "contact", "input"},
    "share": {"share", "sharing", "social", "tweet", "follow", "likes", "byline", "meta", "tags", "tag", "tools", "toolbar", "author", "print"},
    "main": {"article", "content", "main", "post", "entry", "story", "body", "text", "articlebody", "prose", "copy"},
}
KIND = {w: k for k, words in HINTS.items() for w in words}
#: Kinds of child for edge potentials.
GROUPS = ("box", "text", "heading", "list", "table", "aside")
GROUP = (
    dict.fromkeys(HEADINGS, 2)
    | dict.fromkeys(("p", "blockquote", "pre", "figure", "figcaption"), 1)
    | dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd"), 3)
    | dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), 4)
    | dict.fromkeys(("nav", "header", "footer", "aside", "form", "fieldset", "button", "select", "option", "menu", "dialog", "head", "legend"), 5)
)


class Page:
    """Block tree of a page: per node tag, parent and class words; blocks of text in page order."""

    def __init__(self, source: str):
        self.tags = ["#page"]
        self.parents = [-1]
        self.words: list[tuple[str, ...]] = [()]
        self.own = [0]
        self.linked = [0]
        self.stops = [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [0]
        parts: list[str] = []
        link = False
        at, n = 0, len(source)

        def text(piece: str) -> None:
            if "&" in piece:
                piece = html.unescape(piece)
            if piece:
                parts.append(piece)
                if link:
                    self.linked[stack[-1]] += len(piece)

        def end_block() -> None:
            nonlocal link
            link = False
            if parts:
                block = " ".join("".join(parts).split())
                parts.clear()
                if block:
                    node = stack[-1]
                    self.blocks.append((node, block))
                    self.own[node] += len(block)
                    self.stops[node] += block.count(". ") + block.count(", ") + (block[-1] in ".!?")

        while at < n:
            m = TAG.search(source, at)
            if not m:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name in RAW:
                if not closing and not attributes.endswith("/"):
                    found = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
                    if found:
                        at = max(source.find(">", found.start()) + 1, found.end())
                    elif name in TO_THE_END:
                        at = n
                continue
            if name in INLINE:
                if name == "a":
                    link = not closing
                elif name == "br":
                    parts.append(" ")
                continue
            end_block()
            if name in VOID:
                continue
            if closing:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if self.tags[stack[d]] == name), 0)
                if depth:
                    del stack[depth:]
                continue
            if self.tags[stack[-1]] == "p" or self.tags[stack[-1]] in HEADINGS and name in HEADINGS:
                stack.pop()
            ends = ENDS.get(name)
            if ends:
                for d in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[d]] in ends:
                        del stack[d:]
                        break
                    if self.tags[stack[d]] in SCOPE:
                        break
            self.tags.append(name)
            self.parents.append(stack[-1])
            words = ()
            if attributes:
                found = [w.lower() for m3 in WORDS.findall(attributes) for w in SPLIT.split("".join(m3)) if w]
                words = tuple(dict.fromkeys(KIND[w] for w in found if w in KIND))
            self.words.append(words)
            for counts in (self.own, self.linked, self.stops):
                counts.append(0)
            stack.append(len(self.tags) - 1)
        end_block()

    def features(self) -> list[tuple[str, ...]]:
        """Names of the active features of each node."""
        n = len(self.tags)
        whole, linked = self.own[:], self.linked[:]
        for i in range(n - 1, 0, -1):
            whole[self.parents[i]] += whole[i]
            linked[self.parents[i]] += linked[i]
        out = []
        for i in range(n):
            tag, own = self.tags[i], self.own[i]
            f = ["bias", "tag " + (tag if tag in GROUP or tag in KNOWN else "other")]
            f += ["hint " + w for w in self.words[i]]
            if not self.words[i]:
                f.append("no hint")
            f.append(f"own {_bin(own)}")
            f.append(f"whole {_bin(whole[i])}")
            if whole[i]:
                f.append(f"links {min(3, 4 * linked[i] // max(1, whole[i]))}")
            if own:
                f.append(f"stops {min(3, self.stops[i])}")
            out.append(tuple(f))
        return out


KNOWN = {"div", "section", "article", "main", "body", "html", "center", "#page"}


def _bin(n: int) -> int:
    return 0 if not n else 1 + (n > 25) + (n > 80) + (n > 250) + (n > 1000)


class TreeModel:
    """Node weights by feature, and for each kind of child a 2 x 2 table over (parent's label, child's label)."""

    def __init__(self):
        self.node: dict[str, float] = {}
        self.edge = [[[0.5, -0.5], [-0.5, 0.5]] for _ in GROUPS]

    def marginals(self, page: Page, features=None, edges: bool = False):
        """P(content) of every node; with ``edges`` also each child's joint distribution with its parent."""
        n, parents = len(page.tags), page.parents
        weight = self.node.get
        base = [sum(weight(f, 0.0) for f in fs) for fs in (features or page.features())]
        group = [GROUP.get(t, 0) for t in page.tags]
        up = [0.0] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):  # children come after their parents
            (e00, e01), (e10, e11) = self.edge[group[i]]
            b = exp(min(30.0, max(-30.0, base[i])))
            up[i] = log((exp(e10) + exp(e11) * b) / (exp(e00) + exp(e01) * b))
            base[parents[i]] += up[i]
        # base now holds each node's own potential and its children's messages; add the parent's on the way down
        joint = [None] * n
        for i in range(1, n):
            (e00, e01), (e10, e11) = self.edge[group[i]]
            a = exp(min(30.0, max(-30.0, base[parents[i]] - up[i])))
            if edges:
                b = exp(min(30.0, max(-30.0, base[i])))
                j = (exp(e00), exp(e01) * b, a * exp(e10), a * exp(e11) * b)
                total = sum(j)
                joint[i] = tuple(x / total for x in j)
            base[i] += log((exp(e01) + exp(e11) * a) / (exp(e00) + exp(e10) * a))
        p = [1 / (1 + exp(-min(30.0, max(-30.0, x)))) for x in base]
        return (p, joint) if edges else p

    def train(self, pages: list[tuple[Page, list[int]]], epochs: int = 14, rate: float = 0.25, decay: float = 1e-4):
        """Gradient ascent on the labels' likelihood: features and label pairs, observed less expected."""
        known = [(page, page.features(), labels) for page, labels in pages]
        order = random.Random(11)
        mean: dict[str, float] = {}
        tables = [[[0.0, 0.0], [0.0, 0.0]] for _ in GROUPS]
        counted = epochs - epochs // 2
        for epoch in range(epochs):
            step = rate / (1 + 0.3 * epoch)
            order.shuffle(known)
            for page, features, labels in known:
                p, joint = self.marginals(page, features, edges=True)
                scale = step / math.sqrt(len(p))
                for f, y, q in zip(features, labels, p, strict=True):
                    if abs(y - q) > 1e-3:
                        for name in f:
                            self.node[name] = self.node.get(name, 0.0) * (1 - decay) + scale * (y - q)
                for i in range(1, len(p)):
                    table = self.edge[GROUP.get(page.tags[i], 0)]
                    seen = 2 * labels[page.parents[i]] + labels[i]
                    for k in range(4):
                        table[k >> 1][k & 1] += scale * ((k == seen) - joint[i][k])
            if epoch >= epochs // 2:  # the weights' mean over the later passes is kept
                for name, w in self.node.items():
                    mean[name] = mean.get(name, 0.0) + w / counted
                for into, table in zip(tables, self.edge, strict=True):
                    for k in range(4):
                        into[k >> 1][k & 1] += table[k >> 1][k & 1] / counted
        self.node, self.edge = mean, tables
        return self

    def text(self, source: str) -> str:
        page = Page(source)
        p = self.marginals(page)
        return "\n".join(block for node, block in page.blocks if p[node] >= 0.5)


# ---------------------------------------------------------------------------
# Labelled pages.


def training_pages(n: int = 400, seed: int = 3) -> list[tuple[str, set[str]]]:
    """Pages of many layouts, each with the set of its content blocks. Every block's text occurs once in its page."""
    r = random.Random(seed)
    serial = iter(range(10**9))

    def words(least: int, most: int) -> str:
        made = [
            "".join(r.choice(("an", "re", "ti", "on", "que", "ver", "sch", "la", "mo", "ed")) for _ in range(r.randint(1, 4)))
            for _ in range(r.randint(least, most))
        ]
        return f"{' '.join(made)} n{next(serial)}"

    def sentence(least: int, most: int) -> str:
        s = words(least, most)
        if r.random() < 0.5:
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + r.choice((".", ".", ".", "", "!", "?"))

    def prose(sentences: int) -> str:
        return " ".join(sentence(3, 18) for _ in range(r.randint(1, sentences)))

    def attribute(kind: str) -> str:
        if r.random() < 0.12:
            return ""
        word = r.choice(sorted(HINTS[kind]))
        return f' {r.choice(("class", "class", "id"))}="{word}{r.choice(("", "", "-box", " x1", "_2"))}"'

    def links(k: int) -> str:
        rows = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))
        return f"<ul>{rows}</ul>"

    def para(tag: str = "p") -> str:
        return f"<{tag}>{prose(3)}</{tag}>"

    def boilerplate() -> str:
        kind = r.choice(("nav", "header", "footer", "side", "ad", "notice", "comment", "comment", "form", "share"))
        own = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        named = r.random() < 0.5 and own != "div"
        tag = own if named else r.choice(("div", "section", "div"))
        hint = "" if named and r.random() < 0.7 else attribute(kind) or f' class="{r.choice(sorted(HINTS[kind]))}"'
        if kind == "nav":
            inside = links(r.randint(2, 8)) if r.random() < 0.7 else " | ".join(f'<a href="/y">{words(1, 2)}</a>' for _ in range(5))
        elif kind == "header":
            inside = f'<h2><a href="/">{words(1, 4)}</a></h2>' + (f"<p>{words(2, 8)}</p>" if r.random() < 0.5 else "")
        elif kind == "footer":
            inside = r.choice((f"&copy; {words(1, 3)} &middot; {prose(2)}", f"<p>&copy; {prose(2)}</p>", links(4)))
        elif kind == "side":
            inside = f"<h3>{words(1, 3)}</h3>" + r.choice((links(4), para() + para(), f"<p>{words(3, 12)}</p>"))
        elif kind == "comment":
            rows = "".join(f'<div{attribute("comment")}><p>{prose(3)}</p></div>' for _ in range(r.randint(1, 4)))
            inside = r.choice((f"<h3>{words(1, 3)}</h3>", "")) + r.choice((rows, para() + para(), f"<ol><li>{prose(2)}</li><li>{prose(2)}</li></ol>"))
        elif kind == "form":
            inside = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + (para() if r.random() < 0.3 else "")
        else:
            inside = r.choice((prose(2), para(), f"<p>{words(2, 9)}</p>", f'<a href="/z">{words(2, 6)}</a>'))
        return f"<{tag}{hint}>{inside}</{tag}>"

    pages = []
    for _ in range(n):
        body: list[str] = []
        good: list[str] = []

        def keep(tag: str, text: str, good=good) -> str:
            good.append(" ".join(html.unescape(text).split()))
            inner = text.replace(" ", " <b>", 1) + "</b>" if r.random() < 0.1 else text
            return f"<{tag}>{inner}" + ("" if tag == "p" and r.random() < 0.1 else f"</{tag}>")

        article = []
        if r.random() < 0.85:
            article.append(keep(r.choice(("h1", "h1", "h2")), sentence(1, 12)))
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6, 8))):
            x = r.random()
            if x < 0.72:
                y = r.random()
                plain = sentence(1, 3) if y < 0.2 else words(10, 200) if y < 0.3 else prose(r.choice((1, 1, 3, 6)))
                article.append(keep("p", plain))
            elif x < 0.8:
                article.append(keep("h2", sentence(1, 6)))
            elif x < 0.86:
                article.append("<ul>" + "".join(keep("li", prose(1)) for _ in range(3)) + "</ul>")
            elif x < 0.9:
                article.append("<blockquote>" + keep("p", prose(2)) + "</blockquote>")
            elif x < 0.93:
                article.append("<table><tr>" + keep("td", words(1, 5)) + keep("td", words(1, 5)) + "</tr></table>")
            else:
                article.append(boilerplate())
        inner = "".join(article)
        layout = r.random()
        if layout < 0.45:
            inner = f"<article>{inner}</article>"
        elif layout < 0.6:
            inner = f"<main>{inner}</main>"
        elif layout < 0.9:
            inner = f'<div{attribute("main")}>{inner}</div>'
        if r.random() < 0.3:
            inner = f"<div>{inner}</div>"
        before = [boilerplate() for _ in range(r.randint(0, 4))]
        after = [boilerplate() for _ in range(r.randint(0, 4))]
        body = [*before, inner, *after]
        if r.random() < 0.2:
            body = ["<div class=wrap>", *body, "</div>"]
        pages.append((f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(body)}</body></html>", set(good)))
    return pages


def labelled(source: str, good: set[str]) -> tuple[Page, list[int]]:
    """A page and its nodes' labels: content if most of the text below a node is."""
    page = Page(source)
    mine, whole = [0] * len(page.tags), [0] * len(page.tags)
    for node, block in page.blocks:
        mine[node] += len(block) * (block in good)
        whole[node] += len(block)
    for i in range(len(page.tags) - 1, 0, -1):
        mine[page.parents[i]] += mine[i]
        whole[page.parents[i]] += whole[i]
    return page, [int(2 * m > w) for m, w in zip(mine, whole, strict=True)]


_trained: list[TreeModel] = []


def trained_model() -> TreeModel:
    """The model fitted on the labelled pages, once per process."""
    if not _trained:
        _trained.append(TreeModel().train([labelled(*p) for p in training_pages()]))
    return _trained[0]


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    A null html counts as empty and gives an empty text. Null ids and urls stay
    null; repeated rows each give a row; extra columns are dropped; an empty table
    gives an empty result. Unclosed and stray tags are read as browsers do, a page
    of any length whole.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    model = model or trained_model()
    sent = spark.sparkContext.broadcast((model.node, model.edge))  # a few hundred weights
    rows = pages.select(pages["page_id"], pages["url"], pages["html"].cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TreeModel()
        own.node, own.edge = sent.value
        for batch in batches:
            texts = [own.text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages", "page_id", "url", "html"))
