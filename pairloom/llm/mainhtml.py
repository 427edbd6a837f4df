"""The main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of element names from the root to it. Text length and punctuation are
summed for each path and divided by its number of blocks; the two ratios are smoothed along the page, scaled and fused
with the share of text outside links; paths of which the fused value reaches a part of the page's spread are content. The
smallest element around all content blocks gives the article: everything in it stays, but for parts that say by their
element, role or class that they are something else (menus, forms, comments and so on).

Pages are judged one by one, whole, in a single pass over the table without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title template".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr caption colgroup ul listing plaintext".split())
ENDS_P = BLOCKS - frozenset("html head body tbody td tfoot th thead tr caption colgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that end an open element of these names, up to the element that holds them.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())

# Elements, roles and words in classes or ids that mark a part as no article text.
OTHER = frozenset("head nav aside footer form script style noscript template iframe textarea select optgroup option button svg object "
                  "menu dialog canvas audio video noembed noframes xmp datalist title search".split())
WITHIN = OTHER - BLOCKS  # these may stand within a block without ending it
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promoted promotion recommended related replies respond responses share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tagcloud teaser toc toolbar widget".split())
ARTICLES = frozenset(["article", "main"])
NEGATED = frozenset("no has with without hide".split())  # `no-sidebar` says nothing about the element itself
ARTICLE_WORDS = frozenset("article articlebody articlecontent entrycontent postbody postcontent storybody storycontent".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
QUOTE = re.compile(r"""["'>]""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।]")
SMOOTH = np.exp(-np.arange(-2, 3) ** 2 / 2)  # weights of a block and its neighbours
PART = 0.5  # of the spread of fused values, which content paths reach
OUTSIDE = 0.05  # weight of paths outside an article element on pages that have one


class Block(NamedTuple):
    element: int
    path: int
    text: str
    linked: int  # characters within links


class Page:
    """Elements and text blocks of a page, in page order; malformed markup is mended much as browsers do."""

    def __init__(self, html: str, forms: bool = True, words: bool = True):
        """Without `forms` or `words`, forms or words in classes do not mark parts as other than the article."""
        self.forms, self.words = forms, words
        self.names, self.parents, self.paths = ["#page"], [-1], [0]
        self.other, self.article, self.inside = [False], [False], [False]  # inside: an article, or within one
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.stack, self.inline, self.links = [0], [], 0
        self.depth: Counter[str] = Counter()  # open elements by name
        self.endless: set[str] = set()  # raw elements that no tag ends from here on
        self.parts: list[str] = []
        self.linked: list[bool] = []
        self.read(html)
        self.flush()

    def read(self, html: str) -> None:
        at, end, broken = 0, len(html), False
        while at < end:
            start = html.find("<", at)
            if start < 0:
                break
            if start > at:
                self.say(html[at:start])
            if html.startswith("<!--", start):
                shut = html.find("-->", start + 2)
                at = end if shut < 0 else max(shut, start + 1) + 3
            elif html.startswith(("<!", "<?"), start):
                if html.startswith("<![CDATA[", start) and (shut := html.find("]]>", start)) >= 0:
                    self.say(html[start + 9:shut].replace("&", "&amp;"))
                    at = shut + 3
                else:
                    shut = html.find(">", start)
                    at = end if shut < 0 else shut + 1
            elif name := NAME.match(html, start + 1):
                shut, broken = self.tag_end(html, name.end(), broken)
                tag = name[0].lower()
                self.open(tag, html[name.end():shut])
                at = shut + 1
                if tag == "plaintext":
                    self.say(html[at:].replace("&", "&amp;"))
                    at = end
                elif tag in RAW:  # markup within is text, up to its own end tag
                    close = None if tag in self.endless else re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    if close is None:
                        self.endless.add(tag)
                    if close is None and tag in ("noscript", "template", "title"):
                        continue  # cut off or never closed: read on
                    at = end if close is None else close.start()
            elif name := NAME.match(html, start + 2) if html.startswith("</", start) else None:
                shut, broken = self.tag_end(html, name.end(), broken)
                self.close(name[0].lower())
                at = shut + 1
            elif html.startswith("</", start):
                shut = html.find(">", start)
                at = end if shut < 0 else shut + 1
            else:
                self.say("<")
                at = start + 1
        if at < end:
            self.say(html[at:])

    @staticmethod
    def tag_end(html: str, at: int, broken: bool) -> tuple[int, bool]:
        """Where a tag's `>` is, outside quotes; once a quote never ends, all later tags end at their first `>`."""
        if not broken:
            i, value = at, False
            while m := QUOTE.search(html, i):
                if m[0] == ">":
                    return m.start(), False
                value = html[i:m.start()].rstrip().endswith("=") or value
                if not html[i:m.start()].rstrip().endswith("="):
                    i = m.end()  # a stray quote
                    continue
                shut = html.find(m[0], m.end())
                if shut < 0:
                    broken = True
                    break
                i = shut + 1
        shut = html.find(">", at)
        return (len(html) if shut < 0 else shut), broken

    def say(self, raw: str) -> None:
        if not self.other[self.stack[-1]]:
            self.parts.append(raw)
            self.linked.append(self.links > 0)

    def flush(self) -> None:
        """End the current block."""
        if not self.parts:
            return
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            linked = len(" ".join(unescape("".join(p for p, of in zip(self.parts, self.linked) if of)).split())) if any(self.linked) else 0
            element = self.stack[-1]
            self.blocks.append(Block(element, self.paths[element], text, linked))
        self.parts, self.linked = [], []

    def open(self, tag: str, rest: str) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.say(" ")
            return
        if tag not in BLOCKS and tag not in RAW and tag not in OTHER:
            if tag in VOID:
                return
            if not rest.endswith("/"):
                self.inline.append(tag)
                self.links += tag == "a"
            return
        if tag in ("html", "body") and tag in [self.names[e] for e in self.stack[:4]]:
            return
        if tag in VOID:  # a rule or a field: only ends a block
            if tag == "hr":
                self.flush()
                self.end_p()
            return
        if tag not in WITHIN:
            self.flush()
        if tag not in HEAD_ONLY and self.names[self.stack[-1]] == "head":
            self.pop()
        if tag in ENDS_P:
            self.end_p()
        if tag in HEADINGS and self.names[self.stack[-1]] in HEADINGS:
            self.pop()
        ends, holders = SIBLINGS.get(tag, ((), ()))
        if any(self.depth[name] for name in ends):
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.names[self.stack[depth]]
                if name in holders:
                    break
                if name in ends:
                    self.cut(depth)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        parent = self.stack[-1]
        other, article = self.judge(tag, rest)
        self.names.append(tag)
        self.parents.append(parent)
        self.other.append(other or self.other[parent])
        self.article.append(article)
        self.inside.append(article or self.inside[parent])
        self.paths.append(self.known.setdefault((self.paths[parent], tag), len(self.known) + 1))
        self.stack.append(len(self.names) - 1)
        self.depth[tag] += 1
        if tag not in WITHIN:
            self.inline, self.links = [], 0

    def judge(self, tag: str, rest: str) -> tuple[bool, bool]:
        """Whether an element is no part of an article, and whether it is one."""
        attributes = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(rest)} if rest.strip("/ ") else {}
        names = [w for key in ("class", "id") for w in attributes.get(key, "").split()]
        role = attributes.get("role", "").lower()
        article = tag in ARTICLES or role in ("main", "article") or attributes.get("itemprop", "") == "articleBody" or any(
            w.lower().replace("-", "").replace("_", "") in ARTICLE_WORDS for w in names)
        if (tag in OTHER or role in OTHER_ROLES) and (self.forms or tag != "form"):
            return True, False
        if tag in ("html", "body"):
            return False, False
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
            return True, False
        parts = [[p.lower() for p in WORD.findall(w)] for w in names] if self.words else []
        words = {p for own in parts if own and own[0] not in NEGATED for p in own}
        if tag == "header" and not self.inside[self.stack[-1]]:
            return True, False  # of the page, not of the article
        other = bool(words & OTHER_WORDS) and not (article and tag in ("main", "article") and "comment" not in words and "comments" not in words)
        return other, article and not other

    def cut(self, depth: int) -> None:
        """Close the elements from this depth on."""
        for e in self.stack[depth:]:
            self.depth[self.names[e]] -= 1
        del self.stack[depth:]

    def pop(self) -> None:
        self.cut(len(self.stack) - 1)
        self.inline, self.links = [], 0

    def end_p(self) -> None:
        if self.names[self.stack[-1]] == "p":
            self.pop()

    def close(self, tag: str) -> None:
        if tag == "br":
            self.say(" ")
        elif tag in ("html", "body"):
            self.flush()  # what follows still belongs to the body
        elif tag in BLOCKS or tag in RAW or tag in OTHER:
            if not any(self.depth[name] for name in (HEADINGS if tag in HEADINGS else (tag,))):
                return
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.names[self.stack[depth]]
                if name == tag or tag in HEADINGS and name in HEADINGS:
                    if tag not in WITHIN:
                        self.flush()
                        self.inline, self.links = [], 0
                    self.cut(depth)
                    return
                if name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    return
        elif tag in self.inline[-64:]:
            while self.inline:
                last = self.inline.pop()
                self.links -= last == "a"
                if last == tag:
                    break


def ratios(blocks: list[Block], inside: np.ndarray) -> np.ndarray:
    """Whether each block's path is content: text and punctuation ratios of paths, smoothed, fused and held against their spread."""
    _, path = np.unique([b.path for b in blocks], return_inverse=True)
    total = lambda x: np.bincount(path, x)
    chars = np.array([len(b.text) for b in blocks], float)
    number, length = total(np.ones(len(blocks))), total(chars)
    plain = 1 - np.minimum(total(np.array([b.linked for b in blocks], float)) / length, 1)
    marks = total(np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float))
    smooth = lambda x: np.convolve(x, SMOOTH, "same") / np.convolve(np.ones(len(x)), SMOOTH, "same") if len(x) >= len(SMOOTH) else x
    along = [smooth((r / number)[path]) for r in (length, marks)]
    text, points = (x / max(x.max(), 1e-9) for x in along)
    fused = text * (0.1 + points) * plain[path] * np.where(inside, 1, OUTSIDE)
    level = total(fused) / number
    return (level >= min(PART * level[path].std(), level.max()))[path]


def main_text(html: str) -> str:
    """The article's blocks, joined by line ends; empty if the page has none."""
    for forms, words in ((True, True), (False, True), (False, False)):  # a form or a marked part may hold the whole page
        page = Page(html, forms, words)
        if page.blocks:
            break
    blocks = page.blocks
    if not blocks:
        return ""
    article = page.article
    inside = np.array([page.inside[b.element] for b in blocks])
    content = ratios(blocks, inside if inside.any() else np.ones(len(blocks), bool))
    # Blocks and content blocks below each element; children come after their parents.
    held, picked, heads = ([0] * len(article) for _ in range(3))
    for b, good in zip(blocks, content.tolist()):
        held[b.element] += 1
        picked[b.element] += good
        heads[b.element] += page.names[b.element] in HEADINGS
    for counts in (held, picked, heads):
        for e in range(len(article) - 1, 0, -1):
            counts[page.parents[e]] += counts[e]
    whole = picked[0]
    top = max((e for e in range(len(article)) if picked[e] == whole), default=0)  # the deepest: it comes last
    around = top
    while around and not article[around]:
        around = page.parents[around]
    if around:
        top = around
    while top and page.names[up := page.parents[top]] not in ("#page", "html", "body") and held[up] - held[top] == heads[up] - heads[top]:
        top = up  # only headings are added
    below = [False] * len(article)
    below[top] = True
    for e in range(top + 1, len(article)):
        below[e] = below[page.parents[e]]
    loose = page.names[top] in ("#page", "html", "body")
    links = [b.linked * 3 > len(b.text) * 2 and page.names[b.element] == "li" for b in blocks]
    return "\n".join(b.text for b, good, menu in zip(blocks, content.tolist(), links)
                     if below[b.element] and (good or not loose or page.names[b.element] in HEADINGS) and not (menu and not good))


def extract(pages: DataFrame, html: str = "html", into: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """`pages` without `html`, with the main text and its length in code points; columns of these names (`into`) are replaced.

    Character references are decoded, white space within a block becomes one space, blocks are joined by one line end. Null,
    empty and article-less pages give an empty text. Rows are judged one by one, so repeated rows give equal results and
    an empty table an empty one; nulls in other columns stay.
    """
    kept = [c for c in pages.columns if c != html and c.lower() not in [x.lower() for x in into]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], *into])

    rows = pages.select(F.col(html).cast("string").alias("_page"), *(F.col(f"`{c}`") for c in kept))
    schema = pages.select(*(F.col(f"`{c}`") for c in kept)).schema
    for name, kind in zip(into, ("string", "long")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
