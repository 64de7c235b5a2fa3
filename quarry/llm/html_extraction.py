"""Main text of web pages by the maximum-scoring subsequence of tokens.

A page is read as a sequence of tokens: runs of text, and tags. Words score by
the container they stand in and by being link text, tags score negative; the
weights are log odds learnt from labelled pages (pages that mark their content
with one ``article`` or ``main`` element; a bounded sample of ``SAMPLE`` pages
by a hash of the id), on top of a fixed default for containers that the labelled
pages do not show; excluded text teaches nothing about its container. Text in
an ``article`` or ``main`` element weighs at least the default, and is never
left out because its container mostly stands elsewhere. One linear scan finds the contiguous region with the
highest score; the text of the region, without the excluded containers inside
it, is the main text.

Excluded in any place: menus, page headers, footers, side bars, notices,
adverts, forms, scripts, styles, comments and hidden elements, by tag, role or
class word. Inside content a class has to name furniture as a whole ("ad-slot",
not "search-methods"), and so has the id of a ``div``; ids of other elements
are anchors. Outside of content one word is enough, but a name (or a form) around
it never takes a ``main`` element away, nor an ``article`` of a page that has
no other text in one; and a page that such names empty is read again with
names that as a whole name furniture. The work is a map over the pages: no
shuffle, linear in a page's length, and the model is bounded by the sample.

Defined cases: a null, empty or text-free page has empty text; unclosed,
misnested and cut-off tags are read as browsers do (a tag without end is
dropped, an open element ends with its parent); ids may be null or repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_sample, id_as_text, python_ready, text_or_empty

SAMPLE = 2_000
MOST = 3.0            # bound of a learnt word weight
TAG_LEAST, TAG_MOST = 0.02, 0.1
EXCLUDED_WORD = 0.02  # cost of a word that is left out anyway
UNKNOWN = 1.0         # weight of a container that the labelled pages do not show
DROP = -2.0           # containers below this weight are left out inside a region

# fixed values: HTML element names, and words of class, id and role that name page furniture
RAW = {"script", "style", "noscript", "textarea", "title", "template", "iframe", "object",
       "svg", "canvas", "audio", "video", "noframes", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
CONTENT = {"article", "main"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu",
             "head", "label", "datalist", "output", "progress", "annotation", "annotation-xml"}
# of these, what an article's text can hold
TEXT_TOO = {"label", "output"}
INLINE = {"label", "output", "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub",
          "msubsup", "mfrac", "annotation", "annotation-xml", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "mpadded", "mfenced",
          "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
# an open paragraph ends where one of these begins
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div",
          "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
          "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense",
         "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
         "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter",
         "subscribe", "subscription", "signup", "nav", "navbar", "navigation", "menu", "submenu",
         "breadcrumb", "breadcrumbs", "sidebar", "sidenav", "aside", "widget", "widgets", "footer",
         "masthead", "topbar", "toolbar", "comment", "comments", "disqus", "respond", "replies",
         "share", "sharing", "social", "related", "recommended", "recommendations", "pagination",
         "pager", "login", "search", "skip", "legal", "copyright", "disclaimer", "contentinfo",
         "complementary", "hidden"}
PAGE_HEADER = {"header", "banner"}
# words that beside one of WORDS do not make a class name something else
BOX = {"slot", "box", "container", "wrapper", "wrap", "block", "unit", "bar", "area", "link", "links",
       "list", "item", "items", "button", "buttons", "icon", "icons", "form", "panel", "region",
       "inner", "outer", "header", "content", "site", "page", "post", "posts", "article", "articles",
       "story", "stories", "entry", "main", "primary", "secondary", "top", "bottom", "left", "right",
       "visually", "x"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*+(?:>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_NAMED = {"class", "id", "role"}
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


@dataclass
class Run:
    """A run of text or a tag, with the container that holds it."""
    tag: str            # tag name for a tag, "" for text
    text: str = ""
    key: str = ""       # container
    link: bool = False
    excluded: bool = False
    block: int = 0      # number of the block that the text belongs to
    content: bool = False
    element: bool = False  # in an article or main element


def _names_furniture(token: str) -> bool:
    parts = [p.lower() for p in _PART.findall(token)]
    return any(p in WORDS for p in parts) and all(p in WORDS or p in BOX or p.isdigit() for p in parts)


def _attributes(attrs: str) -> tuple[set[str], dict[str, list[str]], str, bool]:
    """(words of class, id and role; their tokens; first class; hidden)."""
    words: set[str] = set()
    tokens: dict[str, list[str]] = {}
    first, hidden = "", False
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        value = value[1:-1] if value[:1] in ('"', "'") and value[-1:] == value[:1] != value else value
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value.lower() == "true"
        elif name in _NAMED:
            words.update(p.lower() for p in _PART.findall(value))
            tokens.setdefault(name, []).extend(value.split())
            first = first or (value.split() or [""])[0]
    return words, tokens, first, hidden


# why text is left out: not, by a name around content, as an article in such a name, in any case
KEEP, NAMED, ARTICLE, GONE = range(4)


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.I | re.A)


def runs(page: str, whole_names: bool = False) -> list[Run]:
    """The page as a sequence of text runs and tags, in page order. With
    ``whole_names`` a class has to name furniture as a whole everywhere."""
    out: list[Run] = []
    stack: list[tuple[str, str, int, bool, bool]] = []  # tag, key, why left out, content, element
    open_tags: Counter[str] = Counter()
    links, block, at = 0, 0, 0
    left_out: list[int] = []

    def close(tag: str) -> None:
        while True:
            name = stack.pop()[0]
            open_tags[name] -= 1
            if name == tag:
                return

    def enter(tag: str, key: str, why: int, content: bool, element: bool) -> None:
        stack.append((tag, key, why, content, element))
        open_tags[tag] += 1

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            _, key, why, content, element = stack[-1] if stack else ("", "", KEEP, False, False)
            out.append(Run("", m["text"], key, links > 0, False, block, content, element))
            left_out.append(why)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag or not page.endswith(">", 0, at):
            continue  # comment, declaration, or a tag that the page's end cuts off
        attrs, closing = m["attrs"] or m["attrs2"] or "", bool(m["end"] or m["end2"])
        if tag == "a":
            links = 0 if closing else 1
        if tag not in INLINE and tag not in RAW:
            block += 1
            links = 0
        out.append(Run(tag, block=block))
        left_out.append(stack[-1][2] if stack else KEEP)
        if closing:
            if open_tags[tag]:
                close(tag)
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.start() if end else len(page)
            if not attrs.endswith("/") or tag != "svg":
                enter(tag, tag, GONE, False, False)
            continue
        if tag in VOID:
            continue
        words, tokens, first, hidden = _attributes(attrs) if attrs.strip() else (set(), {}, "", False)
        if tag in ENDS_P and open_tags["p"]:
            close("p")
        if tag == "li" and stack and stack[-1][0] == "li":
            close("li")
        _, key, why, content, element = stack[-1] if stack else ("", "", KEEP, False, False)
        if content or whole_names:
            whole = tokens.get("class", []) + (tokens.get("id", []) if tag == "div" else [])
            named = (any(t.lower() in WORDS for t in tokens.get("role", []))
                     or any(_names_furniture(t) for t in whole))
        else:
            named = bool(words & WORDS)
        outside = not content
        content = content or tag in CONTENT or "main" in words and tag != "body"
        furniture = tag in FURNITURE and (outside or tag not in TEXT_TOO)
        header = (tag == "header" or bool(words & PAGE_HEADER)) and not content
        inside = KEEP
        if hidden:
            inside = GONE
        elif tag in CONTENT:
            # what a name or a form around it leaves out is not lost with an element of content
            why = KEEP if why == NAMED and tag == "main" else ARTICLE if why == NAMED else why
        elif tag not in ("html", "body") and (furniture or named or header):
            soft = outside and not header and (tag == "form" or not furniture)
            inside = NAMED if soft else GONE
        if tag in INLINE and not inside:
            continue
        if tag not in INLINE and (first or tag in CONTENT or tag not in ("p", "li", "td", "th", "tr")):
            key = f"{tag}.{first}" if first else tag
        # in an article that may come back, furniture stays out
        why = GONE if inside and why == ARTICLE else max(why, inside)
        enter(tag, key, why, content, element or tag in CONTENT)
    lost = any(why == KEEP and run.element and not run.tag and run.text.strip() for run, why in zip(out, left_out))
    for run, why in zip(out, left_out):
        run.excluded = why in (NAMED, GONE) or why == ARTICLE and lost
    return out


@dataclass
class Weights:
    """Learnt word weights by container, and tag weights (0 to 1, a cost)."""
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def container(self, run: Run) -> float:
        weight = self.words.get(run.key, UNKNOWN)
        return max(weight, UNKNOWN) if run.element else weight

    def word(self, run: Run) -> float:
        weight = self.container(run)
        return weight - 1.5 if run.link else weight


def best_region(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the greatest positive sum, in
    one scan; the first and shortest of equal ones, (0, 0) without any."""
    best = score = 0.0
    begin = start = end = 0
    for i, value in enumerate(values):
        if score <= 0:
            score, begin = 0.0, i
        score += value
        if score > best:
            best, start, end = score, begin, i + 1
    return start, end


def _region_text(tokens: list[Run], weights: Weights) -> str:
    kept: list[bool] = []
    values: list[float] = []
    for run in tokens:
        keep = False
        if run.tag:
            value = 0.0 if run.excluded else -weights.tags.get(run.tag, TAG_MOST)
        else:
            n = len(run.text.split())
            weight = weights.word(run)
            keep = not run.excluded and weights.container(run) > DROP
            value = n * weight if keep else -n * EXCLUDED_WORD
        kept.append(keep)
        values.append(value)
    start, end = best_region(values)
    blocks: dict[int, list[str]] = {}
    for run, keep in zip(tokens[start:end], kept[start:end]):
        if run.tag == "br":
            blocks.setdefault(run.block, []).append(" ")
        elif keep:
            blocks.setdefault(run.block, []).append(run.text)
    joined = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def main_text(page: str, weights: Weights) -> str:
    """Text of the best region, blocks joined by an empty line."""
    return _region_text(runs(page), weights) or _region_text(runs(page, whole_names=True), weights)


def learn(pages: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE) -> Weights:
    """Weights from the pages that mark one content element."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for page in batch["html"]:
                for run in runs(page):
                    if not run.tag:
                        # excluded words make up the outside, but say nothing about a container
                        entry = seen.setdefault(("word", "" if run.excluded else run.key), [0, 0])
                        entry[run.excluded or not run.content] += len(run.text.split())
            # tags count where they stand: between the first and last content word or not
                tokens = runs(page)
                at = [i for i, r in enumerate(tokens) if not r.tag and r.content and not r.excluded
                      and r.text.strip()]
                for i, run in enumerate(tokens):
                    if run.tag:
                        inside = bool(at) and at[0] < i < at[-1]
                        seen.setdefault(("tag", run.tag), [0, 0])[not inside] += 1
            yield pd.DataFrame([(kind, key, a, b) for (kind, key), (a, b) in seen.items()],
                               columns=["kind", "key", "n_in", "n_out"])

    marked = (pages.select(F.col(id_col).alias("id"), text_or_empty(html_col).alias("html"))
              .where(F.regexp_count("html", F.lit("(?i)<(article|main)[ >]")) == 1))
    picked = hash_sample(marked.withColumn("h", F.xxhash64("html")), sample, marked.count(), "id", "h")
    rows = (picked.mapInPandas(count, "kind string, key string, n_in bigint, n_out bigint")
            .groupBy("kind", "key").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
            .collect())  # every container and tag of the sample's pages
    out = Weights()
    for kind, found in (("word", out.words), ("tag", out.tags)):
        some = [r for r in rows if r["kind"] == kind]
        inside, outside = sum(r["n_in"] for r in some) + 1, sum(r["n_out"] for r in some) + 1
        for r in some:
            odds = math.log((r["n_in"] + 1) / inside) - math.log((r["n_out"] + 1) / outside)
            if kind == "word" and r["key"] != "":
                # a container that stands in content alone weighs no less than an unknown one
                least = -MOST if r["n_out"] else UNKNOWN
                found[r["key"]] = max(least, min(MOST, odds))
            elif kind == "tag":
                # the more a tag belongs outside of content, the more it costs
                found[r["key"]] = TAG_LEAST + (TAG_MOST - TAG_LEAST) / (1 + math.exp(odds))
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars."""
    python_ready(pages)
    weights = weights or learn(pages, id_col, html_col)
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"],
                                "text": [main_text(p, weights) for p in batch["html"]]})

    return (pages.select(id_as_text(id_col).alias("id"), F.col(url_col).alias("url"),
                         text_or_empty(html_col).alias("html"))
            .mapInPandas(run, "id string, url string, text string")
            .select(F.col("id").cast(id_type).alias(id_col), F.col("url").alias(url_col), "text",
                    F.length("text").cast("bigint").alias("n_chars")))
