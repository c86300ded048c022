"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of block elements from the root
down to it; inline markup stays inside its block. For each path the letters, the punctuation,
the nodes and the letters inside links are summed. The ratios (letters a node,
punctuation a node) are smoothed along the path, with those of all that lies under each of
its ancestors; the fused score is the root of both, less the share
of links, times a weight for what the elements say of themselves (an article, or outside of the page's article).
Paths from a share of the page's best score on are content, and their nodes, block by block, the text.

Elements that never hold main text (scripts, styles, menus, footers, sidebars, and what is
classed as an advert, a notice, a comment and the like) take no part, nor does what belongs to the frame of a page
(headers, forms, classes of layout), but for an article inside. An element of these that is never
closed ends where an article begins, and a comment that is never closed at its first >. If this leaves no text, classes are not heeded.

Null and empty pages, and pages without text, give an empty text; long pages are read whole; paths with
equal scores are treated alike; rows that repeat are read each; null ids and urls are kept; no pages give no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from verdance.llm.common import arrow_rows, map_arrow, small_batches, texts

# Names of elements in HTML, by what they are.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NEVER = frozenset("script style noscript template textarea title xmp iframe noembed noframes head nav aside footer button select option svg canvas object audio video map menu dialog fieldset".split())
CONTENT = frozenset(("article", "main"))
#: Opening one of these closes the open ones of its set, up to the nearest of the elements that hold them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
HOLDS = frozenset("ul ol dl table menu select article main section div body".split())

#: Words of class, id and role that mark what is not main text: of the frame of a page, which may be around its article, and of things beside it, which may not.
FRAME = frozenset("nav navbar navigation menu menubar header masthead topbar banner footer bottombar sidebar sidebars breadcrumb breadcrumbs pagination pager toolbar contentinfo toc skip".split())
BESIDE = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login signin paywall comment comments commentlist commentary discussion disqus respond reply replies feedback share sharing social related recommended recommendations recirculation teaser teasers trending popular widget widgets complementary search searchbox copyright tags tagcloud outbrain taboola disclaimer hidden".split())
TITLED = frozenset("article post entry story".split())
MAIN = frozenset("article articlebody content main post entry story body text maincontent".split())

#: Weight of a path inside the article, and of one outside where the page has an article; what a share of the best score is content.
INSIDE, OUTSIDE, SHARE = 4.0, 0.25, 0.4
#: Weight of a path's own ratios; what is left goes to its ancestors in the same proportion.
OWN = 0.5

PIECE = re.compile(r"<!--|<!|<\?|<(/?)([A-Za-z][^\s/>]*)")
REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
MARKS = re.compile("[.,;:!?…、。，！？；¡¿]")


class Node(NamedTuple):
    """A run of text: its path, the block it lies in, the text, and whether it is inside a link."""

    path: int
    block: int
    text: str
    link: bool


class Element(NamedTuple):
    name: str
    path: int
    beside: bool  # never main text
    frame: bool  # not main text, but an article inside is
    article: bool
    link: bool


def words_of(value: str) -> set[str]:
    """Words of class names; names that say what an element has or lacks are left out."""
    names = [n for n in value.split() if not re.match("(?:has|no|with|without|is)[-_]", n)]
    return {w.lower() for n in names for w in WORD.findall(n)} | {n.lower() for n in names}


def judged(name: str, attributes: str, above: Element, heed: bool) -> tuple[bool, bool, bool]:
    """(beside, frame, article) of an element, as its name and, if they are heeded, its attributes have it."""
    beside, frame, article = above.beside, above.frame, above.article
    if not attributes or not heed:
        named, class_names, said = {}, "", set()
    else:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attributes)}
        class_names = " ".join(named.get(k, "") for k in ("class", "id", "role"))
        said = words_of(class_names) if class_names.strip() else set()
    hides = bool(named) and ("hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", ""), re.I))
    if name in CONTENT:
        # A comment or a teaser may be an article of its own; only a name in full counts here.
        if hides or (name == "article" and BESIDE & set(class_names.lower().split())):
            return True, frame, article
        return beside, False, True
    if name in ("html", "body"):
        return beside, frame, article
    if name in NEVER or hides or said & BESIDE:
        return True, frame, article
    titled = article or bool(said & TITLED)
    framed = name in ("header", "form") or bool(said & FRAME)
    if titled and (name == "header" or not (said & FRAME) - {"header"}) and name != "form":
        framed = False
    return beside or (framed and article), frame or framed, article


class Page:
    """Text nodes of one page, and its paths as a tree: the parent of each."""

    def __init__(self, source: str, heed: bool = True) -> None:
        self.source, self.heed = source, heed
        self.parents, self.labels = [-1], [""]
        self.children: dict[tuple[int, str], int] = {}
        self.nodes: list[Node] = []
        self.articles, self.mains = {0: False}, {0: False}
        self.open = [Element("", 0, False, False, False, False)]
        self.block = 0
        self.read()

    def step(self, path: int, label: str, article: bool, main: bool) -> int:
        to = self.children.setdefault((path, label), len(self.parents))
        if to == len(self.parents):
            self.parents.append(path)
            self.labels.append(label)
            self.articles[to], self.mains[to] = article, main
        return to

    def text(self, raw: str) -> None:
        top = self.open[-1]
        if not (top.beside or top.frame) and raw:
            self.nodes.append(Node(top.path, self.block, raw, top.link))

    def close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        if any(e.name not in INLINE for e in self.open[depth:]):
            self.block += 1
        del self.open[depth:]

    def implied(self, name: str) -> None:
        """End tags that opening ``name``, which is no inline element, implies."""
        for d in range(len(self.open) - 1, 0, -1):
            own = self.open[d].name
            if own in CLOSES.get(name, ()) or own == "p":
                self.close(d)
                return self.implied(name) if name in CLOSES else None
            if own in HOLDS:
                return None
        return None

    def opened(self, name: str, attributes: str, at: int) -> None:
        if name in ("br", "hr", "wbr") or name in VOID:
            if name == "hr":
                self.block += 1
            elif name == "br":
                self.text(" ")
            return
        if name not in INLINE:
            self.implied(name)
        if name in CONTENT:
            # What never holds main text and is never closed ends here.
            for d in range(1, len(self.open)):
                e = self.open[d].name
                if (self.open[d].beside or self.open[d].frame) and e not in ("html", "body") and not re.compile(rf"</{re.escape(e)}[\s>]", re.I).search(self.source, at):
                    self.close(d)
                    break
        above = self.open[-1]
        beside, frame, article = judged(name, attributes, above, self.heed)
        path = above.path
        if name not in INLINE:
            self.block += 1
            if not beside:
                m = re.search(r"\bclass\s*=\s*[\"']?([^\"'>]*)", attributes, re.I)
                label = f"{name}.{m[1].strip()}" if m else name
                main = bool(m and words_of(m[1]) & MAIN)
                path = self.step(path, label, article, main or self.mains[path])
        if attributes.endswith("/") and name not in RAW:
            return
        self.open.append(Element(name, path, beside, frame, article, above.link or name == "a"))

    def closed(self, name: str) -> None:
        for d in range(len(self.open) - 1, 0, -1):
            if self.open[d].name == name:
                self.close(d)
                return

    def read(self) -> None:
        s, at, strict = self.source, 0, True
        while at < len(s):
            m = PIECE.search(s, at)
            if not m:
                self.text(s[at:])
                return
            self.text(s[at : m.start()])
            if m[2] is None:  # a comment, or a declaration
                end = s.find("-->" if m[0] == "<!--" else ">", m.end())
                end = end if end >= 0 or m[0] != "<!--" else s.find(">", m.end())
                if end < 0:
                    return
                at = end + (3 if s.startswith("-->", end) else 1)
                continue
            rest = REST.match(s, m.end()) if strict else None
            if rest:
                attributes, at = rest[1], rest.end()
            else:  # a quote that is never closed
                strict, end = False, s.find(">", m.end())
                if end < 0:
                    return
                attributes, at = s[m.end() : end], end + 1
            name = m[2].lower()
            if m[1]:
                self.closed(name)
                continue
            self.opened(name, attributes, at)
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
                at = end.start() if end else len(s)


def scores(page: Page) -> dict[int, float]:
    """Fused score of each path that has text."""
    n = len(page.parents)
    own = [[0.0] * n for _ in range(4)]  # letters, punctuation, blocks, letters in links
    seen: set[tuple[int, int]] = set()
    for path, block, text, link in page.nodes:
        size = sum(map(len, text.split()))
        if not size:
            continue
        own[0][path] += size
        own[1][path] += len(MARKS.findall(text))
        own[2][path] += (path, block) not in seen
        own[3][path] += size if link else 0
        seen.add((path, block))
    under = [list(x) for x in own[:3]]
    for p in range(n - 1, 0, -1):  # children come after their parents
        for x in under:
            x[page.parents[p]] += x[p]
    ratio = lambda x, m, p: x[p] / m[p] if m[p] else 0.0
    # Of each path, the ratios of all under it and under its ancestors, the nearer the more.
    around = [[0.0] * n for _ in range(2)]
    for p in range(n):
        for k in range(2):
            here, up = ratio(under[k], under[2], p), page.parents[p]
            around[k][p] = here if up < 0 else OWN * here + (1 - OWN) * around[k][up]
    some_article = any(page.articles[p] and own[0][p] for p in range(n))
    out = {}
    for p in range(n):
        if own[0][p]:
            up = page.parents[p]
            size, marks = (OWN * ratio(own[k], own[2], p) + (1 - OWN) * (around[k][up] if up >= 0 else ratio(own[k], own[2], p)) for k in range(2))
            heading = page.labels[p][:2] in ("h1", "h2", "h3")
            links = 0.0 if heading else own[3][p] / own[0][p]
            weight = INSIDE if page.articles[p] or (page.mains[p] and not some_article) else OUTSIDE if some_article else 1.0
            out[p] = (size * (1 + marks)) ** 0.5 * (1 - links) * weight
    return out


def extracted(source: str | None) -> str:
    """The main text of a page."""
    page = Page(source or "")
    found = scores(page)
    if not found:  # all of it is classed as something else
        page = Page(source or "", heed=False)
        found = scores(page)
    if not found:
        return ""
    best = max(found.values())
    # Weights compare with the best path of the page as it would be without them.
    plain = max(s / (INSIDE if page.articles[p] or page.mains[p] else 1.0) for p, s in found.items())
    kept = {p for p, s in found.items() if s > 0 and s >= SHARE * min(plain, best)} or {p for p, s in found.items() if s == best}
    blocks: dict[int, list[str]] = {}
    for path, block, text, _ in page.nodes:
        if path in kept:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    small_batches(pages.sparkSession)
    own = pages.select("page_id", "url", "html")
    kind = own.schema["page_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [extracted(h) for h in texts(batch, "html")]
        schema = pa.schema([batch.schema.field("page_id"), batch.schema.field("url"), ("text", pa.string()), ("n_chars", pa.int64())])
        return arrow_rows(schema, {"page_id": batch.column("page_id").to_pylist(), "url": batch.column("url").to_pylist(), "text": text, "n_chars": [len(t) for t in text]})

    return map_arrow(own, make, f"page_id {kind}, url string, text string, n_chars bigint")
