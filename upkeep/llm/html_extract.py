"""Main-text extraction from raw HTML by tree scoring.

A page is read into a light tree (optional end tags, misnested inline tags, raw
text elements, cut-off markup, quotes that are never closed). Text between block
tags is a paragraph; it has points for itself, its length and its commas, less the
share of it that is links, and passes them to its ancestors: in full to the
parent, half to the grandparent, a share of 1 / (2 * distance) to the next three.
A container's points are discounted by its link density. Words of a class or id
that name furniture (menus, sidebars, notices, adverts, forms, comments) are a
factor on the points of all that stands below, unless that holds most of the
page's paragraph points or the page's article: then it is a wrapper.

The container with the most points is the best one. An ``article`` (else
``main``) around it bounds the text: it is kept, with siblings that have a fifth
of its points or are plain paragraphs or titles. On a page that marks none, the
siblings of the best container and of its ancestors are kept if their points,
less their link density, pass a bar, which is higher for named furniture; there
a heading goes with what it stands over.

Inside what is kept, an element goes if it is furniture by tag or role, or by its
words: those of adverts, sidebars, cookie notices and reader comments always,
other
plain ones where it holds less than half of the points, and ambiguous
ones (discussion, side, search) only where links, form fields, a list of comments
or the lack of any paragraph speak for it too; never what the best container
stands in. A list of three or more short links goes where no article marks the
text. Everything else stays.

Reading, sums and choice take time linear in the page: open elements are looked
up by name, points go up at most five levels, sums are made once from the bottom.

Cases: null or empty html gives an empty text; a page without any paragraph
points falls back to its body; an end of input inside a tag, comment or script
ends the page there; a quote that is not closed before the next attribute ends
with its tag; rows are handled one by one, so ids may be null or repeated; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds and furniture words: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q ruby rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: Parts of a formula: inline, so that it stays one piece of its sentence.
FORMULA = frozenset("mi mn mo ms mrow msup msub msubsup mfrac msqrt mroot mtext mover munder munderover mfenced mspace mstyle semantics".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote body center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: Start tags that end an open element of these kinds, up to one of the last.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "option": (("option",), ("select",))}
FURNITURE_TAGS = frozenset("nav footer aside button select datalist dialog menu object svg canvas audio video map head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
KEEPERS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of adverts, sidebars, cookie notices and comments; then other plain ones; then ambiguous ones.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit sponsor sponsored "
                    "sponsors skyscraper outbrain taboola".split())
COMMENTS = frozenset("comment comments commentlist commentform commentarea commentsection disqus".split())
DEFINITE = ADVERTS | COMMENTS | frozenset("sidebar sidebars cookie cookies gdpr consent newsletter breadcrumb breadcrumbs popup modal paywall "
                                          "pagination pager".split())
PLAIN = frozenset("nav navi navbar navigation menu menus topbar masthead banner banners notice notices alert promo promos share sharing social "
                  "related recommended widget widgets overlay login signin signup subscribe subscription toolbar footer teaser siteheader pageheader".split())
AMBIGUOUS = frozenset("head header side rail search skip tags foot reply replies respond responses feedback discussion register top".split())
GOOD = frozenset("article content main post entry story text body".split())
STATES = frozenset("no has with without hide show is".split())           # first words, and last ones,
STATE_ENDS = frozenset("open closed on off enabled disabled".split())     # of names that tell a state
# ---

ADVERT, NONE, UNSURE, FAIRLY, SURE = 4, 0, 1, 2, 3
FACTOR = {NONE: 1.0, UNSURE: 0.4, FAIRLY: 0.15, SURE: 0.05}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|(?![\"'])))*+)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>=]")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?(?=[\s/>\"']|\Z)", re.I)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*+(?:>|\\Z)|</{tag}\\Z", re.I) for tag in RAW}
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=4096)
def _named(attrs: str) -> tuple[bool, str, int, bool, bool]:
    """What an element's attributes say: hidden, role, furniture (NONE to SURE), words
    of comments, words of content."""
    hidden, role, words = False, "", []
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            for token in _HUMP.sub("-", unescape(value)).lower().split():
                found = _WORDS.findall(token)
                if found and found[0] not in STATES and found[-1] not in STATE_ENDS:  # "no-sidebar" tells what the page has, not what this is
                    words += found
    kinds = DEFINITE.intersection(words)
    level = SURE if kinds else FAIRLY if PLAIN.intersection(words) else UNSURE if AMBIGUOUS.intersection(words) else NONE
    return hidden, role, ADVERT if ADVERTS.intersection(words) else level, bool(COMMENTS.intersection(words)), bool(GOOD.intersection(words))


class Page:
    """Tree of one page: parallel lists per node; ``blocks`` in page order."""

    def __init__(self, html: str):
        self.tags, self.parents, self.skip = ["#root"], [-1], [False]
        self.named: list[int] = [NONE]       # furniture by words, or a form
        self.comment: list[int] = [0]        # words of comments; later their number below
        self.good: list[bool] = [False]
        self.fields: list[int] = [0]
        self.marks: list[int] = [0]          # article and main elements; later their number below
        self.blocks: list[tuple[int, str, int]] = []  # block element, text, characters inside links
        self._text: list[str] = []
        self._links = 0
        self._read(html)

    def _flush(self, at: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((at, text, min(self._links, len(text))))
            self._text, self._links = [], 0

    def _read(self, html: str) -> None:
        tags, skip = self.tags, self.skip
        stack = [0]                                 # open nodes
        places: dict[str, list[int]] = {}           # depths of the open elements of each tag
        outer = [0]                                 # depths of the open elements that are not inline
        headings, size, at = 0, len(html), 0

        def last(tag: str) -> int:
            found = places.get(tag)
            return found[-1] if found else 0

        def nearest(kinds) -> int:
            return max(map(last, kinds))

        def add(text: str) -> None:
            if not skip[stack[-1]] and (headings or not places.get("header")):
                self._text.append(unescape(text) if "&" in text else text)
                if places.get("a"):
                    self._links += len(text.strip())

        def close(depth: int) -> None:
            nonlocal headings
            if outer[-1] >= depth:
                self._flush(stack[outer[-1]])
            while len(stack) > depth:
                tag = tags[stack.pop()]
                places[tag].pop()
                headings -= tag in HEADINGS
                if outer[-1] == len(stack):
                    outer.pop()

        while at < size:
            start = html.find("<", at)
            if start < 0:
                add(html[at:])
                break
            m = _TAG.match(html, start)
            if start > at:
                add(html[at:start])
            if m:
                ends, tag, attrs, at = m[1], m[2].lower(), m[3], m.end()
            else:
                m = _OPEN.match(html, start)
                if m is None:
                    at = _other(html, start)
                    if at == start:
                        add("<")
                        at = start + 1
                    continue
                ends, tag, at = m[1], m[2].lower(), _tag_end(html, m.end())
                if at < 0:
                    break  # the input ends inside a tag
                attrs = html[m.end():at - 1]
            if ends:
                if tag == "br":
                    add(" ")
                    continue
                depth = last(tag)
                if depth == 0 or (tag in INLINE or tag in FORMULA) and depth < outer[-1]:
                    continue
                if tag in ("p", "li", "span") and depth < nearest(("td", "th", "article", "main")):
                    continue
                close(depth)
                continue
            if tag in RAW:
                self.fields[stack[-1]] += tag == "textarea"
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else size
                continue
            inline = tag in INLINE or tag in FORMULA
            if tag in VOID:
                if tag == "hr":
                    self._flush(stack[outer[-1]])
                self.fields[stack[-1]] += tag == "input"
                add(" ")
                continue
            if tag in ENDS_P and (depth := last("p")) and depth == outer[-1]:
                close(depth)
            if tag in ENDS:
                kinds, limit = ENDS[tag]
                bound = nearest(limit)
                if tag == "tr":  # the whole open row
                    firsts = [p[k] for kind in kinds if (p := places.get(kind)) and (k := bisect_right(p, bound)) < len(p)]
                    depth = min(firsts, default=0)
                else:
                    depth = nearest(kinds)
                if depth > bound:
                    close(depth)
            if tag == "a" and last("a") > outer[-1]:  # links don't nest
                close(last("a"))
            parent = stack[-1]
            if not inline:
                self._flush(stack[outer[-1]])
            hidden, role, level, comment, good = _named(attrs) if attrs else (False, "", NONE, False, False)
            if tag in KEEPERS or tag in HEADINGS and level < SURE:
                level, comment = NONE, False
            elif tag == "form" or role == "form":
                level = max(level, FAIRLY)
            gone = (tag in FURNITURE_TAGS or hidden and tag not in KEEPERS or role in FURNITURE_ROLES and tag not in KEEPERS
                    or tag == "header" and not places.get("article") and not places.get("main") or inline and level == ADVERT)
            tags.append(tag)
            self.parents.append(parent)
            skip.append(skip[parent] or gone)
            self.named.append(NONE if inline else min(level, SURE))
            self.comment.append(int(comment and not inline and not skip[-1]))
            self.good.append(good)
            self.fields.append(int(tag in ("select", "button")))
            self.marks.append(int(tag in ("article", "main") and not skip[-1]))
            if attrs.endswith("/") and tag in ("svg", "path"):
                continue
            places.setdefault(tag, []).append(len(stack))
            if not inline:
                outer.append(len(stack))
            stack.append(len(tags) - 1)
            headings += tag in HEADINGS
        self._flush(stack[outer[-1]])

    def text(self) -> str:
        if not self.blocks:
            return ""
        tags, parents, count = self.tags, self.parents, len(self.tags)
        size, linked, links, prose = [0] * count, [0] * count, [0] * count, [0] * count
        raw, own, said = [0.0] * count, [], [c > 0 for c in self.comment]
        for node, text, inside in self.blocks:
            points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - inside / len(text))
            own.append(points)
            size[node] += len(text)
            linked[node] += inside
            links[node] += inside > 0
            raw[node] += points
            prose[node] += tags[node] not in HEADINGS and len(text) >= 25 and 2 * inside < len(text) and (tags[node] == "p" or any(c in text for c in ".,;:!?"))
        plain = list(raw)  # points outside of reader comments
        for n in range(count - 1, 0, -1):  # sums from the bottom, once
            p = parents[n]
            if not said[n]:
                plain[p] += plain[n]
                self.marks[p] += self.marks[n]
            size[p] += size[n]
            linked[p] += linked[n]
            links[p] += links[n]
            raw[p] += raw[n]
            prose[p] += prose[n]
            self.fields[p] += self.fields[n]
            self.comment[p] += self.comment[n]
        density = [b / a if a else 0.0 for a, b in zip(size, linked)]
        # furniture words: a factor on all points below, unless that is most of the page
        factor = [1.0] * count
        for n in range(1, count):
            wraps = prose[n] == prose[0] if said[n] else self.marks[n] > 0 or plain[n] >= 0.5 * plain[0]
            factor[n] = factor[parents[n]] * (1.0 if wraps else 0.01 if said[n] else FACTOR[self.named[n]])
        points = [0.0] * count
        for (node, _, _), value in zip(self.blocks, own):
            value *= factor[node]
            if tags[node] not in ("p", "li", "blockquote", "pre", "td", *HEADINGS):
                points[node] += value  # text that stands in a container itself
            n = parents[node]
            for distance in range(5):
                if n < 0:
                    break
                points[n] += value / max(1, 2 * distance)
                n = parents[n]
        final = [p * (1 - d) * (1.25 if g else 1) for p, d, g in zip(points, density, self.good)]
        best = max(range(count), key=final.__getitem__)
        while tags[best] in ("p", "li", "ul", "ol", "tr", "td", "tbody", "blockquote", *HEADINGS) and parents[best] > 0:
            best = parents[best]
        up = [best]
        while up[-1] > 0:
            up.append(parents[up[-1]])
        within = set(up)  # what the best container stands in
        marked = [n for kind in ("article", "main") for n in reversed(up) if tags[n] == kind]
        root = marked[0] if marked else best
        path = set(up[up.index(root) + 1:])
        beside = parents[root]

        def furniture(n: int) -> bool:
            level = self.named[n]
            if level == NONE or n in within:
                return False
            if level == SURE:
                return True
            if level == FAIRLY:
                return raw[n] < 0.5 * raw[root]
            return density[n] >= 0.3 or self.fields[n] > 0 or self.comment[n] > 1 or not prose[n]

        def sibling(n: int) -> bool:
            if density[n] >= 0.5 and size[n] or self.named[n] == SURE or self.named[n] == UNSURE and furniture(n):
                return False
            score = raw[n] * (1 - density[n]) * FACTOR[self.named[n]]
            if marked:
                return score >= max(4.0, 0.2 * final[root]) or tags[n] in ("p", "blockquote", "pre", "h1", "h2") and self.named[n] == NONE and density[n] < 0.25
            return score >= (0.5 if self.named[n] in (NONE, UNSURE) else max(0.5, 0.2 * raw[root]))

        gone, inside, aside, above = 0, 1, 2, 3
        status = [above] * count
        for n in range(count):
            p = parents[n]
            if n == root:
                status[n] = inside
            elif n in path:
                status[n] = above
            elif status[p] == above:
                status[n] = aside if (p == beside or not marked) and sibling(n) else gone
            else:
                status[n] = gone if status[p] and furniture(n) else status[p]
            if (status[n] in (inside, aside) and not marked and n != root and n not in within and links[n] >= 3 and density[n] > 0.8
                    and tags[n] in ("ul", "ol", "div", "table", "dl") and linked[n] < 30 * links[n]):
                status[n] = gone
        out, under = [], True  # under: the block that a heading stands over is kept
        for node, text, inside_links in reversed(self.blocks):
            state = status[node]
            keep = state == inside
            if state == aside or state == above and not marked:
                keep = marked or 2 * inside_links < len(text) and (under or tags[node] not in HEADINGS)
            if tags[node] not in HEADINGS:
                under = bool(keep)
            if keep:
                out.append(text)
        out.reverse()
        return "\n".join(out)


def _other(html: str, at: int) -> int:
    """End of a comment, doctype or processing instruction at ``at``; ``at`` if the
    sign stands for itself."""
    if html.startswith("<!--", at):
        if html.startswith((">", "->"), at + 4):
            return html.index(">", at + 4) + 1
        end = _COMMENT_END.search(html, at + 4)
        return end.end() if end else len(html)
    if html[at + 1:at + 2] in ("!", "?", "/") and len(html) > at + 1:
        end = html.find(">", at)
        return end + 1 if end >= 0 else len(html)
    return at


def _tag_end(html: str, at: int) -> int:
    """Place after the tag whose attributes start at ``at``, -1 if the input ends first.
    A quoted value may hold angle brackets; one that runs into the next attribute was
    never closed, and its tag ends at the next ``>``."""
    while True:
        m = _STOP.search(html, at)
        if m is None:
            return -1
        at = m.end()
        if m[0] == ">":
            return at
        while html[at:at + 1].isspace():
            at += 1
        quote = html[at:at + 1]
        if quote not in ("'", '"') or not quote:
            continue
        end = html.find(quote, at + 1)
        after = html[end + 1:end + 2]
        if end < 0 or html[end - 1] == "=" and end > at + 1 or after and not (after.isspace() or after in "/>"):
            end = html.find(">", at)
            return end + 1 if end >= 0 else -1
        at = end + 1


def extract(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
