"""The main text of HTML pages by a minimum cut between content and boilerplate.

A page becomes blocks of text. A classifier over tags, names of classes, links and prose gives each block two costs: that
of calling it boilerplate and that of calling it content. They are the capacities of its edges to the two terminals;
neighbours in the page, and blocks under one parent, share edges that are the stronger the nearer they lie in the DOM.
A maximum flow finds the cheapest cut, and the content's side is the article. The classifier's costs are fixed values:
pages carry no labels to learn from.

Work on a page grows with its length; pages are rows, so nothing is shuffled.

Cases: a null or empty html, or one of nothing but markup, has no blocks and an empty text; unclosed tags close where
HTML says so, and what stands in a tag that never ends is dropped; a page without marked article is judged by prose and
links alone; very long pages pass whole; repeated rows are pages of their own; an empty table gives no rows; other
columns pass through except those that the result names itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamella.llm.common import unused

#: How elements behave, after the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes an open element of these, up to the nearest of the second.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    **dict.fromkeys(("dd", "dt"), (frozenset(["dd", "dt"]), frozenset(["dl"]))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset("tr table".split()))),
    "tr": (frozenset("td th tr".split()), frozenset("table tbody thead tfoot".split())),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"]))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(["option"]), frozenset(["select"]))),
}
#: What marks boilerplate, reader comments and the article.
AWAY_TAGS = frozenset("nav footer aside header form menu dialog noscript template svg object canvas audio video select button fieldset label legend datalist output".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
AWAY_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended footer masthead toolbar copyright disclaimer search form skip".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
ARTICLE_WORDS = frozenset("article content main post entry story".split())
#: Fixed values of the classifier: costs in units of a smoothness edge.
COSTS = {"away": 40, "named": 28, "article": 12, "outside": 24, "plain": 5, "heading": 4, "sentence": 4, "few words": 2, "links": 16, "links in article": 6, "header in article": 34, "rights": 12}
#: Prose counts a unit for so many words, up to so many units.
WORDS_A_UNIT, MOST_UNITS = 2, 16
#: Edges between neighbours by their distance in the DOM (1 beyond, and between zones), and between blocks under one parent.
NEAR, SIBLING = ((2, 4), (4, 3), (6, 2)), 2

NEUTRAL, ARTICLE, AWAY, NAMED, COMMENTS = range(5)
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_TELLING = AWAY_TAGS | {"article", "main"}
_TOLD = ("class", "id", "role", "hidden", "style")
_RIGHTS = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|copyright", re.I)


class Element(NamedTuple):
    tag: str
    number: int
    zone: int
    by: str
    link: bool
    heading: bool
    header: bool


class Block(NamedTuple):
    text: str
    tag: str
    zone: int
    heading: bool
    header: bool
    links: float
    parent: int
    near: int


def attributes(said: str) -> dict[str, str]:
    """The attributes that tell something; the first of a name counts."""
    low = said.lower()
    if not any(x in low for x in _TOLD):
        return {}
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(said):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def named_zone(found: dict[str, str]) -> int:
    """What the names of an element's classes and its id say of it."""
    words = {w.lower() for c in ("class", "id") for w in _WORD.findall(found.get(c, ""))}
    if words & COMMENT_WORDS:
        return COMMENTS
    ours = words & ARTICLE_WORDS
    if words & AWAY_WORDS or ("header" in words and not ours):
        return NAMED
    return ARTICLE if ours else NEUTRAL


def zone_of(tag: str, said: str, up: Element) -> tuple[int, str]:
    """The zone of an element and the tag or the name that made it so.

    Comments hold whatever lies in them. An article ends what a menu, a header or a form left open; main ends all.
    """
    if not said and tag not in _TELLING:
        return up.zone, up.by
    found = attributes(said) if said and tag not in ("html", "body") else {}
    role, own = found.get("role", "").strip().lower(), named_zone(found) if found else NEUTRAL
    if up.zone == COMMENTS or own == COMMENTS:
        return COMMENTS, tag
    if tag == "main" or role == "main":
        return ARTICLE, tag
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if hidden or role in AWAY_ROLES or (tag in AWAY_TAGS and not (tag == "header" and up.zone == ARTICLE)):
        return AWAY, tag
    if own == NAMED:
        return NAMED, "name"
    if tag == "article" or role == "article":
        return (ARTICLE, tag) if up.zone not in (AWAY, NAMED) or up.by in ("nav", "header", "form") else (up.zone, up.by)
    return (ARTICLE, "name") if own == ARTICLE and up.zone == NEUTRAL else (up.zone, up.by)


class _Page:
    """The open elements and the blocks so far."""

    def __init__(self) -> None:
        self.stack = [Element("", 0, NEUTRAL, "", False, False, False)]
        self.blocks: list[Block] = []
        self.said: list[str] = []
        self.inside: list[Element] = []
        self.linked = 0
        self.low = 1
        self.count = 0
        self.last = (0, 1)
        self.open: dict[str, int] = {}

    def flush(self) -> None:
        text = " ".join("".join(self.said).split())
        if text:
            path = self.inside
            block = max((i for i, e in enumerate(path) if e.tag in BLOCKS), default=0)
            top = path[-1]
            low = min(self.low, block + 1)
            near = (self.last[1] - low) + (block + 1 - low)
            parent = path[block - 1].number if block else 0
            self.blocks.append(Block(text, path[block].tag, top.zone, any(e.heading for e in path[block:]), top.header, min(1.0, self.linked / len(text)), parent, near))
            self.last, self.low = (parent, block + 1), block + 1
        self.said, self.linked = [], 0

    def text(self, piece: str) -> None:
        if not piece:
            return
        top = self.stack[-1]
        if self.said and self.inside[-1].zone != top.zone:
            self.flush()
        if "&" in piece:
            piece = unescape(piece)
        if not self.said:
            if piece.isspace():
                return
            self.inside = self.stack[-12:] if len(self.stack) > 12 else self.stack[:]
        self.said.append(piece)
        if top.link:
            self.linked += len(piece)

    def pop_to(self, at: int) -> None:
        for e in self.stack[at:]:
            self.open[e.tag] -= 1
        del self.stack[at:]
        self.low = min(self.low, at)

    def start(self, tag: str, said: str) -> None:
        if tag in BLOCKS:
            self.flush()
            for i in range(len(self.stack) - 1, 0, -1):  # an open paragraph ends
                e = self.stack[i].tag
                if e == "p":
                    self.pop_to(i)
                if e in BLOCKS:
                    break
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                at = None
                for i in range(len(self.stack) - 1, 0, -1):
                    e = self.stack[i].tag
                    if e in stops:
                        break
                    at = i if e in ends else at
                if at is not None:
                    self.pop_to(at)
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        up = self.stack[-1]
        zone, by = zone_of(tag, said, up)
        self.count += 1
        in_header = zone == ARTICLE and (tag == "header" or (up.header and tag not in ("article", "main")))
        self.stack.append(Element(tag, self.count, zone, by, up.link or tag == "a", up.heading or tag in HEADINGS, in_header))
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            e = self.stack[i].tag
            if e == tag:
                self.pop_to(i)
                return
            if tag not in BLOCKS and e in BLOCKS:  # an inline end tag closes no block
                return


def blocks_of(html: str) -> list[Block]:
    page, at, n = _Page(), 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt == n - 1:
            page.text(html[at:n])
            break
        page.text(html[at:lt])
        c = html[lt + 1]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if c in "!?" or (c == "/" and not html[lt + 2 : lt + 3].isalpha()):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (c == "/" or (c.isascii() and c.isalpha())):
            page.text("<")
            at = lt + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            page.end(tag)
        elif tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = n if not end else end.end()
        else:
            page.start(tag, m[3])
    page.flush()
    return page.blocks


def costs(block: Block, marked: bool) -> tuple[int, int]:
    """The costs of calling a block boilerplate and of calling it content. marked: the page has an article with text."""
    words = len(block.text.split())
    prose = min(MOST_UNITS, words // WORDS_A_UNIT) + COSTS["sentence"] * (block.text[-1] in ".!?…:;\"”’»)")
    lose, keep = prose + COSTS["heading"] * block.heading, 0
    rights = bool(words < 40 and _RIGHTS.search(block.text))
    if block.zone in (AWAY, COMMENTS):
        keep += COSTS["away"]
    elif block.zone == NAMED:
        keep += COSTS["named"]
    elif block.zone == ARTICLE:
        lose += COSTS["article"]
        keep += round(COSTS["links in article"] * block.links) + COSTS["header in article"] * (block.header and not block.heading) + COSTS["rights"] // 2 * rights
    else:
        keep += COSTS["plain"] + COSTS["outside"] * marked + round(COSTS["links"] * block.links) + COSTS["few words"] * (words < 3) + COSTS["rights"] * rights
    return lose, keep


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours, and each block with the one before it under the same parent."""
    out, under = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, 1 if b.zone != blocks[i - 1].zone else next((w for most, w in NEAR if b.near <= most), 1)))
        if (j := under.get(b.parent)) is not None and j < i - 1:
            out.append((j, i, SIBLING))
        under[b.parent] = i
    return out


def min_cut(surplus: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; of equal cuts, the one with the most nodes there.

    surplus: a node's capacity from the source less that to the sink; links: (a, b, capacity both ways). Blocking flows
    on level graphs; a node's edges to the terminals are its surplus or shortage that is left.
    """
    n = len(surplus)
    left = list(surplus)
    if min(left, default=0) >= 0:
        return [True] * n
    out: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, w in links:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [w, w]
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if left[i] > 0]
        sources = list(queue)
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            for e in out[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    reached = reached or left[to[e]] < 0
                    queue.append(to[e])
        if not reached:
            return _unreached(left, out, to, cap)
        at = [0] * n
        for s in sources:
            path: list[int] = []
            i = s
            while left[s] > 0:
                if left[i] < 0:
                    sent = min(left[s], -left[i], *(cap[e] for e in path))
                    left[s] -= sent
                    left[i] += sent
                    for e in path:
                        cap[e] -= sent
                        cap[e ^ 1] += sent
                    path, i = [], s
                    continue
                while at[i] < len(out[i]):
                    e = out[i][at[i]]
                    if cap[e] and level[to[e]] == level[i] + 1:
                        break
                    at[i] += 1
                if at[i] < len(out[i]):
                    path.append(out[i][at[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    at[i] += 1
                else:
                    break


def _unreached(left: list[int], out: list[list[int]], to: list[int], cap: list[int]) -> list[bool]:
    """The nodes from which no residual path leads to a shortage."""
    kept = [x >= 0 for x in left]
    queue = [i for i, k in enumerate(kept) if not k]
    for i in queue:
        for e in out[i]:
            if cap[e ^ 1] and kept[to[e]]:
                kept[to[e]] = False
                queue.append(to[e])
    return kept


def labelled(html: str | None) -> list[tuple[str, str, int, int, bool]]:
    """(text, tag, cost as boilerplate, cost as content, kept) of every block of a page."""
    blocks = blocks_of(html or "")
    marked = any(b.zone == ARTICLE for b in blocks)
    found = [costs(b, marked) for b in blocks]
    kept = min_cut([lose - keep for lose, keep in found], edges(blocks))
    return [(b.text, b.tag, lose, keep, k) for b, (lose, keep), k in zip(blocks, found, kept, strict=True)]


_BLOCK = pa.struct([("text", pa.string()), ("tag", pa.string()), ("as_boilerplate", pa.int32()), ("as_content", pa.int32()), ("kept", pa.bool_())])


def _labelled(name: str) -> object:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, rest = batch[name], batch.drop_columns([name])
            for at in range(0, batch.num_rows, 64):
                blocks = [[dict(zip(_BLOCK.names, b, strict=True)) for b in labelled(pages[i].as_py())] for i in range(at, min(at + 64, batch.num_rows))]
                own = rest.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(blocks, pa.list_(_BLOCK))], names=[*own.schema.names, "blocks"])

    return made


def label_blocks(pages: DataFrame) -> DataFrame:
    """All columns of pages but html, and `blocks`: of each block text, tag, its two costs and whether it is kept."""
    d = pages.drop("blocks")
    name = unused(d, "__html")
    d = d.withColumn(name, F.col("html").cast("string")).drop("html")
    own = StructType.fromDDL("blocks array<struct<text: string, tag: string, as_boilerplate: int, as_content: int, kept: boolean>>")
    schema = StructType([*d.drop(name).schema.fields, *own.fields])
    return d.mapInArrow(_labelled(name), schema)


def main_text(blocks: Column) -> Column:
    """The kept blocks' texts in page order, with one space between them."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kept"]), lambda b: b["text"]), " ")
