"""Main text of web pages from the distribution of text over lines.

Markup is stripped to lines, one for each block of text.  A line weighs the
characters that are not link text (headings: all), so lists of links weigh
nothing.  Tags that structure the page leave blank lines: one for a plain
container, ``WINDOW`` at the edges of an article, a main part, a page header or
footer.  Weights are summed over sliding windows of ``WINDOW`` lines.  Text
surges where the sum leaves zero and dives where it is zero again; what lies
between is a stretch.  The heaviest stretch is the article, and any other whose
peak reaches both ``SURGE`` characters and a third of the heaviest's peak belongs to it.
A stretch that lies in one container but for a tenth is cut to that container and
the headings before it.  Inside an ``article`` or ``main`` element, where the page
has one, everything from the first surge to the last dive is kept.

Elements that hold no article by their meaning (scripts, forms, menus, page headers,
footers, asides) or by their class, id or role (adverts, notices, sidebars,
comments) are stripped with the markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3  # lines of a window
SURGE = 86  # characters in a window that make a second stretch worth keeping
BATCH = 64  # pages read into Python at a time

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))          # comment; an open one goes to the end
        |[!?][^>]*(?:>|\Z)                       # declaration
        |/[^a-zA-Z>][^>]*(?:>|\Z)|/>             # stray end
        |(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*"[^"]*"|\s*'[^']*')?+)*+)(?:>|\Z))""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I | re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMENTS_HEAD = re.compile(r"(\d+\s+)?((reader|user)s?\W*\s+)?(comments?|kommentare?|commentaires?|comentarios?|leave a (comment|reply))(\s*\W?\d+\W?)?\s*:?", re.I)

#: names of HTML elements (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("div section table td center body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WRAPPERS = frozenset("form div section body html table td header".split())
DROPPED = frozenset(
    "nav aside footer menu search dialog form button select datalist template noscript object applet svg canvas audio video map head".split()
)
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: an element that opens while one of these is open inside the same list or table ends it
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
#: words in class, id and role that tell what an element is for
HINTS = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion "
    "nav navbar navi navigation menu menubar breadcrumb breadcrumbs pagination pager toc toolbar skip side sidebar rail complementary widget widgets "
    "cookie cookies consent gdpr privacy notice notices alert alertdialog banner disclaimer popup modal overlay dialog paywall "
    "newsletter subscribe subscription signup login register form search footer contentinfo masthead topbar copyright legal "
    "share sharing social follow related recommended recommendations trending popular teaser teasers".split()
)
COMMENT_HINTS = frozenset("comment comments commentlist commentary commenter disqus respond replies reply".split())
NO_HINTS = frozenset("has with without no not".split())
OWN_HEADER = frozenset("article entry post story content section news item".split())


class Line(NamedTuple):
    text: str
    weight: int
    blanks: int  # blank lines before it
    zone: int  # article or main element, 0: neither
    kind: str  # "article", "main" or ""
    box: int  # innermost container, 0: none
    heading: bool


_HINTED: dict[str, str] = {}


def _judge(attributes: str) -> str:
    """What the attributes of a tag tell: "drop", "comment", "header" or nothing."""
    found = _HINTED.get(attributes)
    if found is None:
        if len(_HINTED) > 10_000:
            _HINTED.clear()
        found = _HINTED[attributes] = _judged(attributes)
    return found


def _judged(attributes: str) -> str:
    verdict = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "drop"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "drop"
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if NO_HINTS.intersection(parts):
                    continue
                if COMMENT_HINTS.intersection(parts):
                    return "comment"
                if HINTS.intersection(parts):
                    verdict = "drop"
                elif "header" in parts and not OWN_HEADER.intersection(parts) and not verdict:
                    verdict = "header"
    return verdict


class _Page:
    """Lines of one page, read tag by tag."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.stack: list[tuple[str, str]] = []  # name; why it is left out, or ""
        self.open: dict[str, int] = {}
        self.left_out = 0  # open elements that are left out
        self.wrappers = 0  # those among them that may turn out to wrap the article
        self.links = 0
        self.buffer: list[str] = []
        self.linked = 0
        self.blanks = 0
        self.heading = False
        self.zones: list[tuple[int, str]] = [(0, "")]
        self.n_zones = 0
        self.boxes = [0]  # open containers
        self.parents = [0]  # of each container, the one around it

    # -- text
    def text(self, run: str) -> None:
        if self.left_out:
            return
        if "&" in run:
            run = unescape(run)
        self.buffer.append(run)
        if self.links and not self.heading:
            self.linked += len("".join(run.split()))

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        if text:
            size = len(text.replace(" ", ""))
            weight = size - self.linked
            self.lines.append(Line(text, weight if 2 * weight > size or weight > 40 else 0, self.blanks, *self.zones[-1], self.boxes[-1], self.heading))
            self.blanks = 0
        self.buffer.clear()
        self.linked = 0

    # -- tags
    def push(self, name: str, why: str) -> None:
        self.stack.append((name, why))
        self.open[name] = self.open.get(name, 0) + 1
        self.left_out += why != ""
        self.wrappers += why in ("drop", "header") and name in WRAPPERS
        if name in CONTAINERS:
            self.parents.append(self.boxes[-1])
            self.boxes.append(len(self.parents) - 1)
        if name in ("article", "main") and not why:
            self.n_zones += 1
            inside = self.zones[-1][1] == "article"
            self.zones.append(self.zones[-1] if inside else (self.n_zones, name))

    def pop(self) -> None:
        name, why = self.stack.pop()
        self.open[name] -= 1
        self.left_out -= why != ""
        self.wrappers -= why in ("drop", "header") and name in WRAPPERS
        if name in CONTAINERS:
            self.boxes.pop()
        if name in ("article", "main") and not why:
            self.zones.pop()
        if name in HEADINGS:
            self.heading = False

    def gap(self, name: str) -> None:
        if self.left_out:
            return
        if name in ("article", "main", "nav", "header", "footer"):
            self.blanks += WINDOW
        elif name in CONTAINERS:
            self.blanks += 1

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in VOID and name != "hr":
            return
        if self.open.get("head") and name not in IN_HEAD and name not in ("html", "head"):
            self.end("head")
        if name in BLOCKS:
            self.flush()
            if self.stack and self.stack[-1][0] not in BLOCKS:  # an inline element that was left out ends with its block
                while self.stack and self.stack[-1][0] not in BLOCKS and self.stack[-1][0] not in DROPPED:
                    self.pop()
            if self.stack and self.stack[-1][0] == "p":
                self.pop()
            if name in ENDS:
                ended, bounds = ENDS[name]
                for at in range(len(self.stack) - 1, max(-1, len(self.stack) - 9), -1):
                    if self.stack[at][0] in bounds:
                        break
                    if self.stack[at][0] in ended:
                        while len(self.stack) > at:
                            self.pop()
                        break
            if name == "hr":
                return
        if name == "a" and not self.left_out:
            self.links += 1
        hint = _judge(attributes) if attributes else ""
        why = ""
        if name in ("article", "main"):
            if self.wrappers:  # a form or a hinted element around an article is a wrapper
                self.left_out -= self.wrappers
                self.wrappers = 0
                self.stack = [(other, "" if reason in ("drop", "header") and other in WRAPPERS else reason) for other, reason in self.stack]
            if hint == "comment" or (name == "article" and self.zones[-1][1] == "article"):
                why = "comment"
        elif name in ("html", "body"):
            pass
        elif name in DROPPED:
            why = "drop"
        elif name == "header":
            why = "header" if self.zones[-1][0] == 0 else (hint if hint in ("drop", "comment") else "")
        elif hint == "header":
            why = "header" if self.zones[-1][0] == 0 and name not in HEADINGS else ""
        else:
            why = hint
        if name in BLOCKS or why:
            self.push(name, why)
            if not why:
                self.gap(name)
            elif name in ("nav", "header", "footer") and self.left_out == 1 and self.zones[-1][0] == 0:
                self.blanks += WINDOW
            if name in HEADINGS and not why:
                self.heading = True

    def end(self, name: str) -> None:
        if name in BLOCKS or name == "p":
            at = len(self.lines)
            was_heading = self.heading and name in HEADINGS
            self.flush()
            if was_heading and len(self.lines) > at and _COMMENTS_HEAD.fullmatch(self.lines[-1].text):
                self.lines.pop()
                self.comments_follow()
        if name == "a":
            self.links = max(0, self.links - 1)
        if not self.open.get(name):
            return
        inline = name not in BLOCKS and name not in DROPPED
        if name in ("p", "li", "dt", "dd") or inline:  # these do not end what is around them
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == name:
                    break
                if self.stack[at][0] in CONTAINERS or self.stack[at][0] in DROPPED or self.stack[at][0] in ("article", "main", "ul", "ol", "dl"):
                    return
        while self.stack:
            top, why = self.stack[-1]
            self.pop()
            if not why:
                self.gap(top)
            if top == name:
                return

    def comments_follow(self) -> None:
        """Leave out the rest of the container whose heading announces reader comments."""
        for at in range(len(self.stack) - 1, -1, -1):
            name, why = self.stack[at]
            if name in CONTAINERS or name in ("article", "main", "html") or at == 0:
                if name in ("article", "main"):
                    self.push("div", "comment")
                elif not why:
                    self.stack[at] = (name, "comment")
                    self.left_out += 1
                return


def page_lines(html: str) -> tuple[list[Line], list[int]]:
    """Lines of text of a page in page order, without what never is article; the container around each container."""
    page, at, size = _Page(), 0, len(html)
    last = html.rfind("<") + 1
    while at < last:
        found = _TAG.search(html, at)
        if found is None:
            break
        if found.start() > at:
            page.text(html[at : found.start()])
        at = found.end()
        slash, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            page.end(name)
        elif name in RAW:
            ending = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            if ending is None:
                at = size
                break
            closing = html.find(">", ending.end())
            at = size if closing < 0 else closing + 1
        else:
            page.start(name, attributes.strip())
    if at < size:
        page.text(html[at:])
    page.flush()
    return page.lines, page.parents


def stretches(lines: list[Line]) -> list[tuple[int, int, int, int]]:
    """First line, line after the last, sum and highest window of each stretch between a surge and a dive."""
    found, first, last, total, near, peak, blanks = [], -1, -1, 0, [], 0, 0
    for i, line in enumerate(lines):
        blanks += line.blanks
        if not line.weight:
            blanks += 1
            continue
        if first >= 0 and blanks >= WINDOW:
            found.append((first, last + 1, total, peak))
            first = -1
        if first < 0:
            first, total, peak, near = i, 0, 0, []
        near = (near + [0] * blanks + [line.weight])[-WINDOW:] if near else [line.weight]
        total, peak, last, blanks = total + line.weight, max(peak, sum(near)), i, 0
    if first >= 0:
        found.append((first, last + 1, total, peak))
    return found


def main_text(html: str | None) -> str:
    """The article of a page, blocks parted by an empty line."""
    lines, parents = page_lines(html) if html else ([], [0])
    for kind in ("article", "main"):
        inside = [line for line in lines if line.kind == kind]
        if inside:
            break
    else:
        inside = []
    if inside:
        parts = _by_zone(inside)
        if not any(total for _, total, _ in parts):  # nothing but links
            return "\n\n".join(line.text for line in inside)
    else:
        parts = [(_in_its_box(lines[a:b], total, parents), total, peak) for a, b, total, peak in stretches(lines)]
    if not parts:
        return ""
    highest = max(parts, key=lambda p: p[1])
    kept = [part for part, total, peak in parts if part is highest[0] or (peak >= SURGE and 3 * peak >= highest[2])]
    return "\n\n".join(line.text for part in kept for line in part)


def _in_its_box(lines: list[Line], total: int, parents: list[int]) -> list[Line]:
    """Lines of a stretch inside the smallest container that holds two of them and nine tenths of its weight, and headings right before."""
    weight, count = [0] * len(parents), [0] * len(parents)
    for line in lines:
        weight[line.box] += line.weight
        count[line.box] += 1
    for box in range(len(parents) - 1, 0, -1):  # a container is opened after the one around it
        weight[parents[box]] += weight[box]
        count[parents[box]] += count[box]
    best = max((b for b in range(len(parents)) if count[b] > 1 and 10 * weight[b] >= 9 * total), default=0)
    inside = [best == 0] * len(parents)
    inside[best] = True
    for box in range(best + 1, len(parents)):
        inside[box] = inside[box] or inside[parents[box]]
    kept = [i for i, line in enumerate(lines) if inside[line.box]]
    if not kept:
        return lines
    first = kept[0]
    while first > 0 and lines[first - 1].heading:
        first -= 1
    return lines[first : kept[0]] + [lines[i] for i in kept]


def _by_zone(lines: list[Line]) -> list[tuple[list[Line], int, int]]:
    """For each article: the lines from its first surge to its last dive, their sum and highest window."""
    zones: dict[int, list[Line]] = {}
    for line in lines:
        zones.setdefault(line.zone, []).append(line)
    out = []
    for part in zones.values():
        found = stretches(part)
        if found:
            out.append((part[found[0][0] : found[-1][1]], sum(f[2] for f in found), max(f[3] for f in found)))
    return out


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Columns of ``pages`` without ``html``, and ``text, n_chars``: the main text and its code points.

    Null and empty pages have an empty text, as have pages of links only without
    an article.  Every row is a page of its own, so repeated rows repeat.  A page
    of any size is read whole, in time and memory in proportion to it.  Character
    references are decoded; white space inside a block is one space.  Columns
    named like the results are replaced.  No rows: no rows.
    """
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*others, html)
    at = len(others)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, BATCH):
                part = batch.slice(row, BATCH)
                texts = [main_text(page) for page in part.column(at).to_pylist()]
                columns = [*part.columns[:at], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:at], "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema[:at])
    return source.mapInArrow(extract, fields + "text string, n_chars bigint")
