"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page; each block of text becomes a line with its number of characters and
of tags and the open elements around it. The ratio of both is smoothed over the lines with a Gaussian kernel, and
two clusters of the ratios (split where their variance within is least) separate content from the rest. Content
lines vote with their characters for the element that holds them: the region is the deepest element that keeps
nearly all of the votes of its parent, with the headings and content blocks beside it, or an article element that does.
All lines of the region are returned, short ones too, but for those inside menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, which are known by element, role or class names. A class or id name
or a form does not hide an element around the article or with most of the votes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that never hold content.
SKIP = frozenset("script style noscript template nav footer aside form button select textarea iframe svg canvas object dialog menu head title math audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose end tag may be missing, with what ends them.
CLOSERS = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form alert".split())
#: Words of class and id names that mark other parts of a page, as plain values.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs toc footer foot header masthead topbar toolbar login signup signin register subscribe subscription newsletter search"
    " comment comments commentlist disqus respond reply replies discussion reader feedback form social share sharing related recommended recommendations widget pagination pager skip".split()
)
#: Marks of what readers wrote. Their number may exceed the article's, so votes don't speak for them.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion feedback".split())
#: Elements that hold content even inside a marked one.
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Why an element is left out: by a name, by a name of reader comments, in any case.
NAMED, COMMENT, NEVER = 1, 2, 3
SIGMA = 1.0
#: Part of its parent's votes that a deeper region must keep.
VOTES = 0.9
#: Part of all votes by which an article element shows the marked elements around it.
OWN = 0.2
_COMMENT_END = re.compile(r"--!?>|--\s*>")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@functools.lru_cache(4096)
def _marked(name: str) -> int:
    """What a class or id names: 0, or why its element is left out, as one of its words is a mark."""
    words = _NAME.findall(_CAMEL.sub(" ", name).lower())
    return 0 if MARKS.isdisjoint(words) else NAMED if COMMENTS.isdisjoint(words) else COMMENT


class Lines(HTMLParser):
    """Collects ``text, tags, element, hidden`` of each line of a page, and the tree of its elements.

    Elements are numbered from 1 in page order, so a parent has a lower number than its children; 0 stands above them all.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, number, whether its content is skipped in any case
        self.places: dict[str, list[int]] = {}  # places in ``open`` by element
        self.blocks: list[int] = []  # places in ``open`` of what is no inline element
        self.parent: list[int] = [0]
        self.kinds: list[str] = [""]
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0
        self.marks: dict[int, int] = {}  # elements that a name or form marks
        self.quoted: set[int] = set()  # article elements named as comments
        self.sections = True  # CDATA sections may still end

    def read(self, html: str) -> Lines:
        """Takes a whole page. Markup that never ends is no markup: an open comment loses its mark only, a last ``<`` is text."""
        if "<!--" in html:
            closed = max((m.start() for m in _COMMENT_END.finditer(html)), default=0)
            at = max(closed - 3, 0)  # no comment that starts from here on has an end
            html = html[:at] + html[at:].replace("<!--", " ")
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        self.handle_data(unescape(html[end:]))
        self.flush()
        return self

    def parse_html_declaration(self, i: int) -> int:
        """Comments; CDATA sections as far as they go; any other declaration up to its ``>``."""
        raw = self.rawdata
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        if self.sections and raw.startswith("<![CDATA[", i):
            end = raw.find("]]>", i)
            if end >= 0:
                return end + 3
            self.sections = False
        return raw.find(">", i) + 1 or -1

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else -1

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0, bool(self.open and self.open[-1][2])))
                self.tags = 0
            self.text = []

    def cut(self, size: int) -> None:
        """Closes all but the outer ``size`` elements."""
        while len(self.open) > size:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def inside(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ") if tag == "br" else self.flush()
            return
        if tag not in INLINE:
            self.flush()
            while self.open and tag in CLOSERS.get(self.open[-1][0], ()):
                self.cut(len(self.open) - 1)
            # inline elements left open inside a paragraph end with it
            if tag in CLOSERS["p"] and self.blocks and self.open[self.blocks[-1]][0] == "p":
                self.cut(self.blocks[-1])
        number = len(self.kinds)
        hidden = bool(self.open and self.open[-1][2])
        why = self.skips(tag, attrs, number)
        if why in (NAMED, COMMENT):
            self.marks[number] = why
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.kinds.append(tag)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, number, hidden or why == NEVER))

    def skips(self, tag: str, attrs, number: int) -> int:
        if tag in SKIP and tag != "form":
            return NEVER
        if tag in INLINE and not attrs:
            return 0
        if tag == "header" and not any(map(self.inside, CONTENT)):
            return NEVER
        why = NAMED if tag == "form" else 0
        for name, value in attrs:
            if name in ("class", "id") and value and tag not in ("html", "body"):
                mark = max(map(_marked, value.split()), default=0)
                if tag not in CONTENT:
                    why = max(why, mark)
                elif mark == COMMENT:
                    self.quoted.add(number)
            if name == "role" and value and value.lower() in ROLES:
                why = max(why, NAMED if value.lower() == "form" else NEVER)
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                return NEVER
        return why

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        if not self.inside(tag):
            return
        at = self.places[tag][-1]
        if tag not in INLINE or not self.blocks or self.blocks[-1] < at:  # a stray inline end tag closes no block
            self.cut(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def ratios(lines: list[tuple]) -> np.ndarray:
    """Smoothed characters per tag of each line."""
    raw = np.array([len(t) / max(tags, 1) for t, tags, _, _ in lines], float)
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(raw, reach)
    weight = np.convolve(np.pad(np.ones(len(raw)), reach), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def threshold(values: np.ndarray) -> float:
    """Cut between two clusters of values with the least variance within; everything passes if all are equal."""
    x = np.sort(values)
    n = np.arange(1, len(x))
    left, total = np.cumsum(x)[:-1], x.sum()
    between = (left / n - (total - left) / (len(x) - n)) ** 2 * n * (len(x) - n)
    if not len(between) or between.max() <= 0:
        return float(x[0])
    at = int(between.argmax())
    return float((x[at] + x[at + 1]) / 2)


def sums(page: Lines, weights: Iterable[tuple[int, int]]) -> list[int]:
    """Sum of the weights of lines by element, those inside its children too."""
    out = [0] * len(page.kinds)
    for n, weight in weights:
        out[n] += weight
    for n in range(len(out) - 1, 0, -1):
        out[page.parent[n]] += out[n]
    return out


def within(page: Lines, chosen: Callable[[int], bool]) -> list[bool]:
    """Whether an element, or one around it, is chosen."""
    out = [False] * len(page.kinds)
    for n in range(1, len(out)):
        out[n] = out[page.parent[n]] or chosen(n)
    return out


def enclosing(page: Lines, chosen: Iterable[int]) -> set[int]:
    """Elements around the chosen ones, these left out."""
    out: set[int] = set()
    for n in chosen:
        while (n := page.parent[n]) and n not in out:
            out.add(n)
    return out


def sifted(page: Lines) -> list[tuple]:
    """Lines of a page, hidden also inside marked elements, but for those around the content.

    A mark does not count on an element around a main element, around an article element with votes, or with most of the
    votes (of the article around it, else of a page without article in sight). Comments are judged by votes only if they hold a main
    heading, a main element or the first article. If all lines were hidden, no mark counts.
    """
    lines, kinds, marks = page.lines, page.kinds, page.marks
    marked = within(page, marks.__contains__)
    seen = [i for i, line in enumerate(lines) if not line[3]]
    if not any(marked[lines[i][2]] for i in seen):
        return lines
    smooth = ratios(lines)
    cut = threshold(smooth[seen])
    main, article, heading = (within(page, lambda n, t=t: kinds[n] == t) for t in ("main", "article", "h1"))
    plain = any(not marked[n] and (main[n] or article[n] and heading[n]) for n in (lines[i][2] for i in seen))
    held_lines = sums(page, ((lines[i][2], 1) for i in seen))
    live = [n for n in range(1, len(kinds)) if held_lines[n]]
    first = next((n for n in live if kinds[n] == "article" and n not in page.quoted), None)
    around = enclosing(page, (n for n in live if kinds[n] in ("h1", "main") or n == first))  # what comments don't hold
    comments = {n for n, why in marks.items() if why == COMMENT and n not in around}
    quoted = within(page, comments.__contains__)
    voting = [i for i in seen if smooth[i] >= cut and not quoted[lines[i][2]]]
    votes = sums(page, ((lines[i][2], len(lines[i][0])) for i in voting))
    total = votes[0]
    strong = {n for n in live if votes[n] and kinds[n] in CONTENT and n not in page.quoted and votes[n] >= OWN * total}
    anchors = strong | {n for n in live if votes[n] and kinds[n] == "main"}
    shielded = enclosing(page, anchors)
    inner = [0] * len(kinds)  # the nearest anchor, the element itself included
    for n in range(1, len(kinds)):
        inner[n] = n if n in anchors else inner[page.parent[n]]
    shown: set[int] = set()
    for n in live:
        if n in marks and n not in comments and n not in anchors:
            held = votes[inner[n]] if inner[n] else 0 if strong or plain else total
            if n in shielded or 2 * votes[n] > held > 0:
                shown.add(n)
    left = within(page, (marks.keys() - shown).__contains__)
    out = [(text, tags, n, never or left[n]) for text, tags, n, never in lines]
    return lines if all(line[3] for line in out) else out


def region(lines: list[tuple], page: Lines) -> list[int]:
    """Numbers of the lines that hold the content, in order."""
    kinds, parent = page.kinds, page.parent
    seen = [i for i, line in enumerate(lines) if not line[3]]
    smooth = ratios(lines)
    cut = threshold(smooth[seen])
    held_lines = sums(page, ((lines[i][2], 1) for i in seen))
    votes = sums(page, ((lines[i][2], len(lines[i][0]) if smooth[i] >= cut else 0) for i in seen))
    live = [n for n in range(1, len(kinds)) if held_lines[n]]
    articles = [n for n in live if kinds[n] in CONTENT]
    if articles and (best := max(articles, key=lambda n: (votes[n], -n))) and 2 * votes[best] >= votes[0]:
        inside = within(page, lambda n: n == best)
        return [i for i in seen if inside[lines[i][2]]]
    top = [0] * len(kinds)  # the child with most votes
    for n in live:
        if not top[parent[n]] or votes[n] > votes[top[parent[n]]]:
            top[parent[n]] = n
    chosen, at = [], 0
    while (best := top[at]) and votes[best] >= VOTES * votes[at] and kinds[best] not in ("p", *INLINE):
        chosen.append(best)
        at = best
    return beside(lines, page, seen, chosen, smooth >= cut)


def beside(lines: list[tuple], page: Lines, seen: list[int], chosen: list[int], content: np.ndarray) -> list[int]:
    """Lines of the last of the nested elements ``chosen``, and of what stands beside one of them: blocks with most characters in content lines, and headings before a kept block."""
    kinds, parent = page.kinds, page.parent
    level = [0] * len(kinds)  # number of chosen elements around an element, itself included
    branch = [0] * len(kinds)  # the element, or that around it, beside a chosen one
    depth = {n: k + 1 for k, n in enumerate(chosen)}
    for n in range(1, len(kinds)):
        up = parent[n]
        level[n] = depth.get(n, level[up])
        branch[n] = 0 if n in depth else branch[up] or n
    levels: list[dict] = [{} for _ in chosen]  # by level: block (or line of no block) -> its lines, in order
    keep: list[int] = []
    reached = 0
    for i in seen:
        n = lines[i][2]
        for k in range(reached, level[n]):
            levels[k][chosen[k]] = []
        reached = max(reached, level[n])
        if level[n] == len(chosen):
            keep.append(i)
        else:
            levels[level[n]].setdefault(branch[n] or -1 - i, []).append(i)
    main = within(page, lambda n: kinds[n] == "h1")
    for mine, best in zip(levels, chosen):
        firm: list[int] = []  # main headings that wait for a kept block
        run: list[int] = []  # the last headings in a row, which wait too
        fresh = False  # the last block was a heading
        for block, rows in mine.items():
            if block > 0 and kinds[block] in HEADINGS:
                if not fresh:
                    firm += [i for i in run if main[lines[i][2]]]
                    run = []
                run += rows
                fresh = True
                continue
            fresh = False
            size = sum(len(lines[i][0]) for i in rows)
            if block == best or 2 * sum(len(lines[i][0]) for i in rows if content[i]) > size:
                keep += firm + run + rows
                firm, run = [], []
    return sorted(set(keep))


def main_text(html: str | None) -> str:
    """Main text of a page; null, empty and textless pages give an empty string.

    Any text is a page: declarations nobody knows are skipped, markup that never ends is text, elements may nest
    to any depth. Time grows with the characters, not with their square.
    """
    if not html:
        return ""
    page = Lines().read(html)
    lines = sifted(page)
    if all(line[3] for line in lines):
        return ""
    return " ".join(lines[i][0] for i in region(lines, page))


def extract(html: str = "html") -> Column:
    """Column ``struct<text, n_chars>`` of a column of pages.

    Each row is judged by its own page alone: equal pages give equal texts, repeated rows and other columns don't matter,
    an empty table gives no rows.
    """

    @F.pandas_udf("text string, n_chars long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return run(F.col(f"`{html}`"))
