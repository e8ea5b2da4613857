"""Region of a page found line by line over whole paths of elements: slow, and the truth for ``pages.region``."""

from __future__ import annotations

import numpy as np

from subvox.llm.pages import COMMENT, CONTENT, HEADINGS, INLINE, OWN, VOTES, Lines, ratios, threshold


def path_lines(page):
    """Lines with all elements around them, the outermost first."""
    out = []
    for text, tags, n, hidden in page.lines:
        path = []
        while n:
            path.append(n)
            n = page.parent[n]
        out.append((text, tags, tuple(reversed(path)), hidden))
    return out


def sifted(page) -> list[tuple]:
    """Lines of a page, hidden also inside marked elements, but for those around the content.

    A mark does not count on an element around a main element, around an article element with votes, or with most of the
    votes (of the article around it, else of a page without article in sight). Comments are judged by votes only if they hold a main
    heading, a main element or the first article. If all lines were hidden, no mark counts.
    """
    lines, kinds, marks = path_lines(page), dict(enumerate(page.kinds)), page.marks
    seen = [i for i, line in enumerate(lines) if not line[3]]
    if not seen or marks.keys().isdisjoint(n for i in seen for n in lines[i][2]):
        return lines
    smooth = ratios(lines)
    cut = threshold(smooth[seen])
    around: set[int] = set()  # elements around what comments don't hold
    first, plain = None, False
    for i in seen:
        path = lines[i][2]
        heads = "h1" in map(kinds.get, path)
        plain = plain or marks.keys().isdisjoint(path) and any(kinds[n] == "main" or kinds[n] == "article" and heads for n in path)
        for n in path:
            if kinds[n] == "article" and first is None and n not in page.quoted:
                first = n
            if kinds[n] in ("h1", "main") or n == first:
                around.update(path[: path.index(n)])
    comments = {n for n, why in marks.items() if why == COMMENT and n not in around}
    votes: dict[int, int] = {}
    total = 0
    for i in seen:
        text, _, path, _ = lines[i]
        if smooth[i] >= cut and comments.isdisjoint(path):
            total += len(text)
            for n in path:
                votes[n] = votes.get(n, 0) + len(text)
    strong = {n for n, v in votes.items() if kinds[n] in CONTENT and n not in page.quoted and v >= OWN * total}
    anchors = strong | {n for n in votes if kinds[n] == "main"}
    shown: set[int] = set()
    for i in seen:
        path = lines[i][2]
        inner, at = None, max((k for k, n in enumerate(path) if n in anchors), default=-1)
        for k, n in enumerate(path):
            if n in anchors:
                inner = n
            elif n in marks and n not in comments and n not in shown:
                held = votes[inner] if inner else 0 if strong or plain else total
                if k < at or 2 * votes.get(n, 0) > held > 0:
                    shown.add(n)
    left = marks.keys() - shown
    out = [(text, tags, path, never or not left.isdisjoint(path)) for text, tags, path, never in lines]
    return lines if all(line[3] for line in out) else out


def region(lines: list[tuple], kinds: dict[int, str]) -> list[int]:
    """Numbers of the lines that hold the content, in order."""
    seen = [i for i, line in enumerate(lines) if not line[3]]
    smooth = ratios(lines)
    cut = threshold(smooth[seen])
    votes: dict[int, int] = {}
    children: dict[int, set[int]] = {}
    total, tops = 0, set()
    for i in seen:
        text, _, path, _ = lines[i]
        weight = len(text) if smooth[i] >= cut else 0
        total += weight
        for up, number in zip((None, *path), path):
            votes[number] = votes.get(number, 0) + weight
            (tops if up is None else children.setdefault(up, set())).add(number)
    articles = [n for n in votes if kinds[n] in CONTENT]
    if articles and (best := max(articles, key=lambda n: (votes[n], -n))) and 2 * votes[best] >= total:
        return [i for i in seen if best in lines[i][2]]
    chosen, held, below = [], total, tops
    while below:
        best = max(below, key=lambda n: (votes[n], -n))
        if votes[best] < VOTES * held or kinds[best] in ("p", *INLINE):
            break
        chosen.append(best)
        held, below = votes[best], children.get(best, set())
    return beside(lines, kinds, seen, chosen, smooth >= cut)


def beside(lines: list[tuple], kinds: dict[int, str], seen: list[int], chosen: list[int], content: np.ndarray) -> list[int]:
    """Lines of the last of the nested elements ``chosen``, and of what stands beside one of them: blocks with most characters in content lines, and headings before a kept block."""
    levels: list[dict] = [{} for _ in chosen]  # by level: block (or line of no block) -> its lines, in order
    keep: list[int] = []
    for i in seen:
        path = lines[i][2]
        level = next((k for k, n in enumerate(chosen) if k >= len(path) or path[k] != n), len(chosen))
        if level == len(chosen):
            keep.append(i)
        for k in range(min(level + 1, len(chosen))):
            levels[k].setdefault(path[k] if k < len(path) else -1 - i, []).append(i)
    for mine, best in zip(levels, chosen):
        waiting: list[int] = []
        fresh = False  # the last block was a heading
        for block, rows in mine.items():
            if block > 0 and kinds[block] in HEADINGS:
                waiting = [*(waiting if fresh else [i for i in waiting if "h1" in map(kinds.get, lines[i][2])]), *rows]
                fresh = True
                continue
            fresh = False
            size = sum(len(lines[i][0]) for i in rows)
            if block == best or 2 * sum(len(lines[i][0]) for i in rows if content[i]) > size:
                keep += waiting if block == best else [*waiting, *rows]
                waiting = []
    return sorted(set(keep))


def main_text(html):
    page = Lines().read(html)
    lines = sifted(page)
    if all(line[3] for line in lines):
        return ""
    return " ".join(lines[i][0] for i in region(lines, dict(enumerate(page.kinds))))
