"""A light tree of a page's blocks, and simple tree matching of two such trees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Tags of which all text is outside the page's text, whatever they hold.
RAW = "script|style|noscript|template|textarea|select|svg|iframe|title|object|canvas"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Elements that do not break a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An open element of the second kind ends where one of the first kind starts, up to the elements that hold it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+|[0-9]+")
TEXT = "#text"


@dataclass(slots=True)
class Node:
    """A block, or with the label `TEXT` a run of text inside one."""

    label: str
    names: tuple[str, ...] = ()
    hidden: bool = False
    children: list[Node] = field(default_factory=list)
    text: str = ""
    linked: int = 0  # characters of the text inside links
    shape: int = 0
    size: int = 1


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    names, hidden = [], False
    for name, *values in NAMES.findall(raw):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            # words of fooBar-baz_2 are foo, bar, baz and 2
            names += WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
    return tuple(names), hidden


def parse(page: str) -> Node:
    """The blocks of a page: open paragraphs and items end where the next starts, stray end tags are ignored."""
    root = Node("html")
    stack, parts, link, linked = [root], [], 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                stack[-1].children.append(Node(TEXT, text=text, linked=linked))
            parts.clear()
            linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (link > 0)
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing = bool(m[2] or m[5])
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].label == tag:
                    del stack[k:]
                    link = 0
                    break
            continue
        if tag in ("html", "body") and len(stack) <= 2 and any(s.label == tag for s in stack):
            continue
        if stack[-1].label == "p":
            stack.pop()
        if tag in ENDS:
            ended, holders = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].label in holders:
                    break
                if stack[k].label in ended:
                    del stack[k:]
                    break
        names, hidden = _attributes(m[4] or m[7] or "")
        node = Node(tag, names, hidden)
        stack[-1].children.append(node)
        stack.append(node)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return measured(root)


def measured(root: Node) -> Node:
    """Set size and shape (equal for equal trees of labels) of every node, children first."""
    order = [root]
    for node in order:
        order += node.children
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.label, *(c.shape for c in node.children)))
    return root


def skeleton(root: Node, keys) -> str:
    """The tree with a key instead of each text, one node a line."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {node.label} {keys(node.text) if node.label == TEXT else ''}")
        todo += [(c, depth + 1) for c in reversed(node.children)]
    return "\n".join(out)


def from_skeleton(lines: str) -> Node:
    path: list[Node] = []
    for line in lines.split("\n"):
        depth, label, key = line.split(" ")
        node = Node(label, text=key)
        del path[int(depth) :]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return measured(path[0])


def match(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """Pairs of nodes of a largest simple tree matching: order and parents are kept, labels are equal.

    Children that start or end alike in both trees are paired at once; between
    them a table of best scores is filled. Scores of a pair of shapes are kept.
    """
    scores: dict[tuple[int, int], int] = {}

    def table(xs: list[Node], ys: list[Node]) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = rows[-1], [0]
            for j, y in enumerate(ys):
                best = above[j] + score(x, y)
                row.append(max(best, above[j + 1], row[j]))
            rows.append(row)
        return rows

    def middle(x: Node, y: Node) -> tuple[int, int]:
        xs, ys, k = x.children, y.children, 0
        most = min(len(xs), len(ys))
        while k < most and xs[k].shape == ys[k].shape:
            k += 1
        e = 0
        while e < most - k and xs[-1 - e].shape == ys[-1 - e].shape:
            e += 1
        return k, e

    def score(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        if x.shape == y.shape:
            return x.size
        key = (x.shape, y.shape)
        if key not in scores:
            k, e = middle(x, y)
            xs, ys = x.children, y.children
            same = sum(c.size for c in xs[:k]) + sum(c.size for c in xs[len(xs) - e :])
            scores[key] = 1 + same + table(xs[k : len(xs) - e], ys[k : len(ys) - e])[-1][-1]
        return scores[key]

    todo = [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        yield x, y
        xs, ys = x.children, y.children
        if x.shape == y.shape:
            todo += zip(xs, ys)
            continue
        k, e = middle(x, y)
        todo += zip(xs[:k], ys[:k])
        todo += zip(xs[len(xs) - e :], ys[len(ys) - e :])
        xs, ys = xs[k : len(xs) - e], ys[k : len(ys) - e]
        rows = table(xs, ys)
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))
