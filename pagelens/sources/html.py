"""Pages to a table of document nodes, in one parsing step; everything after it is DataFrame work."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import SPACE
from pagelens.sources.tree import VOID, Builder, Element, Text

#: Nodes that are turned into a batch of Arrow at once.
NODES = 20_000

#: Elements whose text is kept whole with them, and those of which none is; all others keep its first HEAD characters.
WHOLE_TEXT = frozenset("title h1 h2 h3 h4 h5 h6 p a li dt dd table td th caption figcaption label summary button".split())
NO_TEXT = VOID | frozenset(("html", "head", "script", "style", "template"))
HEAD = 300
#: Ancestors that a node tells of in `within`, and those whose text is not shown.
INSIDE = frozenset("body head script style template noscript svg nav footer header aside label ul ol pre table a button details".split())
UNSHOWN = frozenset(("script", "style", "template"))
_BLANKS = re.compile(f"{SPACE}+")

NODE = "pre int, last int, parent int, depth int, sib int, kind string, tag string, text string, attrs map<string,string>, classes array<string>, parent_tag string, within array<string>, content string, chars int"
NAMES = [c.split()[0] for c in NODE.split(", ")]
_TYPES = [pa.int32()] * 5 + [pa.string()] * 3 + [pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32()]


class _Shown:
    """A page's shown texts, one after the other, white space collapsed across them too: any run of texts is a range of it, without a blank at either end."""

    def __init__(self, texts: Iterable[str]):
        parts, self.at, blank = [], [0], False
        for text in texts:
            text = _BLANKS.sub(" ", text)
            if blank and text[:1] == " ":
                text = text[1:]
            if text:
                blank = text[-1] == " "
            parts.append(text)
            self.at.append(self.at[-1] + len(text))
        self.text = "".join(parts)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where the texts from the a-th to before the b-th stand."""
        a, b = self.at[a], self.at[b]
        if a < b and self.text[a] == " ":
            a += 1
        return a, b - 1 if a < b and self.text[b - 1] == " " else b

    def chars(self, a: int, b: int) -> int:
        a, b = self.span(a, b)
        return b - a

    def head(self, a: int, b: int, n: int | None) -> str:
        a, b = self.span(a, b)
        return self.text[a:b] if n is None else self.text[a : min(b, a + n)].rstrip(" ")


def columns_of(root: Element) -> list[list]:
    """The columns of NODE for a tree, in document order; work and size are in proportion to its nodes and text."""
    last, parent, depth, sib, tags, texts, attrs, classes, parent_tag, within = cols = [[] for _ in range(10)]
    begin, end, parts = [], [], []
    withins: dict[tuple, tuple] = {}
    # the element whose children are gone through: the rest of them, its place, tag, level, children and elements so far, within, shown
    kids, up, up_tag, level, n, elements, inside, shown = iter((root,)), None, None, 0, 0, 0, (), True
    stack = []
    while True:
        for node in kids:
            n += 1
            at = len(tags)
            parent.append(up)
            depth.append(level)
            parent_tag.append(up_tag)
            within.append(inside)
            last.append(at)
            node.up = None  # a tree without cycles is freed at once, not by the collector
            begin.append(len(parts))
            end.append(len(parts))
            if node.__class__ is Text:
                text = node.parts[0] if len(node.parts) == 1 else "".join(node.parts)
                sib.append(n)
                tags.append(None)
                texts.append(text)
                attrs.append(())
                classes.append(())
                if shown:
                    parts.append(text)
                continue
            elements += 1
            tag = node.tag
            sib.append(elements)
            tags.append(tag)
            texts.append(None)
            own = node.attrs
            attrs.append(list(own.items()) if own else ())
            classes.append(own["class"].split() if "class" in own else ())
            if node.kids:
                stack.append((kids, up, up_tag, level, n, elements, inside, shown))
                if tag in INSIDE and tag not in inside:
                    inside = withins.setdefault((inside, tag), (*inside, tag))
                kids, up, up_tag, level, n, elements, shown = iter(node.kids), at, tag, level + 1, 0, 0, shown and tag not in UNSHOWN
                break
        else:
            if not stack:
                break
            last[up], end[up] = len(tags) - 1, len(parts)
            kids, up, up_tag, level, n, elements, inside, shown = stack.pop()
    page = _Shown(parts)
    content, chars = [None] * len(tags), [None] * len(tags)
    for i, tag in enumerate(tags):
        if tag is not None and tag not in NO_TEXT:
            content[i], chars[i] = page.head(begin[i], end[i], None if tag in WHOLE_TEXT else HEAD), page.chars(begin[i], end[i])
    return [list(range(len(tags))), *cols[:4], ["text" if tag is None else "element" for tag in tags], *cols[4:], content, chars]


def guarded(html: str | None) -> tuple[list[list], str | None]:
    """A page's columns, and what went wrong, if anything; a page that fails has no nodes."""
    if not html or not html.strip():
        return [[] for _ in NAMES], None
    try:
        return columns_of(Builder().build(html)), None
    except Exception as problem:  # one page must not end the job: it goes on as a row that says why
        return [[] for _ in NAMES], f"{type(problem).__name__}: {problem}"[:300]


def nodes_of(html: str | None) -> list[dict]:
    columns, _ = guarded(html)
    return [dict(zip(NAMES, row, strict=True)) | {"attrs": dict(row[8])} for row in zip(*columns, strict=True)]


def parse_dom(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Nodes of all pages (page_id and NODE): elements and texts in pre-order; an element's descendants are pre + 1 to last.

    Elements have their text as content, white space collapsed (those of WHOLE_TEXT all of it, others its beginning), and
    chars is the length of all of it. within lists the ancestors of INSIDE. sib counts an element among the elements of
    its parent, a text among all that its parent has.

    A page is parsed whole, however long it is. Null and blank pages have no nodes. A page that cannot be parsed has one
    row of kind 'error' with the reason as its text, and all others go on. The html column goes no further than this.
    """

    def run(batches):
        for batch in batches:
            ids, rows = [], [[] for _ in NAMES]

            def close():
                for lo in range(0, len(ids), NODES):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + NODES], pa.int64()), *(pa.array(c[lo : lo + NODES], t) for c, t in zip(rows, _TYPES, strict=True))], names=["page_id", *NAMES])

            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, problem = guarded(html.as_py())
                if problem:
                    found = [[{"pre": 0, "last": 0, "depth": 0, "sib": 0, "kind": "error", "text": problem, "attrs": (), "classes": (), "within": ()}.get(n)] for n in NAMES]
                ids += [page_id] * len(found[0])
                for column, more in zip(rows, found, strict=True):
                    column += more
                if len(ids) >= NODES:
                    yield from close()
                    ids, rows = [], [[] for _ in NAMES]
            yield from close()

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, " + NODE)
