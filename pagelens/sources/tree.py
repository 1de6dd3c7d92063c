"""HTML to a tree, as the HTML standard builds it: a tokenizer and the tree construction stage with its insertion modes.

Misnested formatting is mended by the adoption agency, what does not belong into a table goes before it, and what the
standard calls a bogus comment (marked sections, processing instructions) is skipped. No input raises but one whose
formatting would grow beyond measure. Scripting is off; frames are kept as plain elements; the content of a template
stays below it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

# Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base basefont bgsound br col embed hr img input keygen link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = HEADINGS | frozenset("address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
BLOCK_ENDS = (BLOCKS - {"p"}) | {"button", "listing", "pre"}
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
BODIES = frozenset(("tbody", "tfoot", "thead"))
SCOPE = ("applet", "caption", "html", "table", "td", "th", "marquee", "object", "template", "svg:foreignobject", "svg:desc", "svg:title")
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = (*SCOPE, "ol", "ul"), (*SCOPE, "button"), ("html", "table", "template")
RAW = frozenset("style xmp iframe noembed noframes script".split())
RCDATA = frozenset(("title", "textarea"))
BREAKOUT = HEADINGS | frozenset("b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

_NAME = re.compile(r"[^\t\n\f\r />]*")
_ATTR = re.compile(r"""[\t\n\f\r /]*(=?[^\t\n\f\r />=]+|=)[\t\n\f\r ]*(?:=[\t\n\f\r ]*(?:"([^"]*)"?|'([^']*)'?|([^\t\n\f\r >]*)))?""")
_TAIL = re.compile(r"[\t\n\f\r /]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW | RCDATA}
_BLANK = re.compile(r"[\t\n\f\r ]*")
#: Elements that a page's formatting may add for each of its tags.
MAX_GROWTH = 64


class PageError(ValueError):
    """A page that cannot be turned into a tree."""


class Element:
    __slots__ = ("tag", "key", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: str = ""):
        self.tag, self.attrs, self.up = tag, attrs, None
        self.key = foreign + tag
        self.kids: list[Element | Text] = []


class Text:
    __slots__ = ("parts", "up")

    def __init__(self, data: str):
        self.parts, self.up = [data], None


def _attributes(html: str, i: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from place i on, the place after the tag, and whether it closes itself; place -1: the page ends within."""
    attrs: dict[str, str] = {}
    if html.startswith(">", i):
        return attrs, i + 1, False
    while True:
        m = _ATTR.match(html, i)
        if not m:
            break
        i = m.end()
        if i >= len(html):
            return attrs, -1, False
        name, *values = m.groups()
        value = next((v for v in values if v is not None), "")
        attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
    m = _TAIL.match(html, i)
    i = m.end()
    return (attrs, i + 1, m.group().endswith("/")) if html.startswith(">", i) else (attrs, -1, False)


class Builder:
    """Tree of one page; build() returns its html element."""

    def __init__(self):
        self.root: Element | None = None
        self.head = self.form = None
        self.open: list[Element] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.formatting: list[Element | None] = []
        self.mode, self.quirks, self.foster, self.skip_newline = "before_html", True, False, False
        self.pending: list[str] = []
        self.made = self.tags = 0
        self.raw: str | None = None

    # ---- the stack of open elements ----

    def push(self, e: Element) -> None:
        self.at[e.key].append(len(self.open))
        self.open.append(e)

    def pop(self) -> Element:
        e = self.open.pop()
        self.at[e.key].pop()
        return e

    def reindex(self) -> None:
        self.at.clear()
        for i, e in enumerate(self.open):
            self.at[e.key].append(i)

    def place(self, e: Element) -> int:
        """Where e is among the open elements, -1 if it is not."""
        return next((i for i in reversed(self.at[e.key]) if self.open[i] is e), -1)

    def in_scope(self, *tags: str, scope: tuple[str, ...] = SCOPE) -> bool:
        if self.open and self.open[-1].key in tags:  # nothing lies above it
            return True
        best = max((self.at[t][-1] for t in tags if self.at[t]), default=-1)
        if best < 0:
            return False
        for m in scope:
            if self.at[m] and self.at[m][-1] > best:
                return False
        return True

    def pop_until(self, *tags: str) -> None:
        while self.pop().key not in tags:
            pass

    def pop_to_context(self, *tags: str) -> None:
        while self.open[-1].key not in (*tags, "template", "html"):
            self.pop()

    def implied_ends(self, but: str = "") -> None:
        while self.open[-1].key in IMPLIED and self.open[-1].key != but:
            self.pop()

    def close_p(self) -> None:
        if self.at["p"] and self.in_scope("p", scope=BUTTON_SCOPE):
            self.implied_ends("p")
            self.pop_until("p")

    # ---- insertion ----

    def home(self, target: Element | None = None) -> tuple[Element, int]:
        """The element that gets the next node, and the place among its children; before the table when it must not go in."""
        target = target or self.open[-1]
        if self.foster and target.key in ("table", "tbody", "tfoot", "thead", "tr"):
            template, table = (self.at[k][-1] if self.at[k] else -1 for k in ("template", "table"))
            if template > table:
                target = self.open[template]
            elif table < 0:
                target = self.open[0]
            else:
                above = self.open[table].up
                if above is None:
                    target = self.open[table - 1]
                else:
                    i = len(above.kids) - 1
                    while above.kids[i] is not self.open[table]:
                        i -= 1
                    return above, i
        return target, len(target.kids)

    def put(self, node: Element | Text, parent: Element, i: int) -> None:
        parent.kids.insert(i, node)
        node.up = parent

    def detach(self, node: Element) -> None:
        if node.up is not None:
            kids, i = node.up.kids, len(node.up.kids) - 1
            while kids[i] is not node:
                i -= 1
            del kids[i]
            node.up = None

    def insert(self, tag: str, attrs: dict[str, str], foreign: str = "") -> Element:
        self.made += 1
        if self.made > MAX_GROWTH * self.tags + 1000:
            raise PageError("misnested formatting grows beyond measure")
        e = Element(tag, attrs, foreign)
        self.put(e, *self.home())
        self.push(e)
        return e

    def insert_void(self, tag: str, attrs: dict[str, str]) -> None:
        self.insert(tag, attrs)
        self.pop()

    def insert_text(self, data: str) -> None:
        parent, i = self.home()
        if i and isinstance(parent.kids[i - 1], Text):
            parent.kids[i - 1].parts.append(data)
        else:
            self.put(Text(data), parent, i)

    # ---- active formatting elements ----

    def add_formatting(self, e: Element) -> None:
        alike = []
        for x in reversed(self.formatting):
            if x is None:
                break
            if x.tag == e.tag and x.attrs == e.attrs:
                alike.append(x)
        if len(alike) >= 3:
            self.formatting.remove(alike[-1])
        self.formatting.append(e)

    def reconstruct(self) -> None:
        f = self.formatting
        if not f or f[-1] is None or self.place(f[-1]) >= 0:
            return
        i = len(f) - 1
        while i and f[i - 1] is not None and self.place(f[i - 1]) < 0:
            i -= 1
        for i in range(i, len(f)):
            f[i] = self.insert(f[i].tag, dict(f[i].attrs))

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def last_formatting(self, tag: str) -> Element | None:
        for x in reversed(self.formatting):
            if x is None:
                return None
            if x.tag == tag:
                return x
        return None

    def adopt(self, tag: str) -> None:
        """The adoption agency: an end tag of formatting, over blocks that it does not close."""
        if self.open[-1].key == tag and self.open[-1] not in self.formatting:
            self.pop()
            return
        for _ in range(8):
            e = self.last_formatting(tag)
            if e is None:
                self.other_end(tag)
                return
            if self.open[-1] is e:  # nothing lies above it
                self.pop()
                self.formatting.remove(e)
                return
            at = self.place(e)
            if at < 0:
                self.formatting.remove(e)
                return
            if any(self.at[m] and self.at[m][-1] > at for m in SCOPE):
                return
            block = next((i for i in range(at + 1, len(self.open)) if self.open[i].key in SPECIAL), -1)
            if block < 0:
                while self.pop() is not e:
                    pass
                self.formatting.remove(e)
                return
            above, furthest = self.open[at - 1], self.open[block]
            mark, last, count, i = self.formatting.index(e), furthest, 0, block
            while True:
                count, i = count + 1, i - 1
                node = self.open[i]
                if node is e:
                    break
                listed = self.formatting.index(node) if node in self.formatting else -1
                if listed >= 0 and count > 3:
                    del self.formatting[listed]
                    mark -= listed < mark
                    listed = -1
                if listed < 0:
                    del self.open[i]
                    continue
                self.made += 1
                copy = Element(node.tag, dict(node.attrs))
                self.formatting[listed] = self.open[i] = copy
                if last is furthest:
                    mark = listed + 1
                self.detach(last)
                self.put(last, copy, len(copy.kids))
                last = copy
            self.detach(last)
            self.reindex()
            self.foster, before = above.key in ("table", "tbody", "tfoot", "thead", "tr"), self.foster
            self.put(last, *self.home(above))
            self.foster = before
            self.made += 1
            copy = Element(e.tag, dict(e.attrs))
            copy.kids, furthest.kids = furthest.kids, []
            for kid in copy.kids:
                kid.up = copy
            self.put(copy, furthest, 0)
            listed = self.formatting.index(e)
            self.formatting.insert(mark, copy)
            del self.formatting[listed + (mark <= listed)]
            self.open.remove(e)
            self.open.insert(next(i for i, x in enumerate(self.open) if x is furthest) + 1, copy)
            self.reindex()

    def other_end(self, tag: str) -> None:
        if not self.at[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].key == tag:
                self.implied_ends(tag)
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i].key in SPECIAL:
                return

    # ---- tokens ----

    def build(self, html: str) -> Element:
        i, n = 0, len(html)
        html_lower_ends: dict[str, bool] = {}
        while i < n:
            if self.raw:
                tag, self.raw = self.raw, None
                m = _RAW_END[tag].search(html, i) if tag != "plaintext" and html_lower_ends.get(tag, True) else None
                if m is None:
                    html_lower_ends[tag] = False
                end = m.start() if m else n
                data = html[i:end]
                if data.startswith("\n") and self.skip_newline:
                    data = data[1:]
                self.skip_newline = False
                if data:
                    self.insert_text(unescape(data) if tag in RCDATA else data)
                if m:
                    _, i, _ = _attributes(html, m.end())
                    i = i if i >= 0 else n
                else:
                    i = n
                self.pop()
                continue
            j = html.find("<", i)
            j = n if j < 0 else j
            if j > i:
                data = html[i:j]
                self.text(unescape(data) if "&" in data else data)
            i = j + 1
            if i >= n:
                if j < n:
                    self.text("<")
                break
            c = html[i]
            if c.isascii() and c.isalpha():
                m = _NAME.match(html, i)
                attrs, i, closed = _attributes(html, m.end())
                if i < 0:
                    break
                self.tags += 1
                self.start(m.group().lower(), attrs, closed)
            elif c == "/":
                if html[i + 1 : i + 2].isascii() and html[i + 1 : i + 2].isalpha():
                    m = _NAME.match(html, i + 1)
                    _, i, _ = _attributes(html, m.end())
                    if i < 0:
                        break
                    self.tags += 1
                    self.end(m.group().lower())
                else:
                    i = self.skip(html, i)
            elif html.startswith("!--", i):
                if html.startswith((">", "->"), i + 3):
                    i = html.index(">", i) + 1
                else:
                    m = _COMMENT_END.search(html, i + 3)
                    i = m.end() if m else n
            elif html.startswith("![CDATA[", i) and self.open and ":" in self.open[-1].key:
                k = html.find("]]>", i)
                self.text(html[i + 8 : k if k >= 0 else n])
                i = k + 3 if k >= 0 else n
            elif c == "!" or c == "?":
                if html[i + 1 : i + 8].lower() == "doctype" and self.root is None:
                    self.quirks = False
                i = self.skip(html, i)
            else:
                self.text("<")
        self.finish()
        return self.root

    def skip(self, html: str, i: int) -> int:
        k = html.find(">", i)
        return k + 1 if k >= 0 else len(html)

    def finish(self) -> None:
        self.flush()
        if self.mode in ("before_html", "before_head", "in_head", "in_head_noscript", "after_head"):
            self.raw = None
            self.start("body", {}, False)

    def text(self, data: str) -> None:
        data = data.replace("\x00", "")
        if self.skip_newline:
            self.skip_newline = False
            data = data[1:] if data.startswith("\n") else data
        if not data:
            return
        if self.mode in ("before_html", "before_head", "in_head", "in_head_noscript", "after_head", "in_colgroup"):
            blank = _BLANK.match(data).group()
            if blank and self.mode in ("in_head", "in_head_noscript", "after_head", "in_colgroup"):
                self.insert_text(blank)
            data = data[len(blank) :]
            while data and self.mode in ("before_html", "before_head", "in_head", "in_head_noscript", "after_head", "in_colgroup"):
                self.leave()
            if not data:
                return
            self.text(data)
        elif self.mode in ("in_table", "in_body_part", "in_row") and self.open[-1].key in ("table", "tbody", "tfoot", "thead", "tr"):
            self.pending.append(data)
        elif self.mode == "in_frameset":
            return
        elif self.mode in ("in_select", "in_select_in_table") or ":" in self.open[-1].key:
            self.insert_text(data)
        else:
            if self.mode == "after_body" and data.strip("\t\n\f\r "):
                self.mode = "in_body"
            self.reconstruct()
            self.insert_text(data)

    def flush(self) -> None:
        """Text that has been met between the parts of a table: blanks stay there, other text goes before it."""
        if self.pending:
            data, self.pending = "".join(self.pending), []
            if data.strip("\t\n\f\r "):
                self.foster = True
                self.reconstruct()
                self.insert_text(data)
                self.foster = False
            else:
                self.insert_text(data)

    def leave(self) -> None:
        """What is neither blank nor of the present mode ends the mode: the elements that a page leaves out."""
        if self.mode == "before_html":
            self.made += 1
            self.root = Element("html", {})
            self.push(self.root)
            self.mode = "before_head"
        elif self.mode == "before_head":
            self.head = self.insert("head", {})
            self.mode = "in_head"
        elif self.mode == "in_head_noscript":
            self.pop()
            self.mode = "in_head"
        elif self.mode == "in_head":
            self.pop()
            self.mode = "after_head"
        elif self.mode == "after_head":
            self.insert("body", {})
            self.mode = "in_body"
        elif self.mode == "in_colgroup":
            if self.open[-1].key == "colgroup":
                self.pop()
            self.mode = "in_table"

    def reset(self) -> None:
        """The mode that the open elements call for."""
        for i in range(len(self.open) - 1, -1, -1):
            key = self.open[i].key
            if key == "select":
                self.mode = "in_select_in_table" if self.at["table"] and self.at["table"][-1] < i else "in_select"
            elif key in ("td", "th"):
                self.mode = "in_cell"
            elif key in BODIES:
                self.mode = "in_body_part"
            elif key in ("tr", "caption", "colgroup", "table", "frameset"):
                self.mode = {"tr": "in_row"}.get(key, f"in_{key}")
            elif key in ("template", "body"):
                self.mode = "in_body"
            elif key == "head":
                self.mode = "in_head"
            elif key == "html":
                self.mode = "before_head" if self.head is None else "after_head"
            else:
                continue
            return

    # ---- start tags ----

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        self.flush()
        self.skip_newline = False
        if tag == "html":
            if self.root is None:
                self.leave()
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self.open and ":" in self.open[-1].key and self.foreign_start(tag, attrs, closed):
            return
        while not getattr(self, "start_" + self.mode)(tag, attrs):
            pass
        if closed and self.open and self.open[-1].key in (f"svg:{tag}", f"math:{tag}"):
            self.pop()

    def foreign_start(self, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        space = self.open[-1].key.partition(":")[0] + ":"
        if self.open[-1].key in ("svg:foreignobject", "svg:desc", "svg:title", "math:mi", "math:mo", "math:mn", "math:ms", "math:mtext"):
            return False
        if tag in BREAKOUT or tag == "font" and not {"color", "face", "size"}.isdisjoint(attrs):
            while ":" in self.open[-1].key:
                self.pop()
            return False
        self.insert(tag, attrs, space)
        if closed:
            self.pop()
        return True

    def start_before_html(self, tag, attrs):
        self.leave()

    def start_before_head(self, tag, attrs):
        if tag != "head":
            self.leave()
            return False
        self.head = self.insert("head", attrs)
        self.mode = "in_head"
        return True

    def start_in_head(self, tag, attrs):
        if tag in ("title", "style", "script", "noframes"):
            self.insert(tag, attrs)
            self.raw = tag
        elif tag == "template":
            self.insert(tag, attrs)
            self.formatting.append(None)
            self.mode = "in_body"
        elif tag in HEAD_TAGS:
            self.insert_void(tag, attrs)
        elif tag == "noscript" and self.mode == "in_head":
            self.insert(tag, attrs)
            self.mode = "in_head_noscript"
        elif tag != "head":
            self.leave()
            return False
        return True

    def start_in_head_noscript(self, tag, attrs):
        if tag in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            return self.start_in_head(tag, attrs)
        if tag not in ("head", "noscript"):
            self.leave()
            return False
        return True

    def start_after_head(self, tag, attrs):
        if tag == "body":
            self.insert(tag, attrs)
            self.mode = "in_body"
        elif tag == "frameset":
            self.insert(tag, attrs)
            self.mode = "in_frameset"
        elif tag in HEAD_TAGS:  # these still go into the head
            self.push(self.head)
            self.start_in_head(tag, attrs)
            self.open.remove(self.head)
            self.reindex()
        elif tag != "head":
            self.leave()
            return False
        return True

    def start_in_frameset(self, tag, attrs):
        if tag == "frameset":
            self.insert(tag, attrs)
        elif tag == "frame":
            self.insert_void(tag, attrs)
        elif tag == "noframes":
            self.start_in_head(tag, attrs)
        return True

    def start_after_body(self, tag, attrs):
        self.mode = "in_body"
        return False

    def start_in_body(self, tag, attrs):
        if tag in HEAD_TAGS:
            mode, self.mode = self.mode, "in_body"
            self.start_in_head(tag, attrs)
            self.mode = "in_body" if tag == "template" else mode
        elif tag == "body":
            if len(self.open) > 1 and self.open[1].key == "body":
                for k, v in attrs.items():
                    self.open[1].attrs.setdefault(k, v)
        elif tag in BLOCKS or tag in ("pre", "listing"):
            self.close_p()
            self.insert(tag, attrs)
            self.skip_newline = tag in ("pre", "listing")
        elif tag in HEADINGS:
            self.close_p()
            if self.open[-1].key in HEADINGS:
                self.pop()
            self.insert(tag, attrs)
        elif tag == "form":
            if self.form is None or self.at["template"]:
                self.close_p()
                e = self.insert(tag, attrs)
                self.form = self.form if self.at["template"] else e
        elif tag in ("li", "dd", "dt"):
            alike = ("li",) if tag == "li" else ("dd", "dt")
            if any(self.at[t] for t in alike):
                for e in reversed(self.open):
                    if e.key in alike:
                        self.implied_ends(e.key)
                        self.pop_until(e.key)
                        break
                    if e.key in SPECIAL and e.key not in ("address", "div", "p"):
                        break
            self.close_p()
            self.insert(tag, attrs)
        elif tag in ("plaintext", "xmp"):
            self.close_p()
            if tag == "xmp":
                self.reconstruct()
            self.insert(tag, attrs)
            self.raw = tag
        elif tag == "button":
            if self.in_scope("button"):
                self.implied_ends()
                self.pop_until("button")
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in FORMATTING:
            again = self.last_formatting("a") if tag == "a" else None
            if again is not None:
                self.adopt("a")
                if again in self.formatting:
                    self.formatting.remove(again)
                if self.place(again) >= 0:
                    self.open.remove(again)
                    self.reindex()
            self.reconstruct()
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.add_formatting(self.insert(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.formatting.append(None)
        elif tag == "table":
            if not self.quirks:
                self.close_p()
            self.insert(tag, attrs)
            self.mode = "in_table"
        elif tag == "hr":
            self.close_p()
            self.insert_void(tag, attrs)
        elif tag in ("param", "source", "track"):
            self.insert_void(tag, attrs)
        elif tag in VOID and tag != "col" or tag == "image":
            self.reconstruct()
            self.insert_void("img" if tag == "image" else tag, attrs)
        elif tag in ("textarea", "iframe", "noembed"):
            if tag == "iframe":
                self.reconstruct()
            self.insert(tag, attrs)
            self.raw, self.skip_newline = tag, tag == "textarea"
        elif tag == "select":
            self.reconstruct()
            self.insert(tag, attrs)
            self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_body_part", "in_row", "in_cell") else "in_select"
        elif tag in ("optgroup", "option"):
            if self.open[-1].key == "option":
                self.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.implied_ends("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        elif tag in ("math", "svg"):
            self.reconstruct()
            self.insert(tag, attrs, f"{tag}:")
        elif tag not in TABLE_PARTS and tag not in ("frame", "head", "frameset"):
            self.reconstruct()
            self.insert(tag, attrs)
        return True

    def start_in_table(self, tag, attrs):
        if tag == "caption":
            self.pop_to_context("table")
            self.formatting.append(None)
            self.insert(tag, attrs)
            self.mode = "in_caption"
        elif tag in ("colgroup", "col"):
            self.pop_to_context("table")
            self.insert("colgroup", attrs if tag == "colgroup" else {})
            self.mode = "in_colgroup"
            return tag == "colgroup"
        elif tag in BODIES or tag in ("td", "th", "tr"):
            self.pop_to_context("table")
            self.insert(tag if tag in BODIES else "tbody", attrs if tag in BODIES else {})
            self.mode = "in_body_part"
            return tag in BODIES
        elif tag == "table":
            if not self.in_scope("table", scope=TABLE_SCOPE):
                return True
            self.pop_until("table")
            self.reset()
            return False
        elif tag in ("style", "script", "template"):
            return self.start_in_body(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert_void(tag, attrs)
        elif tag == "form":
            if self.form is None and not self.at["template"]:
                self.form = self.insert(tag, attrs)
                self.pop()
        else:
            self.foster = True
            self.start_in_body(tag, attrs)
            self.foster = False
        return True

    def start_in_caption(self, tag, attrs):
        if tag not in TABLE_PARTS:
            return self.start_in_body(tag, attrs)
        return not self.end_in_caption("caption")

    def start_in_colgroup(self, tag, attrs):
        if tag == "col":
            self.insert_void(tag, attrs)
            return True
        if tag == "template":
            return self.start_in_body(tag, attrs)
        self.leave()
        return False

    def start_in_body_part(self, tag, attrs):
        if tag in ("tr", "td", "th"):
            self.pop_to_context(*BODIES)
            self.insert("tr", attrs if tag == "tr" else {})
            self.mode = "in_row"
            return tag == "tr"
        if tag in TABLE_PARTS:
            return not self.leave_body_part()
        return self.start_in_table(tag, attrs)

    def start_in_row(self, tag, attrs):
        if tag in ("td", "th"):
            self.pop_to_context("tr")
            self.insert(tag, attrs)
            self.mode = "in_cell"
            self.formatting.append(None)
            return True
        if tag in TABLE_PARTS:
            return not self.leave_row()
        return self.start_in_table(tag, attrs)

    def start_in_cell(self, tag, attrs):
        if tag not in TABLE_PARTS:
            return self.start_in_body(tag, attrs)
        return not self.leave_cell()

    def start_in_select(self, tag, attrs):
        if tag in ("option", "optgroup", "hr"):
            if self.open[-1].key == "option":
                self.pop()
            if tag != "option" and self.open[-1].key == "optgroup":
                self.pop()
            self.insert(tag, attrs)
            if tag == "hr":
                self.pop()
        elif tag in ("select", "input", "keygen", "textarea"):
            if self.in_scope("select", scope=TABLE_SCOPE):
                self.pop_until("select")
                self.reset()
                return tag == "select"
        elif tag in ("script", "template"):
            return self.start_in_body(tag, attrs)
        return True

    def start_in_select_in_table(self, tag, attrs):
        if tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self.pop_until("select")
            self.reset()
            return False
        return self.start_in_select(tag, attrs)

    # ---- end tags: whether the mode has changed, so that the tag is looked at again ----

    def end(self, tag: str) -> None:
        self.flush()
        self.skip_newline = False
        if self.open and ":" in self.open[-1].key:
            for i in range(len(self.open) - 1, 0, -1):
                if ":" not in self.open[i].key:
                    break
                if self.open[i].tag == tag:
                    while len(self.open) > i:
                        self.pop()
                    return
        while getattr(self, "end_" + self.mode)(tag):
            pass

    def end_early(self, tag):
        if tag in ("body", "html", "br") or tag == "head" and self.mode != "after_head":
            self.leave()
            return True
        if tag == "template" and self.at["template"]:
            self.end_template()
        return False

    end_before_html = end_before_head = end_after_head = end_early

    def end_in_head(self, tag):
        if tag == "head":
            self.leave()
            return False
        return self.end_early(tag)

    def end_in_head_noscript(self, tag):
        if tag in ("noscript", "br"):
            self.leave()
            return tag == "br"
        return False

    def end_in_frameset(self, tag):
        if tag == "frameset" and len(self.open) > 1:
            self.pop()
        return False

    def end_after_body(self, tag):
        if tag == "html":
            return False
        self.mode = "in_body"
        return True

    def end_template(self):
        self.implied_ends()
        self.pop_until("template")
        self.clear_formatting()
        self.reset()

    def end_in_body(self, tag):
        if tag == "template":
            if self.at["template"]:
                self.end_template()
        elif tag in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after_body"
        elif tag in BLOCK_ENDS:
            if self.in_scope(tag):
                self.implied_ends()
                self.pop_until(tag)
        elif tag == "form":
            e, self.form = self.form, None
            if e is not None and (at := self.place(e)) >= 0 and all(not self.at[m] or self.at[m][-1] < at for m in SCOPE):
                self.implied_ends()
                if self.open[-1] is e:
                    self.pop()
                elif self.place(e) >= 0:
                    self.open.remove(e)
                    self.reindex()
        elif tag == "p":
            if not self.in_scope("p", scope=BUTTON_SCOPE):
                self.insert("p", {})
            self.close_p()
        elif tag in ("li", "dd", "dt"):
            if self.in_scope(tag, scope=LIST_SCOPE if tag == "li" else SCOPE):
                self.implied_ends(tag)
                self.pop_until(tag)
        elif tag in HEADINGS:
            if self.in_scope(*HEADINGS):
                self.implied_ends()
                self.pop_until(*HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.implied_ends()
                self.pop_until(tag)
                self.clear_formatting()
        elif tag == "br":
            self.start_in_body("br", {})
        else:
            self.other_end(tag)
        return False

    def end_in_table(self, tag):
        if tag == "table":
            if self.in_scope("table", scope=TABLE_SCOPE):
                self.pop_until("table")
                self.reset()
        elif tag == "template":
            return self.end_in_body(tag)
        elif tag not in TABLE_PARTS and tag not in ("body", "html"):
            self.foster = True
            self.end_in_body(tag)
            self.foster = False
        return False

    def end_in_caption(self, tag):
        if tag in ("caption", "table"):
            if not self.in_scope("caption", scope=TABLE_SCOPE):
                return False
            self.implied_ends()
            self.pop_until("caption")
            self.clear_formatting()
            self.mode = "in_table"
            return True
        if tag not in TABLE_PARTS and tag not in ("body", "html"):
            return self.end_in_body(tag)
        return False

    def end_in_colgroup(self, tag):
        if tag in ("colgroup", "col"):
            if tag == "colgroup" and self.open[-1].key == "colgroup":
                self.leave()
            return False
        if tag == "template":
            return self.end_in_body(tag)
        self.leave()
        return True

    def leave_body_part(self) -> bool:
        if not self.in_scope(*BODIES, scope=TABLE_SCOPE):
            return False
        self.pop_to_context(*BODIES)
        self.pop()
        self.mode = "in_table"
        return True

    def end_in_body_part(self, tag):
        if tag in BODIES:
            if self.in_scope(tag, scope=TABLE_SCOPE):
                self.leave_body_part()
            return False
        if tag == "table":
            return self.leave_body_part()
        if tag in TABLE_PARTS or tag in ("body", "html"):
            return False
        return self.end_in_table(tag)

    def leave_row(self) -> bool:
        if not self.in_scope("tr", scope=TABLE_SCOPE):
            return False
        self.pop_to_context("tr")
        self.pop()
        self.mode = "in_body_part"
        return True

    def end_in_row(self, tag):
        if tag == "tr":
            self.leave_row()
            return False
        if tag == "table" or tag in BODIES and self.in_scope(tag, scope=TABLE_SCOPE):
            return self.leave_row()
        if tag in TABLE_PARTS or tag in ("body", "html"):
            return False
        return self.end_in_table(tag)

    def leave_cell(self) -> bool:
        if not self.in_scope("td", "th", scope=TABLE_SCOPE):
            return False
        self.implied_ends()
        self.pop_until("td", "th")
        self.clear_formatting()
        self.mode = "in_row"
        return True

    def end_in_cell(self, tag):
        if tag in ("td", "th"):
            if self.in_scope(tag, scope=TABLE_SCOPE):
                self.implied_ends()
                self.pop_until(tag)
                self.clear_formatting()
                self.mode = "in_row"
            return False
        if tag in BODIES or tag in ("table", "tr"):
            return self.in_scope(tag, scope=TABLE_SCOPE) and self.leave_cell()
        if tag in TABLE_PARTS or tag in ("body", "html"):
            return False
        return self.end_in_body(tag)

    def end_in_select(self, tag):
        if tag == "optgroup":
            if self.open[-1].key == "option" and self.open[-2].key == "optgroup":
                self.pop()
            if self.open[-1].key == "optgroup":
                self.pop()
        elif tag == "option":
            if self.open[-1].key == "option":
                self.pop()
        elif tag == "select":
            if self.in_scope("select", scope=TABLE_SCOPE):
                self.pop_until("select")
                self.reset()
        elif tag == "template":
            return self.end_in_body(tag)
        return False

    def end_in_select_in_table(self, tag):
        if tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if self.in_scope(tag, scope=TABLE_SCOPE):
                self.pop_until("select")
                self.reset()
                return True
            return False
        return self.end_in_select(tag)
