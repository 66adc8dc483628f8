"""A forgiving HTML tree: implied end tags, reopened formatting, misplaced table content."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head title meta link noscript svg".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul li dd dt".split()
)
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
TABLE_TAGS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
CELLS = frozenset(("td", "th", "caption"))
#: Formatting elements alike in all that are reopened together at most, as in the standard.
ALIKE = 3
_HALF = re.compile(r"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));")


class Node:
    """An element (tag, attributes, children) or a text (tag "", text)."""

    __slots__ = ("attrs", "children", "parent", "shows", "tag", "text", "_style")

    def __init__(self, tag: str, attrs: dict | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None
        self._style = None
        self.shows: bool | None = None  # whether a reader sees text in it; said once the tree stands

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag]

    @property
    def style(self) -> dict[str, str]:
        """The inline declarations, lower-cased, the last of a name."""
        if self._style is None:
            self._style = {}
            for part in self.attrs.get("style", "").split(";"):
                name, colon, value = part.lstrip(":").partition(":")
                if colon and value:
                    self._style[name.strip().lower()] = value.lower().replace("!important", "").strip()
        return self._style

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def walk(self):
        """All nodes inside, in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.children[::-1]


def join_halves(html: str) -> str:
    """Two character references that are the halves of one UTF-16 pair, as one reference."""
    if "&#" not in html:
        return html
    out, done, before = [], 0, None
    for m in _HALF.finditer(html):
        code = int(m[1]) if m[1] else int(m[2], 16)
        if before and before[1] == m.start() and 0xDC00 <= code < 0xE000:
            out += [html[done : before[0]], f"&#x{0x10000 + ((before[2] - 0xD800) << 10) + (code - 0xDC00):X};"]
            done, before = m.end(), None
        else:
            before = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
    return "".join(out) + html[done:]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body = Node("body")
        self.open = [self.body]
        self.active: list[Node | None] = []  # formatting to reopen; None marks a cell

    # where things go

    def _put(self, node: Node) -> None:
        here = self.open[-1]
        if here.tag in TABLE_PARTS and node.tag not in TABLE_TAGS and (node.tag or node.text.strip()):
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None and table.parent is not None:  # it stands before the table
                node.parent = table.parent
                table.parent.children.insert(table.parent.children.index(table), node)
                return
        here.append(node)

    def _push(self, tag: str, attrs: dict | None = None) -> Node:
        node = Node(tag, attrs)
        self._put(node)
        self.open.append(node)
        return node

    def _reopen(self) -> None:
        start = len(self.active)
        while start and self.active[start - 1] is not None and self.active[start - 1] not in self.open:
            start -= 1
        for k in range(start, len(self.active)):
            self.active[k] = self._push(self.active[k].tag, dict(self.active[k].attrs))

    def _close(self, tags, stop=()) -> bool:
        """Closes the innermost open element of tags, unless one of stop is met first."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                if any(n.tag in CELLS for n in self.open[k:]):
                    while self.active and self.active.pop() is not None:
                        pass
                del self.open[k:]
                return True
            if tag in stop:
                return False
        return False

    # tokens

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head"):
            return
        if tag == "body":
            self.body.attrs = attrs | self.body.attrs
            return
        cell = ("td", "th", "caption", "table")
        if tag in ENDS_PARAGRAPH:
            self._close(("p",), (*cell, "body"))
        if tag == "li":
            self._close(("li",), (*cell, "ul", "ol", "div", "blockquote"))
        elif tag in ("dd", "dt"):
            self._close(("dd", "dt"), (*cell, "dl", "div"))
        elif tag == "option":
            self._close(("option",), ("select",))
        elif tag in ("td", "th"):
            self._close(("td", "th"), ("table",))
            if self.open[-1].tag != "tr" and any(n.tag == "table" for n in self.open):
                self._close((), ())
                self._in_table(("tr",))
                if self.open[-1].tag == "table":
                    self._push("tbody")
                if self.open[-1].tag != "tr":
                    self._push("tr")
            if not any(n.tag == "table" for n in self.open):
                return
        elif tag == "tr":
            self._close(("tr",), ("table",))
            if not self._in_table(("thead", "tbody", "tfoot")):
                return
            if self.open[-1].tag == "table":
                self._push("tbody")
        elif tag in ("thead", "tbody", "tfoot", "caption", "colgroup"):
            self._close(("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",))
            if not self._in_table(()):
                return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        if tag == "a" and any(n is not None and n.tag == "a" for n in self.active[self._marker() :]):
            self.handle_endtag("a")
        if tag in FORMATTING or tag not in (ENDS_PARAGRAPH | TABLE_TAGS | {"table"}):
            self._reopen()
        if tag in VOID:
            self._put(Node(tag, attrs))
            return
        node = self._push(tag, attrs)
        if tag in FORMATTING:
            alike = [n for n in self.active[self._marker() :] if n.tag == tag and n.attrs == attrs]
            if len(alike) >= ALIKE:
                self.active.remove(alike[0])
            self.active.append(node)
        elif tag in CELLS:
            self.active.append(None)

    def _in_table(self, parts) -> bool:
        """Leaves whatever is open inside the innermost table, but parts; false outside of tables."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == "table" or self.open[k].tag in parts:
                del self.open[k + 1 :]
                return True
        return False

    def _marker(self) -> int:
        return max((k + 1 for k, n in enumerate(self.active) if n is None), default=0)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            self._put(Node("br"))
        elif tag == "p":
            if not self._close(("p",), ("td", "th", "caption", "table")):
                self._put(Node("p"))
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._close(("h1", "h2", "h3", "h4", "h5", "h6"), ("td", "th", "caption", "table"))
        elif tag not in VOID:
            inner = tag not in TABLE_TAGS and tag != "table"
            self._close((tag,), ("td", "th", "caption", "table") if inner else ("table",) if tag != "table" else ())

    def _end_formatting(self, tag: str) -> None:
        mark = self._marker()
        node = next((n for n in reversed(self.active[mark:]) if n.tag == tag), None)
        if node is None:
            self._close((tag,), ("td", "th", "caption", "table", *ENDS_PARAGRAPH))
            return
        self.active.remove(node)
        if node not in self.open:
            return
        at = self.open.index(node)
        block = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in ENDS_PARAGRAPH or self.open[k].tag in ("table", "td", "th")), None)
        if block is None:
            del self.open[at:]
            return
        # a block began inside: it moves out, and the formatting goes on inside what it holds
        moved, parent = self.open[block], node.parent
        if moved.parent is not None:
            moved.parent.children.remove(moved)
        moved.parent = parent
        parent.children.insert(parent.children.index(node) + 1, moved)
        copy = Node(node.tag, dict(node.attrs))
        for child in moved.children:
            child.parent = copy
        copy.children, moved.children = moved.children, []
        moved.append(copy)
        del self.open[at:block]

    def handle_data(self, data):
        if data.strip():
            self._reopen()
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and not last.tag and self.open[-1].tag not in TABLE_PARTS:
            last.text += data
        else:
            self._put(Node("", text=data))


def parse(html: str) -> Node:
    """The body of a document, without elements that hold no content."""
    builder = _Builder()
    builder.feed(join_halves(html))
    builder.close()
    stack = [builder.body]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if c.tag not in DROPPED]
        stack += node.children
    return builder.body
