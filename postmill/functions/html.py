"""HTML bodies as Markdown."""

from __future__ import annotations

import re
import sys
from urllib.parse import unquote_to_bytes

from postmill.functions import css
from postmill.functions.htmltree import Node, parse
from postmill.functions.invisible import is_emoji
from postmill.functions.layout import BREAK, RULE, Event, Piece, compose, formatted, gap, lines, opens_with_text, space, text

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements laid out as lines, and those that Markdown has a syntax for.
BLOCKS = frozenset(
    "p div section article header footer main nav aside address center figure figcaption form fieldset details summary"
    " dl dt dd li table caption thead tbody tfoot tr td th pre".split()
)
STRUCTURES = HEADINGS | {"ul", "ol", "blockquote", "hr"}
#: Endings of picture names, and what Office writes for a picture without a description.
PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".heic", ".svg")
DESCRIPTIONS = (
    "automatisch generierte beschreibung",
    "ki-generierte inhalte können fehlerhaft sein",
    "description automatically generated",
    "description generated with",
    "ai-generated content may be incorrect",
)
BOLD, ITALIC = "**", "*"
#: Calls that a level of the tree needs at once, and those that everything around it does.
FRAMES, AROUND = 12, 2_000
#: From so many points on, room between elements is seen.
SEEN = 3
#: Code points that are never shown (Default_Ignorable_Code_Point).
_WIDTHLESS = re.compile(
    "[\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)


def collapse(value: str) -> str:
    """Every run of white space as one space; characters without width stay."""
    return re.sub(r"\s+", " ", value)


def has_words(line: str) -> bool:
    """Whether a line holds text beside embedded pictures."""
    return bool(re.sub(r"!\[\[[^\]]*\]\]", "", line).strip(" "))


def bold_line(line: str) -> str:
    return BOLD + line.replace(BOLD, "") + BOLD if has_words(line) else line


def hidden(node: Node) -> bool:
    skip = node.attrs.get("data-skip-in-text")
    return "hidden" in node.attrs or (skip is not None and skip.lower() != "false") or node.style.get("display") == "none" or node.style.get("visibility") == "hidden"


def shown_texts(node: Node):
    """The texts with words that a reader sees in a node, in order."""
    stack = [node]
    while stack:
        node = stack.pop()
        if not node.tag:
            if node.text.strip():
                yield node
        elif not hidden(node):
            stack += node.children[::-1]


def mark_shown(body: Node) -> int:
    """Says of each node whether it shows text, inner ones first; returns how deep the tree is."""
    depth, order, stack = 0, [], [(body, 1)]
    while stack:
        node, level = stack.pop()
        depth = max(depth, level)
        order.append(node)
        stack += [(c, level + 1) for c in node.children]
    for node in reversed(order):
        node.shows = bool(node.text.strip()) if not node.tag else not hidden(node) and any(c.shows for c in node.children)
    return depth


def shows_text(node: Node) -> bool:
    return next(shown_texts(node), None) is not None if node.shows is None else node.shows


def _inside(node: Node, test, past_hidden: bool = False) -> bool:
    """Whether an element inside node passes test; past_hidden: not inside hidden ones."""
    stack = node.elements
    while stack:
        child = stack.pop()
        if past_hidden and hidden(child):
            continue
        if test(child):
            return True
        stack += child.elements
    return False


def holds_blocks(node: Node) -> bool:
    return _inside(node, lambda c: c.tag in BLOCKS or c.tag in STRUCTURES)


def target(link: Node) -> str:
    return re.sub(r"[\t\n\r]", "", link.attrs.get("href", "").strip())


def content_id(picture: Node) -> str | None:
    source = picture.attrs.get("src", "").strip()
    if source[:4].lower() != "cid:":
        return None
    source = source[4:]
    if "%" in source and not re.search(r"%(?![0-9A-Fa-f]{2})", source):
        try:
            source = unquote_to_bytes(source).decode()
        except UnicodeDecodeError:
            pass
    return source or None


def picture_is_emoji(picture: Node) -> bool:
    return is_emoji(picture.attrs.get("alt", "").strip())


def plain_address(value: str) -> str:
    value = value.lower()
    for scheme in ("https://", "http://", "mailto:"):
        value = value.removeprefix(scheme)
    return value.removesuffix("/")


def destination(href: str) -> str:
    """A link's target, in pointy brackets where Markdown would not read it as it stands."""
    depth, paired = 0, True
    for c in href:
        depth += (c == "(") - (c == ")")
        paired &= depth >= 0
    if paired and not depth and not href.startswith("<") and not re.search(r"[\x00-\x20\x7f]", href):
        return href
    return "<" + re.sub(r"([\\<>])", r"\\\1", href) + ">"


def escape_brackets(value: str) -> str:
    """Link text with its brackets escaped, but for those inside code."""
    return re.sub(r"(`+).*?\1|`+|[\[\]]", lambda m: "\\" + m[0] if m[0] in "[]" else m[0], value, flags=re.S)


def alias(alt: str) -> str | None:
    """A picture's alt text, or None where it says nothing about the picture or would break the embed."""
    value = collapse(alt).strip(" ")
    low = value.lower()
    useless = not value or low.endswith(PICTURES) or any(d in low for d in DESCRIPTIONS) or re.fullmatch(r"[0-9]+(x[0-9]+)?", value)
    return None if useless or re.search(r"[\[\]|]", value) else value


def pixels(value: str) -> int | None:
    found = css.points(value)
    return int(found / 0.75 + 0.5) if found and found > 0 else None


def spacing(node: Node) -> tuple[int, int]:
    """The gaps above and below a block: a blank line where a browser leaves room."""
    default = 12.0 if node.tag in ("ul", "ol") or (node.tag == "p" and not any(c.startswith("Mso") for c in node.classes)) else 0.0
    margin, padding = css.sides(node.style, "margin"), css.sides(node.style, "padding")
    return tuple(2 if (default if margin[s] is None else margin[s]) + (padding[s] or 0) >= SEEN else 1 for s in ("top", "bottom"))


def column_width(node: Node) -> float | None:
    """Percent of the screen that an MJML column's class gives it."""
    name = next((c for c in node.classes if c.startswith("mj-column-per-")), None) if node.tag else None
    return css.number(name.removeprefix("mj-column-per-").replace("-", ".")) if name else None


def holds_columns(node: Node) -> bool:
    widths = [column_width(c) for c in node.children]
    known = [w for w in widths if w is not None]
    return len(known) >= 2 and sum(known) <= 100.01 and all(w is not None or not shows_text(c) for w, c in zip(widths, node.children, strict=True))


def sets(marker: str, node: Node) -> bool | None:
    """Whether an element's style or tag turns an emphasis on or off; None where it says nothing."""
    if marker == BOLD:
        weight = node.style.get("font-weight")
        if weight in ("bold", "bolder", "normal", "lighter"):
            return weight.startswith("bold")
        if weight and (size := css.number(weight)) is not None:
            return size >= 600
        return True if node.tag in ("strong", "b") else None
    slant = node.style.get("font-style", "")
    if slant == "italic" or slant.startswith("oblique"):
        return True
    if slant == "normal":
        return False
    return True if node.tag in ("em", "i") else None


def title_of(line: str) -> str | None:
    """The text of a line that is a heading or bold as a whole."""
    m = re.fullmatch(r"#{1,6} (.+)", line) or re.fullmatch(r"\*\*((?:(?!\*\*).)+)\*\*", line)
    return m[1] if m else None


def table_row(cells) -> str:
    return "| " + " | ".join(cells) + " |"


def ruled(header: list[str], rows: list[list[str]]) -> list[str]:
    return [table_row(header), "|" + "---|" * len(header), *map(table_row, rows)]


class _Cell:
    def __init__(self, texts: list[str], header: bool, span: int):
        self.texts, self.header, self.span = texts, header, span
        self.words = any(map(has_words, texts))

    def markdown(self, bold: bool) -> str:
        escaped = [t.replace("|", "\\|") for t in self.texts]
        return "<br>".join(map(bold_line, escaped) if bold else escaped)


class _Writer:
    """Walks a tree and says what each node asks of the layout."""

    def __init__(self, body: Node, names: dict[str, str], style: str):
        self.names, self.callouts = names, style == "obsidian"
        self.forced: dict[Node, list[str]] = {}  # emphasis handed on from elements around
        self.shown: set[Node] = set()
        self.cards: set[Node] = set()
        self.buttons: set[Node] = set()
        self._mark_boxes(body)

    # boxes: what a reader sees set apart

    def _background(self, node: Node):
        value = node.style.get("background-color", node.style.get("background"))
        if value is not None:
            found = css.first_colour(value)
        else:
            attribute = node.attrs.get("bgcolor", "").lower()
            found = css.colour(attribute) or css.colour("#" + attribute)
        return found if found and found[3] > 0 else None

    def _ink(self, node: Node):
        if "color" in node.style:
            return css.colour(node.style["color"])
        attribute = node.attrs.get("color", "").lower() if node.tag == "font" else ""
        return (css.colour(attribute) or css.colour("#" + attribute)) if attribute else None

    def _first_ink(self, node: Node, ink):
        first = next(shown_texts(node), None)
        while first is not None and first is not node:  # the nearest colour at or above the first text
            first = first.parent
            if (own := self._ink(first)) is not None:
                return own
        return ink

    def _mark_boxes(self, body: Node) -> None:
        page, back, ink = body, self._background(body) or css.WHITE, self._ink(body) or css.BLACK
        while len(holders := [c for c in page.children if shows_text(c)]) == 1 and holders[0].tag:
            page = holders[0]
            own = self._background(page)
            back, ink = css.over(own, back) if own else back, self._ink(page) or ink
        last = None
        for last in shown_texts(body):
            pass
        footer = set(last.ancestors()) if last is not None else set()
        todo = [(page, back, ink, False)]
        while todo:
            parent, back, ink, inside = todo.pop()
            inside = inside or holds_columns(parent)
            for child in parent.elements:
                if hidden(child):
                    continue
                own = self._background(child)
                behind = css.over(own, back) if own else back
                painted = own is not None and behind != back
                box = child.tag in BLOCKS and (painted or css.framed(child.style)) and shows_text(child)
                if box and not inside and child not in footer:
                    self.cards.add(child)
                if box and painted and css.luminance(self._first_ink(child, ink)) > css.luminance(behind):
                    self.buttons.add(child)
                todo.append((child, behind, self._ink(child) or ink, inside or box))

    def box(self, node: Node) -> list[Event]:
        inner = self.emphasized(node)
        piece = compose(inner)
        trimmed = piece.trimmed
        filled = [x for x in trimmed if x]
        title = title_of(trimmed[0]) if node in self.cards and len(filled) >= 2 else None
        if title is not None and self.callouts:
            return lines([f"> [!quote] {title}", *(("> " + x).rstrip() if x else ">" for x in self._lead_row(trimmed[1:]))])
        if title is not None:
            return [gap(2), RULE, gap(2), *inner, gap(2), RULE, gap(2)]
        if node in self.buttons and len(filled) == 1 and not formatted(inner) and not _inside(node, lambda c: c.tag == "a" and target(c), True):
            return piece.events(lambda line: text(BOLD + line.replace(BOLD, "") + BOLD))
        return inner

    @staticmethod
    def _lead_row(body: list[str]) -> list[str]:
        """A table under an empty header with its first row as the header, where the body opens with one."""
        start = next((k for k, x in enumerate(body) if x), len(body))
        if len(body) > start + 2 and re.fullmatch(r"\|( +\|)+", body[start]) and re.fullmatch(r"\|(---\|)+", body[start + 1]):
            return [*body[:start], body[start + 2], body[start + 1], *body[start + 3 :]]
        return body

    # the walk

    def inside(self, node: Node) -> list[Event]:
        if holds_columns(node):
            return self.columns(node)
        return [e for child in node.children for e in self.node(child)]

    def node(self, node: Node) -> list[Event]:
        if not node.tag:
            return self.emphasized(node) if node in self.forced else self.words(node.text)
        if hidden(node):
            return []
        if self._is_spacer(node):
            return [gap(2)]
        body = self.box(node) if node in self.cards or node in self.buttons else self.emphasized(node)
        if node.tag in BLOCKS or node.tag in STRUCTURES or node.tag == "br":
            return body
        if node.style.get("display") in ("block", "flex", "grid", "list-item", "table"):
            above, below = spacing(node)
            return [gap(above), *body, gap(below)]
        margin, padding = css.sides(node.style, "margin"), css.sides(node.style, "padding")
        left, right = ((margin[s] or 0) + (padding[s] or 0) >= SEEN for s in ("left", "right"))
        return [space()] * left + body + [space()] * right

    @staticmethod
    def words(raw: str) -> list[Event]:
        value = collapse(raw)
        if value.strip(" "):
            return [text(value)]
        return [space("\u00a0" in raw)] if value else []

    @staticmethod
    def _is_spacer(node: Node) -> bool:
        if node.tag not in BLOCKS or not ("height" in node.attrs.get("style", "") or "height" in node.attrs):
            return False
        height = css.points(node.style.get("height", node.attrs.get("height", "")))
        return height is not None and height >= SEEN and not shows_text(node) and not _inside(node, lambda c: c.tag == "img")

    def tag(self, node: Node) -> list[Event]:
        tag = node.tag
        if not tag:
            return self.words(node.text)
        if tag in HEADINGS:
            flat = compose(self.inside(node)).flat
            return lines(["#" * int(tag[1]) + " " + flat]) if flat else []
        special = {"a": self.link, "img": self.image, "code": self.code, "pre": self.preformatted, "table": self.table, "tr": self.row, "th": self.header_cell}
        if tag in special:
            return special[tag](node)
        if tag == "br":
            return [BREAK]
        if tag == "hr":
            return lines(["---"])
        if tag in ("ul", "ol"):
            return self.list(node)
        if tag == "blockquote":
            quoted = compose(self.inside(node)).trimmed
            return lines(("> " + x) if x else ">" for x in quoted) if quoted else []
        return self.block(node) if tag in BLOCKS else self.inside(node)

    def block(self, node: Node) -> list[Event]:
        above, below = spacing(node)
        return [gap(above), *self.inside(node), gap(below)]

    # emphasis

    def own_emphasis(self, node: Node) -> list[str]:
        if node in self.forced:
            return self.forced[node]
        if not node.tag or node.tag == "th" or node.tag in HEADINGS:
            return []
        return [m for m in (ITALIC, BOLD) if sets(m, node)]

    def emphasis(self, node: Node) -> list[str]:
        """The markers an element sets that none around it sets already, italics first."""
        own = self.own_emphasis(node)
        around = {m for n in node.ancestors() for m in self.own_emphasis(n)} if own else ()
        return [m for m in own if m not in around]

    def _set_back(self, node: Node, marker: str, on: bool) -> bool:
        """Whether a node shows text outside of an emphasis that is on around it."""
        stack = [(node, on)]
        while stack:
            node, on = stack.pop()
            if not node.tag:
                if not on and _WIDTHLESS.sub("", node.text).strip():
                    return True
            elif not hidden(node):
                own = sets(marker, node)
                stack += [(c, on if own is None else own) for c in node.children]
        return False

    def laid_out(self, node: Node, markers: list[str], events) -> tuple[list[Event], list[str]]:
        """An element's events and the markers it can set: not around formatted lines, nor around text that sets them back."""
        inner = events(node)
        if not markers or formatted(inner):
            return inner, []
        passed = [m for m in markers if any(self._set_back(c, m, True) for c in node.children)]
        if not passed:
            return inner, markers
        # what is handed on, the parts of the element set for themselves
        self.forced[node] = [m for m in self.own_emphasis(node) if m not in passed]
        for child in node.children:
            if not child.tag:
                if _WIDTHLESS.sub("", child.text).strip():
                    self.forced[child] = [m for m in (ITALIC, BOLD) if m in passed]
            elif child.tag != "th" and child.tag not in HEADINGS:
                more = [m for m in passed if sets(m, child) is not False]
                if more:
                    own = self.own_emphasis(child)
                    self.forced[child] = [m for m in (ITALIC, BOLD) if m in own or m in more]
        return events(node), [m for m in markers if m not in passed]

    def emphasized(self, node: Node) -> list[Event]:
        inner, markers = self.laid_out(node, self.emphasis(node), self.tag)
        for marker in markers:
            inner = compose(inner).events(lambda line, m=marker: text(line, m if has_words(line) else None))
        return inner

    # inline elements

    def link(self, node: Node) -> list[Event]:
        holds_link = _inside(node, lambda c: c.tag == "a" and target(c), True)
        if holds_link or _inside(node, lambda c: c.tag == "img" and content_id(c) in self.names and not picture_is_emoji(c), True):
            return self.inside(node)
        piece, href = compose(self.inside(node)), target(node)
        flat = piece.flat
        if not href or not flat or plain_address(flat.strip("*")) == plain_address(href):
            return piece.events(text)
        return piece.single.events(lambda line: text(f"[{escape_brackets(line)}]({destination(href)})"))

    def image(self, node: Node) -> list[Event]:
        if picture_is_emoji(node):
            return self.words(node.attrs["alt"].strip())
        name = content_id(node)
        if name is None:
            return []
        self.shown.add(node)
        if name not in self.names:
            return []
        said = alias(node.attrs.get("alt", ""))
        return [text(f"![[{self.names[name]}|{said}]]" if said else f"![[{self.names[name]}]]")]

    def code(self, node: Node) -> list[Event]:
        piece = compose(self.inside(node), escape=False)
        form = "`` {} ``" if "`" in piece.flat else "`{}`"
        return piece.single.events(lambda line: text(form.format(line)))

    # blocks

    def list(self, node: Node) -> list[Event]:
        kind, short = node.style.get("list-style-type"), node.style.get("list-style", "").split()
        if kind == "none" if kind is not None else "none" in short and set(short) <= {"none", "inside", "outside"}:
            return self.block(node)
        out, number = [], 1
        for child in node.children:
            if child.tag and hidden(child):
                continue
            line = compose(self.inside(child)).flat if child.tag else collapse(child.text).strip(" ")
            if line and child.tag == "li":
                out.append((f"{number}. " if node.tag == "ol" else "- ") + line)
                number += 1
            elif line:
                out.append(line)
        return lines(out) if out else []

    def verbatim(self, node: Node) -> str:
        out, stack = [], [node]
        while stack:
            node = stack.pop()
            if not node.tag:
                out.append(node.text)
            elif node.tag == "br":
                out.append("\n")
            elif not hidden(node):
                stack += node.children[::-1]
        return "".join(out)

    def preformatted(self, node: Node) -> list[Event]:
        if holds_blocks(node):
            return self.block(node)
        code = self.verbatim(node).replace("\r\n", "\n").replace("\r", "\n").split("\n")
        filled = [k for k, x in enumerate(code) if x.strip()]
        if not filled:
            return []
        code = code[filled[0] : filled[-1] + 1]
        fence = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", self.verbatim(node))), default=0))
        return lines([fence, *code, fence])

    # tables

    def _rows(self, table: Node) -> list[Node]:
        """The table's own rows, in document order."""
        return [r for c in table.elements for r in ([c] if c.tag == "tr" else c.elements if c.tag in ("thead", "tbody", "tfoot") else []) if r.tag == "tr"]

    def _data(self, table: Node) -> list[list[_Cell]] | None:
        """The rows of cells of a table of data; None for a table that lays out."""
        if table.attrs.get("role", "").lower() == "presentation" or _inside(table, lambda c: c.tag == "table"):
            return None
        rows = []
        for row in self._rows(table):
            if hidden(row):
                continue
            cells = [self._cell(c, row.parent.tag == "thead") for c in row.elements if c.tag in ("td", "th") and not hidden(c)]
            if any(c.texts for c in cells):
                rows.append(cells)
        worded = [sum(c.words for c in r) for r in rows if not self._spans(r)]
        return rows if sum(n > 0 for n in worded) >= 2 and max(worded) >= 2 else None

    def _cell(self, node: Node, header: bool) -> _Cell:
        inner, markers = self.laid_out(node, self.emphasis(node), self.inside)
        texts = [x for x in compose(inner).trimmed if x]
        for m in markers:
            texts = [m + x + m if has_words(x) else x for x in texts]
        span = node.attrs.get("colspan", "").strip(" \t")
        return _Cell(texts, header or node.tag == "th", max(1, int(span)) if re.fullmatch(r"[+-]?[0-9]{1,9}", span) else 1)

    @staticmethod
    def _spans(row: list[_Cell]) -> bool:
        return len(row) == 1 and row[0].span > 1

    def table(self, node: Node) -> list[Event]:
        rows = self._data(node)
        if rows is None:
            return self.block(node)
        out = []
        caption = next((c for c in node.elements if c.tag == "caption"), None)
        if caption is not None:
            out += lines(compose(self.inside(caption)).trimmed)
        # a cell stands in the first column it spans
        slots = [{sum(c.span for c in r[:k]): c for k, c in enumerate(r)} for r in rows]
        columns = sorted({k for r, s in zip(rows, slots, strict=True) if not self._spans(r) for k, c in s.items() if c.texts})
        section: list[tuple] = []
        for row, slot in zip(rows, slots, strict=True):
            if self._spans(row):  # it stands above the rows below it, and the table is split there
                out += self._section(section, columns)
                section = []
                out += lines(map(bold_line, row[0].texts) if row[0].header else row[0].texts)
            else:
                section.append((row, slot))
        return out + self._section(section, columns)

    @staticmethod
    def _section(section, columns) -> list[Event]:
        if not section or not columns:
            return []
        header = [""] * len(columns)
        row, slot = section[0]
        if all(c.header for c in row):
            header = [slot[k].markdown(False) if k in slot else "" for k in columns]
            section = section[1:]
        return lines(ruled(header, [[s[k].markdown(s[k].header) if k in s else "" for k in columns] for _, s in section]))

    def row(self, node: Node) -> list[Event]:
        """A row of a layout table: its cells on one line, where all but the last are one line of text."""
        parts = [(c, self.node(c)) for c in node.children]
        cells = [(e, p) for c, e in parts if c.tag in ("td", "th") and (p := compose(e)).trimmed]
        above, below = spacing(node)
        share = len(cells) >= 2 and opens_with_text(cells[-1][0]) and all(len(p.trimmed) == 1 and not formatted(e) for e, p in cells[:-1])
        if not share:
            return [gap(above), *(e for _, part in parts for e in part), gap(below)]
        pieces: list[Piece] = [p for _, p in cells]
        rest = pieces[-1].trimmed[1:]
        line = " ".join(p.trimmed[0] for p in pieces)
        return [gap(max(above, *(p.gap_before for p in pieces))), text(line), *([("lines", rest)] if rest else []), gap(max(below, *(p.gap_after for p in pieces)))]

    def header_cell(self, node: Node) -> list[Event]:
        """A header cell outside of data: bold, unless its style says otherwise or it holds blocks."""
        if holds_blocks(node) or ("font-weight" in node.style and sets(BOLD, node) is False):
            return self.block(node)
        above, below = spacing(node)
        return [gap(above), *compose(self.inside(node)).events(lambda line: text(bold_line(line))), gap(below)]

    def columns(self, node: Node) -> list[Event]:
        """Columns side by side: a table where they pair up line by line, else one below the other."""
        parts = [(c, self.node(c)) for c in node.children]
        filled = [(e, rows) for c, e in parts if column_width(c) is not None and (rows := [x for x in compose(e).trimmed if x])]
        count = len(filled[0][1]) if filled else 0
        if len(filled) < 2 or count < 2 or any(formatted(e) or len(rows) != count for e, rows in filled):
            return [e for _, part in parts for e in part]
        grid = list(zip(*([x.replace("|", "\\|") for x in rows] for _, rows in filled), strict=True))
        titles = [title_of(rows[0]) for _, rows in filled]
        if None in titles:
            return lines(ruled([""] * len(filled), grid))
        return lines(ruled([t.replace("|", "\\|") for t in titles], grid[1:]))


def convert(html: str, names: dict[str, str] | None = None, style: str = "markdown") -> tuple[str, list[tuple[str, int | None, int | None]]]:
    """(Markdown, pictures) of a document.

    names: files of pictures by their Content-ID; such pictures are embedded, all others
    left out. style: markdown, or obsidian for cards as callouts. pictures: (Content-ID,
    width, height) of each picture of the mail that a reader sees, in order.
    """
    body = parse(html)
    deep = FRAMES * mark_shown(body) + AROUND  # the walk's calls are Python's own: they take no room on the stack of C
    if sys.getrecursionlimit() < deep:
        sys.setrecursionlimit(deep)
    writer = _Writer(body, names or {}, style)
    out = compose(writer.inside(body)).trimmed
    pictures = []
    for node in body.walk():
        if node in writer.shown:
            width, height = (pixels(node.style.get(s, node.attrs.get(s, ""))) for s in ("width", "height"))
            pictures.append((content_id(node), width, height))
    return "\n".join(out), pictures
