"""One mail as parts, a body and pictures: the parser behind the operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from postmill.functions import body as cleaner
from postmill.functions import invisible, mail
from postmill.functions.html import convert

#: Parts that are S/MIME machinery.
SMIME = frozenset(("application/pkcs7-signature", "application/x-pkcs7-signature", "application/pkcs7-mime", "application/x-pkcs7-mime"))


@dataclass
class Part:
    """A node of the MIME tree; path counts from 0 at each level, and the root has an empty one."""

    path: tuple[int, ...]
    headers: dict[str, str]
    raw: str
    container: str = ""
    children: list[Part] = field(default_factory=list)

    def __post_init__(self):
        self.media_type, self.params = mail.content_type(self.headers)
        self.disposition, name = mail.disposition(self.headers)
        other = self.params.get("name")
        self.filename = name if name is not None or other is None else mail.decode_words(other)
        self.content_id = mail.content_id(self.headers)
        self.encoding = self.headers.get("content-transfer-encoding", "").strip(mail.TRIMMED).lower()

    @property
    def is_container(self) -> bool:
        return self.media_type.startswith("multipart/")

    @property
    def is_body(self) -> bool:
        """Text or a container that is read as the mail, not a file that came with it."""
        return (self.media_type in ("text/plain", "text/html") or self.is_container) and self.disposition != "attachment"

    def all(self) -> Iterator[Part]:
        """The part and all inside it, in document order."""
        stack = [self]
        while stack:
            part = stack.pop()
            yield part
            stack += part.children[::-1]

    def leaves(self) -> Iterator[Part]:
        return (p for p in self.all() if p is not self and not p.is_container)


def split_parts(raw: str, boundary: str) -> list[str]:
    """The parts between delimiter lines; what the last delimiter does not close is lost."""
    parts, begin, at, mark = [], None, 0, f"--{boundary}"
    while (at := raw.find(mark, at)) >= 0:
        start = raw.rfind("\n", 0, at) + 1
        end = raw.find("\n", at)
        end = len(raw) if end < 0 else end
        line = raw[start:end].strip(" \t\r")
        if line == mark or line == mark + "--":
            if begin is not None:
                parts.append(raw[begin : max(begin, start - 1)])
            begin = end + 1
            if line != mark:
                break
        at = end
    return parts


class Message:
    """A parsed mail. Bytes that are not UTF-8 are read one character each, in the charset that charset names."""

    def __init__(self, content: bytes | None):
        content = content or b""
        self.charset: str | None = None
        self.error: str | None = None
        try:
            raw = content.decode()
        except UnicodeDecodeError:
            raw = content.decode("latin-1")
            self.charset = "latin-1"
        self.root = self._tree(raw)
        if self.charset:
            declared = next((c for p in self.root.all() if (c := p.params.get("charset")) and mail.codec(c) not in ("utf-8", "ascii")), None)
            if declared is None:
                self.error = "not valid UTF-8 text, nor in a charset it declares"
            elif mail.codec(declared) != mail.codec("latin-1"):
                self.charset = declared
                self.root = self._tree(raw)

    def _headers(self, block: str) -> dict[str, str]:
        return mail.header_map(block, lambda v: self.raw_text(v, None))

    def _tree(self, raw: str) -> Part:
        """The MIME tree, however deep. What a container was split from is let go, but for the root's."""
        head, rest = mail.split_message(raw)
        root = Part((), self._headers(head), rest)
        open_ = [root]
        while open_:
            part = open_.pop()
            boundary = part.params.get("boundary")
            if not part.is_container or boundary is None:
                continue
            for k, x in enumerate(split_parts(part.raw, boundary)):
                head, rest = mail.split_message(x)
                part.children.append(Part((*part.path, k), self._headers(head), rest, part.media_type))
            if part.children and part is not root:
                part.raw = ""
            open_ += part.children
        return root

    # bytes and texts of parts

    def raw_text(self, raw: str, declared: str | None) -> str:
        """8-bit text of a mail that is no UTF-8: as UTF-8, else as declared, else in the mail's charset."""
        if not self.charset or raw.isascii():
            return raw
        data = raw.encode("latin-1", "replace")
        for charset in ("utf-8", *([declared] if declared else []), self.charset):
            found = mail.decode_text(data, charset)
            if found is not None:
                return found
        return raw

    def body_bytes(self, part: Part) -> bytes:
        return part.raw.encode("latin-1", "replace") if self.charset else part.raw.encode()

    def decoded_bytes(self, part: Part) -> bytes:
        """A part's content for a file, never by way of text; what cannot be decoded stays."""
        if part.encoding == "base64":
            found = mail.base64_bytes(part.raw)
            return self.body_bytes(part) if found is None else found
        data = self.body_bytes(part)
        return mail.quoted_printable(data) if part.encoding == "quoted-printable" else data

    def leaf_text(self, part: Part) -> str:
        charset = part.params.get("charset")
        if part.encoding in ("quoted-printable", "base64"):
            data = mail.quoted_printable(self.body_bytes(part)) if part.encoding != "base64" else mail.base64_bytes(part.raw)
            found = None if data is None else mail.decode_text(data, charset)
            return part.raw if found is None else found
        return self.raw_text(part.raw, charset)

    # the body a reader sees

    def body(self, names: dict[str, str] | None = None, style: str = "markdown") -> tuple[str, list[tuple]]:
        """(text or Markdown, pictures shown) of the mail, before any cleaning."""
        pictures: list[tuple] = []

        def leaf(part: Part) -> str:
            found = self.leaf_text(part)
            if part.media_type == "text/html":
                found, more = convert(found, names, style)
                pictures.extend(more)
            return found

        # a container waits for its parts, in order, or from the last on for the last form that shows something
        found, waiting, part = None, [], self.root
        while True:
            if part is not None:
                if part.is_container and "boundary" in part.params:
                    forms = [c for c in part.children if c.is_body]
                    last = part.media_type == "multipart/alternative"
                    waiting.append((forms if last else forms[::-1], last, []))
                else:
                    found = None if part.is_container else leaf(part)
                    if not waiting:
                        break
                    if found and found.strip():
                        waiting[-1][2].append(found)
                part = None
            forms, last, texts = waiting[-1]
            if forms and not (last and texts):
                part = forms.pop()
                continue
            waiting.pop()
            found = (texts[0] if last else "\n\n".join(texts)) if texts else None
            if not waiting:
                break
            if found and found.strip():
                waiting[-1][2].append(found)
        if found is None:  # no text: nothing, or what cannot be split as it is
            found = "" if self.root.children else self.root.raw
        return found, pictures

    def attachments(self) -> list[Part]:
        """The parts that a user attached, in document order."""
        found, stack = [], [(self.root, False)] if self.root.is_container else []
        while stack:
            part, between = stack.pop()
            if part.is_container:
                bodies = [k for k, c in enumerate(part.children) if c.is_body]
                mixed = part.media_type == "multipart/mixed" and bool(bodies)
                stack += [(c, mixed and bodies[0] < k < bodies[-1]) for k, c in reversed(list(enumerate(part.children)))]
            elif part.media_type not in SMIME and self._attached(part, between):
                found.append(part)
        return found

    @staticmethod
    def _attached(part: Part, between: bool) -> bool:
        if part.disposition == "attachment":
            return True
        if "content-id" in part.headers:
            return False
        if part.media_type.startswith("image/"):
            return between
        return part.disposition == "inline" and part.filename is not None and not part.media_type.startswith("text/")

    def pictures(self, shown: list[tuple]) -> list[tuple[tuple, Part]]:
        """The pictures shown that a part of the mail holds and that are no attachments, each once."""
        if not shown:
            return []
        attached = {p.content_id for p in self.attachments()}
        parts: dict[str, Part] = {}
        for part in self.root.leaves() if self.root.is_container else ():
            if part.content_id:
                parts.setdefault(part.content_id, part)
        first = {}
        for picture in shown:
            if picture[0] in parts and picture[0] not in attached:
                first.setdefault(picture[0], picture)
        return [(picture, parts[name]) for name, picture in first.items()]

    # the fields of a note

    def fields(self, names: dict[str, str] | None = None, style: str = "markdown") -> dict:
        """Addresses, subject, raw date, body, pictures and the report of invisible characters."""
        report = dict.fromkeys(invisible.COUNTERS, 0)

        def visible(value: str) -> str:
            value, found = invisible.clean(value)
            for k, n in found.items():
                report[k] += n
            return value

        headers, out = self.root.headers, {}
        body, pictures = self.body(names, style)
        for name, read in (("from", mail.address_list), ("to", mail.address_list), ("cc", mail.address_list), ("subject", mail.decode_words)):
            out[name] = visible(read(headers[name])) if name in headers else None
        out["body"] = cleaner.clean(visible(body))
        return out | {"date": headers.get("date"), "message_id": headers.get("message-id"), "pictures": pictures, "invisible": report}
