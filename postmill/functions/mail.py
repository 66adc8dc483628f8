"""Headers, parameters, charsets and transfer encodings of one mail, as plain functions."""

from __future__ import annotations

import base64
import binascii
import codecs
import re
import unicodedata

BLANKS = " \t"
#: What is trimmed off header values: blanks, all space separators, and the zero-width space.
TRIMMED = BLANKS + "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs") + "\u200b"

#: Where windows-1252 differs from Latin-1; its five unassigned bytes stay as they are.
_C1 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
#: Codecs that mail programs read as windows-1252.
_WESTERN = {"iso8859-1", "ascii", "cp1252"}

_SEGMENT = re.compile(r'(?:=[ \t]*"(?:\\.|[^"\\])*(?:"|\Z)|[^;])*', re.S)
_ENCODED_WORD = re.compile(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=")
# escapes in a row are decoded at once
_ESCAPES = re.compile(rb"(?:=[0-9A-Fa-f]{2})+")
_ESCAPES_OR_SOFT_END = re.compile(rb"=(?:\n|\Z)|((?:=[0-9A-Fa-f]{2})+)")
_PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")
_PIECE = re.compile(r'(?:"(?:\\.|[^"\\])*(?:"|\Z)|[^",])+', re.S)
_PHRASE = re.compile(r'"((?:\\.|[^"\\])*)"|([ \t]+)|([^" \t]+)', re.S)
_NAMED = re.compile(r"(.*?)\s*<([^<>\s]*)>")
_BARE = re.compile(r'[^\s<>"(),;:]+@[^\s<>"(),;:]+')


# Headers


def split_message(raw: str) -> tuple[str, str]:
    """Header block and body, split at the first empty line; all is header where there is none."""
    head, _, body = raw.replace("\r\n", "\n").partition("\n\n")
    return head, body


def header_map(block: str, decode=lambda value: value) -> dict[str, str]:
    """Lower-cased names to unfolded values; of repeated headers the last stays."""
    found: dict[str, list[str]] = {}
    name = None
    for line in block.split("\n"):
        if line.startswith((" ", "\t")):
            if name is not None:
                found[name].append(line.strip(TRIMMED))
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.lower()
            found[name] = [value.strip(TRIMMED)]
    return {k: decode(" ".join(filter(None, v))) for k, v in found.items()}


def _unquoted(value: str) -> str:
    if len(value) >= 2 and value[0] == value[-1] == '"':
        return re.sub(r'\\(["\\])', r"\1", value[1:-1])
    return value


def parameters(raw: str) -> tuple[str, dict[str, str]]:
    """Value and parameters of a header such as Content-Type, with RFC 2231 sections joined."""
    segments, at = [], 0
    while at <= len(raw):
        m = _SEGMENT.match(raw, at)
        segments.append(m[0])
        at = m.end() + 1
    plain: dict[str, str] = {}
    sections: dict[str, list] = {}
    for segment in segments[1:]:
        key, equals, value = segment.partition("=")
        if not equals:
            continue
        key, value = key.strip(TRIMMED).lower(), _unquoted(value.strip(TRIMMED))
        name, star, suffix = key.partition("*")
        number = suffix.removesuffix("*") if suffix else "0"
        if star and re.fullmatch(r"[+-]?[0-9]+", number):
            sections.setdefault(name, []).append((int(number), not suffix or suffix.endswith("*"), value))
        else:
            plain[key] = value
    for name, rows in sections.items():
        joined = _joined(sorted(rows, key=lambda r: r[0]))
        if joined is not None:
            plain[name] = joined
    return segments[0].strip(TRIMMED).lower(), plain


def _joined(rows: list) -> str | None:
    if [r[0] for r in rows] != list(range(len(rows))):
        return None
    charset, data = None, b""
    for number, extended, value in rows:
        if extended and number == 0 and value.count("'") >= 2:
            charset, _, value = value.split("'", 2)
        data += _PERCENT.sub(lambda m: bytes([int(m[1], 16)]), value.encode()) if extended else value.encode()
    return decode_text(data, charset)


def content_type(headers: dict) -> tuple[str, dict[str, str]]:
    raw = headers.get("content-type")
    return parameters(raw) if raw else ("text/plain", {})


def disposition(headers: dict) -> tuple[str, str | None]:
    kind, found = parameters(headers.get("content-disposition") or "")
    name = found.get("filename")
    return kind, None if name is None else decode_words(name)


def content_id(headers: dict) -> str | None:
    """The Content-ID without its angle brackets; None where it is missing or empty."""
    raw = (headers.get("content-id") or "").strip(TRIMMED)
    if raw.startswith("<") and raw.endswith(">"):
        raw = raw[1:-1]
    return raw or None


# Charsets and transfer encodings


def codec(charset: str | None) -> str:
    """The codec's name; UTF-8 for absent and unknown labels."""
    try:
        found = codecs.lookup((charset or "utf-8").strip())
        return found.name if found._is_text_encoding else "utf-8"
    except (LookupError, ValueError):
        return "utf-8"


def decode_text(data: bytes, charset: str | None) -> str | None:
    """Text as a mail program reads it; None where the bytes are not valid in the charset."""
    name = codec(charset)
    if name in _WESTERN:
        return data.decode("latin-1").translate(_C1)
    try:
        return data.decode(name)
    except (UnicodeDecodeError, UnicodeError):
        return None


def quoted_printable(data: bytes, header: bool = False) -> bytes:
    """Decoded bytes; an escape that is none stays. In headers "_" is a space and lines have no soft ends."""
    if header:
        return _ESCAPES.sub(lambda m: binascii.unhexlify(m[0].replace(b"=", b"")), data.replace(b"_", b" "))
    return _ESCAPES_OR_SOFT_END.sub(lambda m: binascii.unhexlify(m[1].replace(b"=", b"")) if m[1] else b"", data)


def base64_bytes(text: str) -> bytes | None:
    """Decoded bytes of text without its white space; None for anything but padded base64."""
    try:
        return base64.b64decode("".join(text.split()), validate=True)
    except (binascii.Error, ValueError):
        return None


def decode_words(value: str) -> str:
    """RFC 2047 encoded words decoded; white space between two of them goes."""
    if "=?" not in value:
        return value
    out, end, after_word = [], 0, False
    for m in _ENCODED_WORD.finditer(value):
        gap = value[end : m.start()]
        if not (after_word and not gap.strip()):
            out.append(gap)
        if m[2] in "Bb":
            data = base64_bytes(m[3])
            text = None if data is None else decode_text(data, m[1])
        else:
            text = decode_text(quoted_printable(m[3].encode(), header=True), m[1])
        out.append(m[3] if text is None else text)
        end, after_word = m.end(), True
    return "".join(out) + value[end:]


# Addresses


def address_list(raw: str) -> str:
    """Mailboxes as "Name <address>" or bare addresses; a header that is no such list is only decoded."""
    pieces = [x for m in _PIECE.finditer(raw) if (x := m[0].strip(BLANKS))]
    boxes = [_mailbox(x) for x in pieces]
    return decode_words(raw) if not boxes or None in boxes else ", ".join(boxes)


def _mailbox(piece: str) -> str | None:
    if m := _NAMED.fullmatch(piece):
        return format_mailbox(display_name(m[1]), m[2]) if "@" in m[2] else None
    return piece if _BARE.fullmatch(piece) else None


def display_name(raw: str) -> str:
    """The name decoded, without the quotes of its words and without single quotes around it."""
    name = decode_words(raw).strip(BLANKS)
    if '"' in name:
        tokens = list(_PHRASE.finditer(name))
        if sum(len(m[0]) for m in tokens) == len(name):  # every quote closes
            out, gap = "", False
            for m in tokens:
                if m[2]:
                    gap = True
                    continue
                out += (" " if gap and out else "") + (m[3] or re.sub(r"\\(.)", r"\1", m[1] or "", flags=re.S))
                gap = False
            name = out
    return name[1:-1] if len(name) >= 2 and name[0] == name[-1] == "'" else name


def format_mailbox(name: str, address: str) -> str:
    if not name or name.lower() == address.lower():
        return address
    if set(name) & set(",<>"):
        name = '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return f"{name} <{address}>"
