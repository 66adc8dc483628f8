"""Column functions: the scalar operators that Spark's own expressions can say."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets of the obsolete zone names.
ZONES = {"UT": "+0000", "GMT": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
PKCS7 = ("application/pkcs7-signature", "application/x-pkcs7-signature", "application/pkcs7-mime", "application/x-pkcs7-mime")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Headers


def header_block(raw) -> Column:
    """Everything before the first empty line, with LF line ends."""
    return F.substring_index(F.replace(_col(raw), F.lit("\r\n"), F.lit("\n")), "\n\n", 1)


def body_block(raw) -> Column:
    """Everything after the first empty line; empty where there is none."""
    return let(F.replace(_col(raw), F.lit("\r\n"), F.lit("\n")), lambda t: F.substring(t, F.length(F.substring_index(t, "\n\n", 1)) + 3, F.length(t)))


def headers(raw) -> Column:
    """Lower-cased names to unfolded values, the last of a name, of well-formed header blocks.

    Pieces of a folded header are joined by one space; an empty piece gets none.
    """
    unfolded = F.regexp_replace(F.regexp_replace(header_block(raw), r"[ \t]*\n[ \t]+", " "), r"(?m)^([^:\n]*:) +", "$1 ")
    rows = F.filter(F.split(unfolded, "\n"), lambda line: line.contains(":"))
    pairs = F.transform(rows, lambda line: let(F.instr(line, ":"), lambda at: F.struct(F.lower(F.substring(line, F.lit(1), at - 1)).alias("k"), F.trim(F.substring(line, at + 1, F.length(line))).alias("v"))))

    def last_of_each(p):
        # a pair stays if no later one has its name
        stays = F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]))
        return F.map_from_entries(stays)

    return let(pairs, last_of_each)


# Charsets and transfer encodings


def windows_1252(data) -> Column:
    """Bytes as windows-1252, the five unassigned ones as the control characters they are."""
    blocks = {chr(b): t for b in range(0x80, 0xA0) if (t := bytes([b]).decode("cp1252", "ignore"))}
    return F.translate(F.decode(_col(data), "ISO-8859-1"), "".join(blocks), "".join(blocks.values()))


def base64_text(text) -> Column:
    """Base64 as UTF-8 text; input that is not padded base64, or no UTF-8, as it is."""
    bare = F.regexp_replace(_col(text), r"\s", "")
    data = F.when(F.length(bare) % 4 == 0, F.try_to_binary(bare, F.lit("base64")))
    return F.coalesce(F.try_validate_utf8(data.cast("string")), _col(text))


# Addresses and dates


def mailbox(name, address) -> Column:
    """"Name <address>", quoted where the name needs it; the bare address where the name adds nothing."""

    def shown(both):
        name, address = both["name"], both["address"]
        escaped = F.regexp_replace(name, r'([\\"])', r"\\$1")
        quoted = F.when(name.rlike("[,<>]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(name)
        return F.when(F.coalesce(name, F.lit("")).isin("") | (F.lower(name) == F.lower(address)), address).otherwise(F.concat(quoted, F.lit(" <"), address, F.lit(">")))

    return let(F.struct(_col(name).alias("name"), _col(address).alias("address")), shown)


def normal_date(value) -> Column:
    """A date header without comments, blanks collapsed, an obsolete zone name as its offset."""
    offsets = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])

    def named(text):
        offset = F.try_element_at(offsets, F.upper(F.substring_index(text, " ", -1)))
        return F.when(offset.isNotNull() & text.contains(" "), F.concat(F.regexp_replace(text, r"[A-Za-z]{1,3}$", ""), offset)).otherwise(text)

    bare = F.when(_col(value).contains("("), F.regexp_replace(_col(value), r"\([^)]*\)", " ")).otherwise(_col(value))
    return let(F.trim(F.regexp_replace(bare, r"\s+", " ")), named)


def instant(value) -> Column:
    """The instant of a date header; null for anything but the four known shapes, never a guess."""

    def read(bare):
        shaped = bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}(:\d{2})? [+-]\d{4}$")
        # the month as it is spelled in capitals and lower case, the day in two digits
        parts = F.concat(F.lpad(F.substring_index(bare, " ", 1), 2, "0"), F.lit(" "), F.initcap(F.substring(bare, F.instr(bare, " ") + 1, F.length(bare))))
        return F.when(shaped, let(parts, lambda p: F.coalesce(F.try_to_timestamp(p, F.lit("dd MMM yyyy H:mm:ss Z")), F.try_to_timestamp(p, F.lit("dd MMM yyyy H:mm Z")))))

    return let(F.regexp_replace(normal_date(value), r"(?i)^(mon|tue|wed|thu|fri|sat|sun), ", ""), read)


def offset_minutes(value) -> Column:
    """The sender's offset from UTC in minutes, the first [+-]dddd of a date header."""

    def read(shown):
        size = F.substring(shown, 2, 2).try_cast("int") * 60 + F.substring(shown, 4, 2).try_cast("int")
        return F.when(shown.startswith("-"), -size).otherwise(size)

    return let(F.regexp_extract(normal_date(value), r"[+-]\d{4}", 0), read)


def local_time(moment, zone: str) -> Column:
    """yyyy-MM-dd'T'HH:mm in the reader's zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), _col(moment).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm")


# Frontmatter


_LINE_ENDS = {"\n": "\\n", "\r": "\\r", "\u0085": "\\N", "\u2028": "\\L", "\u2029": "\\P"}
_SPECIAL = r"[\x00-\x08\x0A-\x1F\x7F-\x9F\x{2028}\x{2029}]"


def yaml_quoted(value) -> Column:
    """A double-quoted YAML scalar. Only the control characters that occur are looked for."""

    def spelled(c):
        named = F.try_element_at(F.create_map(*[F.lit(x) for pair in _LINE_ENDS.items() for x in pair]), c)
        return F.coalesce(named, F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(c)), 2, "0")))

    def escaped(text):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_SPECIAL})"), F.lit(1)))
        return F.when(text.rlike(_SPECIAL), F.aggregate(found, text, lambda t, c: F.replace(t, c, spelled(c)))).otherwise(text)

    quoted = let(F.regexp_replace(_col(value), r'(["\\])', r"\\$1"), escaped)
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def field(name: str, value, quoted: bool = True) -> Column:
    """"name: value", or "name:" for null and empty values."""

    def shown(v):
        return F.when(F.coalesce(v, F.lit("")) == "", F.lit(f"{name}:")).otherwise(F.concat(F.lit(f"{name}: "), yaml_quoted(v) if quoted else v))

    return let(_col(value), shown)


def list_field(name: str, values) -> Column:
    """A flow list of quoted values, or "name:" for none."""
    values = _col(values)
    items = F.array_join(F.transform(values, yaml_quoted), ", ")
    return F.when(F.coalesce(F.size(values), F.lit(0)) < 1, F.lit(f"{name}:")).otherwise(F.concat(F.lit(f"{name}: ["), items, F.lit("]")))


def wikilink(target, shown=None) -> Column:
    return F.concat(F.lit("[["), target, *([] if shown is None else [F.lit("|"), shown]), F.lit("]]"))


def link_field(attachments) -> Column:
    """The attachments as a block list of wikilinks, or "attachments:" for none."""
    items = F.transform(_col(attachments), lambda a: F.concat(F.lit("  - "), yaml_quoted(wikilink(a["name"]))))
    return F.concat_ws("\n", F.lit("attachments:"), items)


def image_grid(names) -> Column:
    """Embeds two to a row of a table without a header; an odd last cell is empty."""
    names = _col(names)
    rows = F.transform(
        F.sequence(F.lit(0), F.size(names) - 1, F.lit(2)),
        lambda i: F.concat(F.lit("| !"), wikilink(F.get(names, i)), F.lit(" | "), F.coalesce(F.concat(F.lit("!"), wikilink(F.get(names, i + 1))), F.lit("")), F.lit(" |")),
    )
    return F.concat_ws("\n", F.lit("|  |  |"), F.lit("|---|---|"), rows)


def attachment_block(attachments) -> Column:
    """Images in a grid, then documents linked, all apart by blank lines; attachments that the body embeds are not repeated."""
    loose = F.filter(_col(attachments), lambda a: ~a["is_embedded"])
    images = F.transform(F.filter(loose, lambda a: a["media_type"].startswith("image/")), lambda a: a["name"])
    others = F.filter(loose, lambda a: ~a["media_type"].startswith("image/"))
    links = F.transform(others, lambda a: F.when(a["name"] == a["source_name"], wikilink(a["name"])).otherwise(wikilink(a["name"], a["source_name"])))
    grid = F.when(F.size(images) > 0, F.concat(F.lit("\n\n"), image_grid(images))).otherwise(F.lit(""))
    return F.concat(grid, F.array_join(F.transform(links, lambda x: F.concat(F.lit("\n\n"), x)), ""))


# Reports


def invisible_summary(report) -> Column:
    """One line with every class of invisible characters that occurred, removed ones first; empty for none."""
    r = _col(report)

    def group(word, classes):
        shown = F.concat_ws(", ", *[F.when(r[c] > 0, F.concat(F.lit(f"{label} "), r[c].cast("string"))) for c, label in classes])
        total = sum((r[c] for c, _ in classes[1:]), r[classes[0][0]])
        return F.when(total > 0, F.concat(F.lit(f"{word} "), total.cast("string"), F.lit(" ("), shown, F.lit(")")))

    removed = (("zero_width_chains", "zero-width chains"), ("tag_characters", "tag characters"), ("zero_width_spaces", "ZWSP"), ("byte_order_marks", "BOM"))
    kept = (("joiners", "ZWJ"), ("direction_marks", "LRM/RLM"), ("bidi_controls", "bidi controls"))
    found = F.concat_ws(", ", group("removed", removed), group("kept", kept))
    return F.when(found == "", F.lit("")).otherwise(F.concat(F.lit("invisible characters: "), found))


def omission_summary(omissions) -> Column:
    """The pictures left out, with their sizes where known; empty for none."""
    names = F.transform(
        _col(omissions), lambda o: F.when(o["width"].isNull() | o["height"].isNull(), o["name"]).otherwise(F.concat(o["name"], F.lit(" "), o["width"].cast("string"), F.lit("×"), o["height"].cast("string")))
    )
    return F.when(F.size(names) > 0, F.concat(F.lit("inline images left out: "), F.array_join(names, ", "))).otherwise(F.lit(""))


def display_size(width, height, natural_width, natural_height) -> Column:
    """struct(width, height): the given size, an open side in proportion, else the natural one; null where none is known."""
    w, h, nw, nh = map(_col, (width, height, natural_width, natural_height))
    known = (nw > 0) & (nh > 0)
    size = lambda a, b: F.struct(a.cast("int").alias("width"), b.cast("int").alias("height"))
    return (
        F.when(w.isNotNull() & h.isNotNull(), size(w, h))
        .when(known & w.isNotNull(), size(w, F.round(w * nh / nw)))
        .when(known & h.isNotNull(), size(F.round(h * nw / nh), h))
        .when(known, size(nw, nh))
    )


# Names of files

_NAME = r"(?s)^(.+)\.([^.]+)$"


def extension(name) -> Column:
    """What follows the last dot, unless the dot is first or last."""
    return F.regexp_extract(_col(name), _NAME, 2)


def stem(name) -> Column:
    return F.when(_col(name).rlike(_NAME), F.regexp_extract(_col(name), _NAME, 1)).otherwise(_col(name))


def safe_name(filename, media_type) -> Column:
    """The last component of a path; "unnamed" and the media type's extension where it has none."""
    last = F.try_element_at(F.filter(F.split(F.coalesce(_col(filename), F.lit("")), "/"), lambda x: x != ""), F.lit(-1))
    types = {t: e[1:] for t in sorted(set(mimetypes.types_map.values())) if (e := mimetypes.guess_extension(t))} | {"image/jpeg": "jpeg"}
    types.pop("application/octet-stream", None)  # bytes of no known kind
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), _col(media_type))
    return F.when(last.isNull() | last.isin(".", ".."), F.concat(F.lit("unnamed"), F.coalesce(F.concat(F.lit("."), known), F.lit("")))).otherwise(last)


def linkable(name) -> Column:
    """A name that a wikilink can hold."""
    plain = F.translate(_col(name), "#|", "--")
    return F.when(plain.contains("[[") | plain.contains("]]") | plain.endswith("]"), F.translate(plain, "[]", "--")).otherwise(plain)


class NamePattern:
    """A naming pattern: literals and {name}, {ext}, {date[:format]}, {time[:format]}; an open brace is a literal."""

    DEFAULTS = {"date": "yyyy-MM-dd", "time": "HH-mm"}

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.parts = []  # (kind, value): literal, name, ext, moment or unknown
        for literal, token in re.findall(r"([^{]+|\{(?![^}]*\}))|\{([^}]*)\}", pattern, re.S):
            kind, _, form = token.partition(":")
            if literal:
                self.parts.append(("literal", literal))
            elif kind in self.DEFAULTS:
                self.parts.append(("moment", form or self.DEFAULTS[kind]))
            elif kind in ("name", "ext"):
                self.parts.append((kind, None))
            else:
                self.parts.append(("unknown", token))

    @property
    def unknown(self) -> list[str]:
        return [v for k, v in self.parts if k == "unknown"]

    @property
    def needs_date(self) -> bool:
        return any(k == "moment" for k, _ in self.parts)

    def apply(self, filename, moment, zone: str = "UTC") -> Column:
        """The name that the pattern gives a file; its own where the pattern needs a date and there is none."""
        filename, moment = _col(filename), _col(moment)
        dotted = F.when(extension(filename) != "", F.concat(F.lit("."), extension(filename))).otherwise(F.lit(""))
        local = F.convert_timezone(F.current_timezone(), F.lit(zone), moment.cast("timestamp_ntz"))
        made = {"literal": F.lit, "name": lambda _: stem(filename), "ext": lambda _: dotted, "moment": lambda f: F.date_format(local, f), "unknown": lambda t: F.lit("{" + t + "}")}
        parts = [made[k](v) for k, v in self.parts] + ([] if any(k == "ext" for k, _ in self.parts) else [dotted])
        found = F.trim(F.replace(F.concat(*parts), F.lit("/"), F.lit("-")))
        return F.when(moment.isNull(), filename).otherwise(found) if self.needs_date else found


def unique_names(names, taken=None) -> Column:
    """The names in order, each made unlike all before it and all taken by -1, -2, ... before its extension.

    The first free number is the least that no name in use has; a mail's files are few,
    and names that repeat cost one look at all before them.
    """
    names = _col(names)
    used = F.array().cast("array<string>") if taken is None else _col(taken)

    def numbered(all_, name):
        kind = extension(name)
        ends = F.struct(F.concat(stem(name), F.lit("-")).alias("head"), F.when(kind != "", F.concat(F.lit("."), kind)).otherwise(F.lit("")).alias("tail"))

        def free(e):
            size = F.length(e["head"]) + F.length(e["tail"])
            alike = F.filter(all_, lambda x: x.startswith(e["head"]) & x.endswith(e["tail"]) & (F.length(x) > size))
            middles = F.transform(alike, lambda x: F.substring(x, F.length(e["head"]) + 1, F.length(x) - size))
            numbers = F.transform(middles, lambda m: F.when(m.try_cast("int").cast("string") == m, m.try_cast("int")))
            least = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(numbers) + 1), numbers))
            return F.concat(e["head"], least.cast("string"), e["tail"])

        return let(ends, free)

    def pick(done, name):
        all_ = F.concat(used, done)
        return F.concat(done, F.array(let(all_, lambda a: F.when(F.array_contains(a, name), numbered(a, name)).otherwise(name))))

    return F.aggregate(names, F.array().cast("array<string>"), pick)


# Predicates of parts


def is_body(media_type, disposition) -> Column:
    kind = _col(media_type)
    return (kind.isin("text/plain", "text/html") | kind.startswith("multipart/")) & (_col(disposition) != "attachment")


def is_user_attachment(part, between) -> Column:
    """Whether a leaf is a file that a user attached; between: it stands between texts of a mixed container."""
    p, kind = _col(part), _col(part)["media_type"]
    inline = (p["disposition"] == "inline") & p["filename"].isNotNull() & ~kind.rlike("^(text|multipart|image)/")
    loose = ~p["has_content_id"] & ((kind.startswith("image/") & between) | inline)
    return ~kind.isin(*PKCS7) & ((p["disposition"] == "attachment") | loose)


# Lines


def strip_line_ends(text) -> Column:
    return F.regexp_replace(_col(text), r"(?m)[ \t]+$", "")


def collapse_blank_lines(text) -> Column:
    return F.regexp_replace(_col(text), "\n{3,}", "\n\n")
