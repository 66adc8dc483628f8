"""Mails as messages and parts: one crossing into Python for the parsers, expressions for the rest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import columns as C
from postmill.functions.images import natural_size
from postmill.functions.invisible import COUNTERS
from postmill.functions.message import SMIME, Message

PART = (
    "struct<path: array<int>, container: string, media_type: string, params: map<string, string>, disposition: string, filename: string,"
    " content_id: string, has_content_id: boolean, encoding: string, is_body: boolean, is_smime: boolean, headers: map<string, string>, content: binary>"
)
PICTURE = "struct<content_id: string, width: int, height: int>"
FILE = "struct<name: string, media_type: string, content_id: string, kind: string, width: int, height: int, content: binary>"
_TEXTS = ("from", "to", "cc", "subject", "date", "message_id", "body")
_PARSED = (
    ", ".join(f"`{t}` string" for t in _TEXTS)
    + f", headers map<string, string>, pictures array<{PICTURE}>, invisible struct<{', '.join(f'{c}: bigint' for c in COUNTERS)}>, files array<{FILE}>, charset string, error string"
)


def _arrow(spark_type: str, spark) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(spark_type))


def _kept(frame: DataFrame, drop) -> list[str]:
    return [c for c in frame.columns if c not in drop]


def _map_mails(frame: DataFrame, content: str, added: str, read, more: str | None = None) -> DataFrame:
    """frame without content, with the columns added that read(bytes, more) gives as a dict for each row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    rest = _kept(frame, (content, *new.names))
    extra = F.col(more) if more else F.lit(None).cast("string")
    packed = frame.select(F.col(content).alias("c"), extra.alias("m"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))
    schema = packed.select("r").schema
    for f in new.fields:
        schema = schema.add(f)
    types = to_arrow_schema(new)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # mails may be large: few at a time
                part = batch.slice(start, 256)
                rows = [read(c, m) for c, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                made = [pa.array([r[f.name] for r in rows], f.type) for f in types]
                yield pa.RecordBatch.from_arrays([part.column(2), *made], names=["r", *new.names])

    done = packed.mapInArrow(run, schema)
    return done.select(*[F.col(f"r.`{c}`").alias(c) for c in rest], *[F.col(f"`{n}`") for n in new.names])


def parse(frame: DataFrame, content: str = "content", style: str = "markdown", names: str | None = None, files: bool = False) -> DataFrame:
    """Messages of mails in content: addresses, subject, body, headers, pictures, attachments and reports.

    created and sender_offset_min come from the Date header, null where it cannot be
    read; warnings says so. error is set, and all else null, for a mail that is not
    UTF-8 and declares no charset. A null or empty content is an empty mail. names: a
    column of maps from Content-ID to file name, whose pictures the body embeds. files:
    with the bytes of attachments and of pictures shown. A read_error that came with a
    mail is its error.
    """
    unread = "read_error" in frame.columns

    def read(data, given):
        mail = Message(data)
        if mail.error:
            return dict.fromkeys(("headers", "pictures", "invisible", "files", "charset", *_TEXTS)) | {"error": mail.error}
        found = mail.fields(dict(given) if given else None, style)
        shown = [dict(zip(("content_id", "width", "height"), p, strict=True)) for p in found["pictures"]]
        out = [
            {"name": p.filename, "media_type": p.media_type, "content_id": p.content_id, "kind": "attachment", "width": None, "height": None, "content": mail.decoded_bytes(p) if files else None}
            for p in mail.attachments()
        ]
        for (name, width, height), p in mail.pictures(found["pictures"]):
            data = mail.decoded_bytes(p) if files or width is None or height is None else None
            if (width is None or height is None) and (size := natural_size(data)):
                out.append({"name": p.filename, "media_type": p.media_type, "content_id": name, "kind": "picture", **dict(zip(("width", "height"), _fit(width, height, size), strict=True)), "content": data if files else None})
            else:
                out.append({"name": p.filename, "media_type": p.media_type, "content_id": name, "kind": "picture", "width": width, "height": height, "content": data if files else None})
        return found | {"headers": mail.root.headers, "pictures": shown, "files": out, "charset": mail.charset, "error": None}

    parsed = _map_mails(frame, content, _PARSED, read, names)
    if unread:
        parsed = parsed.withColumn("error", F.coalesce("read_error", "error")).drop("read_error")
    attached = F.filter("files", lambda f: f["kind"] == "attachment")
    attachments = F.transform(
        attached,
        lambda f: F.struct(F.coalesce(f["name"], F.lit("unnamed")).alias("name"), f["media_type"].alias("media_type"), F.coalesce(f["name"], F.lit("unnamed")).alias("source_name"), F.lit(False).alias("is_embedded")),
    )
    parsed = parsed.withColumn("created", C.instant("date")).withColumn("sender_offset_min", C.offset_minutes("date"))
    undated = F.when(F.col("error").isNull() & F.col("created").isNull(), F.lit("no readable Date header"))
    summary = F.when(F.col("error").isNull(), F.nullif(C.invisible_summary("invisible"), F.lit("")))
    return parsed.withColumn("attachments", attachments).withColumn("warnings", F.array_compact(F.array(undated, summary)))


def _fit(width, height, natural):
    from postmill.functions.images import display_size

    return display_size(width, height, natural) or (width, height)


def read_again(frame: DataFrame, content: str, names: str, style: str = "markdown") -> DataFrame:
    """frame without content, with body as it reads with the pictures of names (Content-ID to file) embedded.

    Rows with a null content keep their body and cost no second reading.
    """

    def read(data, given):
        return {"_again": None if data is None else Message(data).fields(dict(given or ()), style)["body"]}

    done = _map_mails(frame, content, "_again string", read, names)
    return done.withColumn("body", F.coalesce("_again", "body")).drop("_again")


def parts(frame: DataFrame, content: str = "content", bytes_: bool = False) -> DataFrame:
    """A row for each part of each mail, in document order, with its place (path) in the MIME tree.

    position counts the parts of a mail; part is described by PART. Containers are rows
    too, the root among them (an empty path). Mails with a read error have no parts.
    """

    def read(data, _):
        mail = Message(data)
        rows = []
        for p in [] if mail.error else mail.root.all():
            rows.append(
                {
                    "path": list(p.path), "container": p.container, "media_type": p.media_type, "params": p.params, "disposition": p.disposition, "filename": p.filename, "content_id": p.content_id,
                    "has_content_id": "content-id" in p.headers, "encoding": p.encoding, "is_body": p.is_body, "is_smime": p.media_type in SMIME, "headers": p.headers,
                    "content": mail.decoded_bytes(p) if bytes_ and not p.is_container else None,
                }
            )
        return {"parts": rows}

    found = _map_mails(frame, content, f"parts array<{PART}>", read)
    rest = _kept(found, ("parts",))
    return found.select(*[F.col(f"`{c}`") for c in rest], F.posexplode("parts").alias("position", "part"))


def with_between_text(rows: DataFrame, mail_id: str = "mail_id") -> DataFrame:
    """Rows of parts with is_between_text: body parts on both sides, in one multipart/mixed.

    The parts of a mail meet in one task, with their bytes if rows have them: filter
    parts without bytes, and read those of the files that are wanted.
    """
    parent = F.slice("part.path", 1, F.greatest(F.size("part.path") - 1, F.lit(0)))
    siblings = Window.partitionBy(mail_id, F.size("part.path"), parent).orderBy("position")
    body = F.col("part.is_body").cast("int")
    before = F.max(body).over(siblings.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(body).over(siblings.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("is_between_text", (F.col("part.container") == "multipart/mixed") & (F.coalesce(before, F.lit(0)) == 1) & (F.coalesce(after, F.lit(0)) == 1))


def attachments(rows: DataFrame, mail_id: str = "mail_id") -> DataFrame:
    """The rows of parts that a user attached."""
    leaves = with_between_text(rows, mail_id).where((F.size("part.path") > 0) & ~F.col("part.media_type").startswith("multipart/"))
    return leaves.where(C.is_user_attachment("part", F.col("is_between_text")))


def pictures_with_parts(pictures: DataFrame, rows: DataFrame, mail_id: str = "mail_id") -> DataFrame:
    """(mail_id, shown, content_id, width, height, position, part) of each picture shown that a part holds.

    pictures: (mail_id, shown, content_id, width, height), shown counting in order. Of
    parts with one Content-ID the first counts; attachments are no pictures; of a
    picture shown twice the first stays.
    """
    leaves = rows.where(F.col("part.content_id").isNotNull() & ~F.col("part.media_type").startswith("multipart/"))
    keyed = leaves.select(mail_id, F.col("part.content_id").alias("content_id"), "position", "part")
    first = keyed.groupBy(mail_id, "content_id").agg(F.min_by(F.struct("position", "part"), "position").alias("p"))
    attached = attachments(rows, mail_id).select(mail_id, F.col("part.content_id").alias("content_id")).where("content_id is not null").distinct()
    once = pictures.groupBy(mail_id, "content_id").agg(F.min(F.struct("shown", "width", "height")).alias("s"))
    joined = once.join(first, [mail_id, "content_id"]).join(attached, [mail_id, "content_id"], "left_anti")
    return joined.select(mail_id, "s.shown", "content_id", "s.width", "s.height", "p.position", "p.part")


def fallback_charsets(rows: DataFrame, mail_id: str = "mail_id") -> DataFrame:
    """(mail_id, charset): the first charset that a mail's parts declare and that can stand for bytes beyond ASCII."""
    label = F.lower(F.col("part.params")["charset"])
    usable = label.isNotNull() & ~label.isin("", "utf-8", "utf8", "us-ascii", "ascii")
    return rows.groupBy(mail_id).agg(F.min_by(F.when(usable, label), F.when(usable, F.col("position"))).alias("charset"))
