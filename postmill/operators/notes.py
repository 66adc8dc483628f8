"""Messages as Markdown notes, files beside them, and what a write would do."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmill.functions import body as B
from postmill.functions import columns as C

STYLES = ("markdown", "obsidian")


@F.arrow_udf(StringType())
def _escaped_tags(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else B.escape_tags(x) for x in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _cleaned(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else B.clean(x) for x in texts.to_pylist()], pa.string())


def escaped_tags(text) -> Column:
    """Text with # escaped where it would open a tag; texts without one never leave the JVM's expressions."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.contains("#"), _escaped_tags(text)).otherwise(text)


def cleaned_body(text) -> Column:
    """Text as the body cleaner leaves it."""
    return _cleaned(F.col(text) if isinstance(text, str) else text)


def render(messages: DataFrame, zone: str = "UTC", links: bool = False, style: str = "markdown") -> DataFrame:
    """messages with markdown: frontmatter, body, and with links the attachments.

    The seven frontmatter keys always stand there, empty or not. created is the local
    time of zone. Rows with an error have a null note.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style}")
    empty = F.size(F.coalesce("attachments", F.array().cast(messages.schema["attachments"].dataType))) < 1
    listed = C.list_field("attachments", F.transform("attachments", lambda a: a["name"]))
    shown = F.when(empty, F.lit("attachments:")).otherwise(C.link_field("attachments") if links else listed)
    front = [F.lit("---"), C.field("created", C.local_time("created", zone), quoted=False), C.field("from", "from"), C.field("to", "to"), C.field("cc", "cc"), F.lit("via:"), C.field("subject", "subject")]
    body = escaped_tags("body") if style == "obsidian" else F.col("body")
    end = F.when(empty, F.lit("")).otherwise(C.attachment_block("attachments")) if links else F.lit("")
    text = F.concat(F.concat_ws("\n", *front, shown, F.lit("---"), F.lit(""), body), end, F.lit("\n"))
    failed = F.col("error").isNotNull() if "error" in messages.columns else F.lit(False)
    return messages.withColumn("markdown", F.when(~failed, text))


def plan_files(messages: DataFrame, pattern: str | None = None, zone: str = "UTC", pictures: bool = False, taken: str | None = None) -> DataFrame:
    """messages with planned: the files to write, in order, each under a name of its own.

    Attachments come first, so they keep their names; with pictures, the pictures that
    the body shows follow. pattern: see NamePattern; a mail without a date keeps its
    files' own names and gets a warning. taken: a column of names that are in use.
    """
    naming = C.NamePattern(pattern) if pattern else None
    if naming and naming.unknown:
        raise ValueError("unknown placeholder " + ", ".join("{" + t + "}" for t in naming.unknown))
    wanted = F.col("files") if pictures else F.filter("files", lambda f: f["kind"] == "attachment")
    messages = messages.withColumn("_wanted", wanted)
    own = F.transform("_wanted", lambda f: C.safe_name(f["name"], f["media_type"]))
    names = F.transform(own, lambda n: C.linkable(naming.apply(n, F.col("created"), zone) if naming else n))
    messages = messages.withColumn("_names", names).withColumn("_names", C.unique_names("_names", taken))
    planned = F.zip_with("_wanted", "_names", lambda f, n: F.struct(n.alias("file"), f["name"].alias("source_name"), f["media_type"].alias("media_type"), f["content_id"].alias("content_id"), f["kind"].alias("kind"), f["content"].alias("content")))
    if naming and naming.needs_date and "warnings" in messages.columns:
        late = F.when(F.col("created").isNull() & (F.size("_wanted") > 0), F.lit("no date for the file names"))
        messages = messages.withColumn("warnings", F.array_compact(F.concat("warnings", F.array(late))))
    return messages.withColumn("planned", planned).drop("_wanted", "_names")


#: Files of one name that one task numbers, tasks that may number those of more, and mails whose renames may be broadcast.
NAMED_ALIKE, NUMBERING_TASKS, BROADCAST_RENAMES = 10_000, 2_000, 100_000


def _fixed(frame: DataFrame) -> DataFrame:
    """frame computed once, in the checkpoint folder or else, where none is named, on the executors."""
    return frame.checkpoint() if frame.sparkSession.sparkContext.getCheckpointDir() else frame.localCheckpoint()


def number_over_folder(messages: DataFrame, existing: DataFrame | None = None, mail_id: str = "mail_id") -> DataFrame:
    """messages whose planned files have names of their own among all mails and the names in existing (name).

    Of files with one name the first in the order of mail_id and position keeps it,
    unless it exists; the others get the numbers after the largest that the name has
    already among all. A name that more than NAMED_ALIKE files have is numbered in
    several tasks, each a range of that order. mail_id names a mail. The names are
    computed once (see _fixed), and so are the ranges, whose bounds Spark samples.
    """
    files = _fixed(messages.select(F.col(mail_id).alias("mail"), F.posexplode(F.transform("planned", lambda p: p["file"])).alias("position", "name")))
    there = (existing.select("name") if existing is not None else messages.sparkSession.createDataFrame([], "name string")).distinct()
    counts = files.groupBy("name").agg(F.count("*").alias("n")).join(there.withColumn("taken", F.lit(1)), "name", "full")
    counts = counts.select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("taken", F.lit(0)).alias("taken"))
    own, kind = C.stem("name"), C.extension("name")
    numbered = counts.select(F.regexp_extract(own, r"(?s)^(.*)-([0-9]{1,18})$", 1).alias("base"), F.regexp_extract(own, r"(?s)^(.*)-([0-9]{1,18})$", 2).try_cast("long").alias("k"), kind.alias("kind"))
    largest = numbered.where("k is not null").groupBy("base", "kind").agg(F.max("k").alias("largest"))
    again = counts.where("n + taken > 1").withColumn("base", own).withColumn("kind", kind).join(largest, ["base", "kind"], "left")
    again = again.select("name", "base", "kind", "n", "taken", F.coalesce("largest", F.lit(0)).alias("largest"))
    many = again.where(F.col("n") > NAMED_ALIKE).select("name", "n")
    hot = many.agg(F.sum("n")).first()[0]
    dealt = files.withColumn("part", F.lit(0))
    if hot:
        ranges = files.join(many.select("name"), "name", "left_semi").repartitionByRange(min(-(-hot // NAMED_ALIKE), NUMBERING_TASKS), "name", "mail", "position")
        ranges = _fixed(ranges.withColumn("part", F.spark_partition_id()))
        dealt = dealt.join(many.select("name"), "name", "left_anti").unionByName(ranges)
    dealt = dealt.join(again, "name")
    before = dealt.groupBy("name", "part").agg(F.count("*").alias("m"))
    before = before.select(F.col("name").alias("of"), F.col("part").alias("in"), (F.sum("m").over(Window.partitionBy("name").orderBy("part")) - F.col("m")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("name", "part").orderBy("mail", "position"))
    ranked = dealt.withColumn("nth", nth).join(before, (F.col("name") == F.col("of")) & (F.col("part") == F.col("in"))).withColumn("number", F.col("before") + F.col("nth") + F.col("taken") - 1)
    ending = F.when(F.col("kind") != "", F.concat(F.lit("."), "kind")).otherwise(F.lit(""))
    renamed = ranked.where("number > 0").select("mail", "position", F.concat("base", F.lit("-"), (F.col("largest") + F.col("number")).cast("string"), ending).alias("name"))
    renames = renamed.groupBy(F.col("mail").alias("of_mail")).agg(F.map_from_entries(F.collect_list(F.struct("position", "name"))).alias("renames"))
    renames = F.broadcast(renames) if renamed.limit(BROADCAST_RENAMES + 1).count() <= BROADCAST_RENAMES else renames
    kept = F.transform("planned", lambda p, k: p.withField("file", F.coalesce(F.try_element_at("renames", k), p["file"])))
    done = messages.join(renames, F.col(mail_id) == F.col("of_mail"), "left").withColumn("planned", F.when(F.col("renames").isNull(), F.col("planned")).otherwise(kept))
    return done.drop("of_mail", "renames")


def link_planned(messages: DataFrame, embed: bool = False) -> DataFrame:
    """messages whose attachments are the planned files: attachments under their new names, then pictures.

    embed: the body embeds the files that it shows as pictures, attached ones among them.
    """
    shown = F.transform("pictures", lambda p: p["content_id"])
    entry = F.transform(
        "planned",
        lambda p: F.struct(
            p["file"].alias("name"), p["media_type"].alias("media_type"), F.coalesce(p["source_name"], F.lit("unnamed")).alias("source_name"), (F.lit(embed) & F.coalesce(F.array_contains(shown, p["content_id"]), F.lit(False))).alias("is_embedded")
        ),
    )
    return messages.withColumn("attachments", entry)


def picture_names(planned) -> Column:
    """A map from Content-ID to file of the planned pictures."""
    rows = F.filter(planned, lambda p: p["content_id"].isNotNull())
    ids = F.array_distinct(F.transform(rows, lambda p: p["content_id"]))
    return F.map_from_arrays(ids, F.transform(ids, lambda k: F.element_at(F.filter(rows, lambda p: p["content_id"] == k), -1)["file"]))


def omissions(messages: DataFrame) -> DataFrame:
    """messages with omitted: one line naming the pictures that the note leaves out, and their sizes."""
    left = F.filter("files", lambda f: f["kind"] == "picture")
    rows = F.transform(left, lambda f: F.struct(F.coalesce(f["name"], F.lit("unnamed")).alias("name"), f["width"].alias("width"), f["height"].alias("height")))
    return messages.withColumn("omitted", C.omission_summary(rows))


def note_path(path) -> Column:
    """The mail's path with .md for its extension."""
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".md"))


def write_status(notes: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """notes (path, markdown) with status new, unchanged, conflict or, with force, changed, against existing (path, markdown).

    Notes that share a path are duplicates, whatever stands there; a note without text
    has failed.
    """
    there = existing.select(F.col("path").alias("_path"), F.col("markdown").alias("_there"))
    joined = notes.join(there, F.col("path") == F.col("_path"), "left")
    status = (
        F.when(F.col("markdown").isNull(), F.lit("failed"))
        .when(F.count("markdown").over(Window.partitionBy("path")) > 1, F.lit("duplicate"))
        .when(F.col("_path").isNull(), F.lit("new"))
        .when(F.col("_there") == F.col("markdown"), F.lit("unchanged"))
        .otherwise(F.lit("changed" if force else "conflict"))
    )
    return joined.withColumn("status", status).drop("_path", "_there")
