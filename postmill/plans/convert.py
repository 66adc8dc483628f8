"""The whole conversion: mails in, notes and files out."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import VERSION
from postmill.functions.columns import NamePattern
from postmill.operators import notes as N
from postmill.operators.messages import parse, read_again


class UsageError(ValueError):
    """Options that make no sense together, found before any mail is read."""


@dataclass(frozen=True)
class Options:
    """zone: the reader's time zone. extract: write attachments. pictures: also those that the body shows, and embed them."""

    zone: str = "UTC"
    style: str = "markdown"
    extract: bool = False
    pictures: bool = False
    pattern: str | None = None
    folder: str | None = None
    force: bool = False
    output: str | None = None
    verbose: bool = False
    inputs: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.style not in N.STYLES:
            raise UsageError(f"unknown style {self.style}")
        if self.pattern and (unknown := NamePattern(self.pattern).unknown):
            raise UsageError("unknown placeholder " + ", ".join("{" + t + "}" for t in unknown))
        if (self.extract or self.pictures) and self.output == "-" and not self.folder:
            raise UsageError("attachments of a note on standard output need a folder")


def convert(mails: DataFrame, options: Options = Options(), taken: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """mails (content, ...) with all columns of messages, the planned files, omitted, and the note as markdown.

    Read once; with pictures, mails that show some are read again with their names. If
    options name a folder, or existing the names (name) in it, all files get names of
    their own among all mails and these; for that, mails (with a mail_id) are read once
    more. taken: a column of names that a mail's files must not have.
    """
    wanted = options.extract or options.pictures
    if options.pictures:
        mails = mails.withColumn("_raw", F.col("content"))
    first = parse(mails, style=options.style, files=wanted)
    if not wanted:
        return N.render(N.omissions(first), options.zone, False, options.style)
    planned = N.plan_files(first, options.pattern, options.zone, options.pictures, taken)
    if options.folder or existing is not None:
        planned = N.number_over_folder(planned, existing)
    if not options.pictures:
        return N.render(N.omissions(N.link_planned(planned)), options.zone, True, options.style)
    # the mail rides along to its second reading: nothing is joined or shuffled
    again = F.when(F.size("pictures") > 0, F.col("_raw"))
    named = planned.withColumn("_raw", again).withColumn("_names", N.picture_names(F.col("planned")))
    whole = read_again(named, "_raw", "_names", options.style).drop("_names").withColumn("omitted", F.lit(""))
    return N.render(N.link_planned(whole, embed=True), options.zone, True, options.style)


def main(arguments: list[str] | None = None) -> int:
    """Command line: converts mail files to notes. Exit codes: 0, 1 for a failed mail or write, 64 for usage."""
    import argparse
    import os

    from pyspark.sql import SparkSession

    from postmill.sources import mail, sinks

    parser = argparse.ArgumentParser("postmill", description="Convert mails to Markdown notes.", allow_abbrev=False, exit_on_error=False)
    parser.add_argument("inputs", nargs="*", metavar="MAIL", help="mail files, or - for standard input")
    parser.add_argument("-o", "--output", metavar="FILE", help="where the note goes; - is standard output")
    parser.add_argument("-f", "--force", action="store_true", help="overwrite notes that differ")
    parser.add_argument("-x", "--extract-attachments", action="store_true", dest="extract", help="write attachments beside the note")
    parser.add_argument("-i", "--inline-images", action="store_true", dest="pictures", help="write and embed pictures, too")
    parser.add_argument("-d", "--attachments-dir", dest="folder", metavar="DIR", help="where attachments go")
    parser.add_argument("-n", "--attachment-name", dest="pattern", metavar="PATTERN", help="{name}, {ext}, {date:FORMAT}, {time:FORMAT}")
    parser.add_argument("--format", dest="style", default="markdown", help="markdown or obsidian")
    parser.add_argument("--zone", default="UTC", help="the reader's time zone")
    parser.add_argument("-v", "--verbose", action="store_true", help="say what was found")
    parser.add_argument("--version", action="version", version=f"postmill {VERSION}")
    try:
        given = vars(parser.parse_args(arguments))
        inputs = tuple(given.pop("inputs"))
        if not inputs or (len(inputs) > 1 and (given["output"] or "-" in inputs)):
            raise UsageError("one mail, or several without --output")
        options = Options(inputs=inputs, **given)
    except SystemExit as done:  # help and version are all that was asked for
        return int(done.code or 0)
    except (argparse.ArgumentError, argparse.ArgumentTypeError, UsageError) as error:
        print(f"postmill: {error}", file=sys.stderr)
        return 64
    for path in inputs:
        problem = None if path == "-" else "No such file" if not os.path.exists(path) else "Is a directory" if os.path.isdir(path) else None
        if problem:
            print(f"postmill: {path}: {problem}", file=sys.stderr)
            return 1
    spark = SparkSession.builder.appName("postmill").getOrCreate()
    if inputs == ("-",):
        mails = mail.from_bytes(spark, [sys.stdin.buffer.read()])
    else:
        mails = mail.read_mail_tolerant(spark, *map(os.path.abspath, inputs), pattern="*")
    to_screen = options.output == "-" or (options.output is None and inputs == ("-",))
    folder = options.folder or os.path.dirname(os.path.abspath(options.output if options.output and not to_screen else inputs[0]))
    used = mail.existing_names(spark, f"file://{os.path.abspath(folder)}") if options.extract or options.pictures else []
    names = spark.createDataFrame([(n,) for n in used], "name string")
    target = F.lit(f"file:{os.path.abspath(options.output)}") if options.output and not to_screen else N.note_path("path")
    made = sinks.once(convert(mails, options, existing=names).withColumn("path", target))
    for row in made.select("mail_id", "error", "warnings", "omitted").toLocalIterator():
        for said in [row.error] if row.error else [*row.warnings, row.omitted] if options.verbose else []:
            if said:
                print(f"postmill: {row.mail_id}: {said}", file=sys.stderr)
    failed = not made.where("error is not null").isEmpty()
    wanted = options.extract or options.pictures
    try:
        if to_screen:
            if wanted:
                sinks.write_files(made, folder)
            sys.stdout.writelines(sinks.to_standard_output(made))
            return int(failed)
        folders = {os.path.dirname(os.path.abspath(options.output or p)) for p in inputs}
        for missing in sorted(f for f in folders if not os.path.isdir(f)):
            raise sinks.Unwritable(f"{missing}: no such folder")
        existing = mail.existing_notes(spark, *folders)
        notes = made.where("error is null")
        status = N.write_status(notes, existing, options.force)
        sinks.check(status)
        sinks.check_folders(status.where(F.col("status").isin("new", "changed")).select("path"))
        if wanted:
            sinks.write_files(notes, folder)
        sinks.write_notes(notes, existing, options.force)
    except (sinks.Conflict, sinks.Unwritable) as error:
        print(f"postmill: {error}", file=sys.stderr)
        return 1
    except OSError as error:
        print(f"postmill: {error.filename or folder}: cannot be written", file=sys.stderr)
        return 1
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
