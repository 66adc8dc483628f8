"""Sinks: notes after a check for conflicts, files of attachments, tables."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.notes import write_status


class Conflict(Exception):
    """Something else stands where a note or file is to go."""


class Unwritable(Exception):
    """A folder or file that cannot be written."""


def check(status: DataFrame) -> None:
    """Raises Conflict, naming some paths, before anything is written."""
    said = {"conflict": "differs from generated output (use force to overwrite)", "duplicate": "several mails have this note"}
    bad = status.where(F.col("status").isin(*said)).select("path", "status").distinct().limit(5).collect()
    if bad:
        raise Conflict("\n".join(f"{r.path}: {said[r.status]}" for r in bad))


def check_folders(paths: DataFrame) -> None:
    """Raises Unwritable if a folder of paths (path) is missing or cannot be written, as the executors see it."""
    folders = paths.select(F.regexp_replace("path", r"/[^/]*\z", "").alias("folder")).distinct()

    def problems(batches):
        for batch in batches:
            found = []
            for folder in batch.column(0).to_pylist():
                name = local_path(folder) or "/"
                why = "no such folder" if not os.path.isdir(name) else None if os.access(name, os.W_OK | os.X_OK) else "cannot be written"
                if why:
                    found.append(f"{name}: {why}")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["problem"])

    bad = [r.problem for r in folders.mapInArrow(problems, "problem string").limit(5).collect()]
    if bad:
        raise Unwritable("\n".join(bad))


@contextlib.contextmanager
def _writing():
    """What a task could not write, as Unwritable."""
    try:
        yield
    except (Py4JJavaError, PySparkException) as error:
        said = re.search(r"(?:PermissionError|FileNotFoundError|FileExistsError|NotADirectoryError|IsADirectoryError|OSError): (.*)", str(error))
        if not said:
            raise
        raise Unwritable(f"{said[1]}: cannot be written") from None


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") or path


def write_whole(path: str, data: bytes, replace: bool = True) -> None:
    """Writes a file so that a reader sees all of it or nothing.

    replace: whatever stands there goes. Otherwise only a file of the same bytes may
    stand there, as it does when a task runs twice.
    """
    folder = os.path.dirname(path) or "."
    handle, name = tempfile.mkstemp(dir=folder, prefix=".")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.chmod(name, 0o644)
        if replace:
            os.replace(name, path)
            return
        try:
            os.link(name, path)
        except FileExistsError:
            with open(path, "rb") as f:
                if f.read() != data:
                    raise
        os.unlink(name)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)
        raise


def once(frame: DataFrame) -> DataFrame:
    """frame computed and written to the checkpoint folder, so that its readers do not compute it again.

    On a cluster that names no such folder it stays as it is. (A cached frame would
    also answer for later frames of the same plan, when files have changed.)
    """
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir() and re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='postmill-')}")
    return frame.checkpoint() if context.getCheckpointDir() else frame


def write_notes(notes: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Writes new and changed notes (path, markdown) as files that the executors can reach; returns the statuses.

    All or nothing: a conflict, two notes of one path, and a folder that is missing or
    cannot be written stop the write before its first note. The notes are made once (see
    once) for the check, the write and the statuses that are returned. Writing again is
    harmless, as tasks that run twice do: a note is replaced by itself.
    """
    status = once(write_status(notes, existing, force))
    going = status.where(F.col("status").isin("new", "changed")).select("path", "markdown")

    def put(rows: Iterator) -> None:
        for row in rows:
            write_whole(local_path(row.path), row.markdown.encode())

    check(status)
    check_folders(going)
    with _writing():
        going.foreachPartition(put)
    return status


def write_files(planned: DataFrame, folder: str) -> None:
    """Writes planned files (planned: array of file, content) into folder, which is made if there are any.

    No file is ever replaced: if several mails have a file of one name, or another file
    has it in folder, Conflict is raised before anything is written. number_over_folder
    gives all files names of their own.
    """
    target = local_path(folder)
    files = planned.select(F.explode("planned").alias("p")).select("p.file", "p.content")
    named = files.groupBy("file").agg(F.count("*").alias("n"))

    def standing(batches):
        for batch in batches:
            there = [n > 1 or os.path.lexists(os.path.join(target, f)) for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(there, pa.bool_()))

    bad = named.mapInArrow(standing, named.schema).limit(5).collect()
    if bad:
        raise Conflict("\n".join(f"{os.path.join(target, r.file)}: {'several mails have this file' if r.n > 1 else 'exists'}" for r in bad))

    def put(rows: Iterator) -> None:
        for row in rows:
            os.makedirs(target, exist_ok=True)
            write_whole(os.path.join(target, row.file), bytes(row.content or b""), replace=False)

    with _writing():
        files.foreachPartition(put)


def write_file_table(planned: DataFrame, path: str) -> None:
    """The files as a Parquet table (mail_id, name, content), for stores that executors do not mount."""
    rows = planned.select("mail_id", F.explode("planned").alias("p"))
    rows.select("mail_id", F.col("p.file").alias("name"), "p.content").write.mode("errorifexists").parquet(path)


def to_standard_output(notes: DataFrame) -> Iterator[str]:
    """The notes in order of their paths, byte for byte as files would hold them."""
    for row in notes.where("markdown is not null").orderBy("path").select("markdown").toLocalIterator():
        yield row.markdown
