"""Files in, files out: sources, conflicts, attachments, streams, the command line."""

import os

import pytest

from postmill.operators import notes as notes_operators
from postmill.plans.convert import Options, convert, main
from postmill.sources import mail, sinks
from postmill.streaming.notes import note_stream, start
from tests.test_messages import LETTER


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(LETTER.encode())
    (tmp_path / "in" / "b.eml").write_bytes(b"Subject: b\r\nDate: 1 Jan 2026 00:00 +0000\r\n\r\nbody")
    (tmp_path / "in" / "c.txt").write_bytes(b"no mail")
    return tmp_path


def notes_of(spark, folder):
    from postmill.operators.notes import note_path

    return convert(mail.read_mail(spark, str(folder / "in"))).withColumn("path", note_path("path"))


def test_read_and_write(spark, folder):
    notes = notes_of(spark, folder)
    existing = lambda: mail.existing_notes(spark, str(folder / "in"))
    assert sorted(r.status for r in sinks.write_notes(notes, existing()).collect()) == ["new", "new"]
    assert (folder / "in" / "b.md").read_text().endswith('subject: "b"\nattachments:\n---\n\nbody\n')
    assert {r.status for r in sinks.write_status(notes, existing()).collect()} == {"unchanged"}
    (folder / "in" / "a.md").write_text("mine")
    (folder / "in" / "b.md").unlink()
    with pytest.raises(sinks.Conflict, match=r"a\.md: differs"):
        sinks.write_notes(notes, existing())
    assert (folder / "in" / "a.md").read_text() == "mine" and not (folder / "in" / "b.md").exists()
    sinks.write_notes(notes, existing(), force=True)
    assert (folder / "in" / "a.md").read_text().startswith("---\n")
    assert [n for n in os.listdir(folder / "in") if n.startswith(".")] in ([], [".a.md.crc"])
    assert "".join(sinks.to_standard_output(notes)) == (folder / "in" / "a.md").read_text() + (folder / "in" / "b.md").read_text()


def test_attachments(spark, folder):
    planned = convert(mail.read_mail(spark, str(folder / "in")), Options(pictures=True))
    sinks.write_files(planned, str(folder / "out"))
    assert sorted(os.listdir(folder / "out")) == ["a--1.pdf", "a-.pdf", "between.gif", "f.jpg", "in.zip", "l.png", "unnamed"]
    assert (folder / "out" / "a-.pdf").read_bytes() == b"\xff\0"
    sinks.write_file_table(planned, str(folder / "files"))
    assert spark.read.parquet(str(folder / "files")).where("name = 'f.jpg'").first().content == b"raw"
    assert "l.png" in mail.existing_names(spark, f"file://{folder}/out") and mail.existing_names(spark, f"file://{folder}/none") == []


PDF = "Content-Type: application/pdf\r\nContent-Disposition: attachment; filename=%s\r\n\r\n%s"


def letters(folder, files):
    """A mail of its own for each (mail, names of files)."""
    for k, (name, names) in enumerate(files):
        parts = "".join(f"--b\r\n{PDF % (x, f'{name} {x} {i}')}\r\n" for i, x in enumerate(names))
        (folder / "in" / name).write_bytes(f'Subject: {k}\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n\r\ntext\r\n{parts}--b--\r\n'.encode())


def test_files_of_many_mails_in_one_folder(spark, folder, monkeypatch):
    """None is lost and none that stands there is replaced."""
    for name in ("a.eml", "b.eml"):
        (folder / "in" / name).unlink()
    letters(folder, [(f"m{k}.eml", ["r.pdf", "r.pdf", "r-2.pdf", f"own{k}.pdf"]) for k in range(6)])
    (folder / "out").mkdir()
    (folder / "out" / "r.pdf").write_bytes(b"mine")
    mails = mail.read_mail(spark, str(folder / "in"))
    with pytest.raises(sinks.Conflict, match=r"several mails|exists"):
        sinks.write_files(convert(mails, Options(extract=True)), str(folder / "out"))
    assert os.listdir(folder / "out") == ["r.pdf"]
    for most in (10_000, 3):
        monkeypatch.setattr(notes_operators, "NAMED_ALIKE", most)
        out = folder / f"out{most}"
        out.mkdir()
        (out / "r.pdf").write_bytes(b"mine")
        existing = spark.createDataFrame([(n,) for n in mail.existing_names(spark, f"file://{out}")], "name string")
        done = convert(mails, Options(extract=True, folder=str(out)), existing=existing)
        sinks.write_files(done, str(out))
        names = sorted(n for n in os.listdir(out) if not n.startswith("."))
        assert len(names) == 1 + 6 * 4 and (out / "r.pdf").read_bytes() == b"mine"
        held = sorted((out / n).read_bytes().decode() for n in names if n != "r.pdf")
        assert held == sorted(f"m{k}.eml {x} {i}" for k in range(6) for i, x in enumerate(["r.pdf", "r.pdf", "r-2.pdf", f"own{k}.pdf"]))
        for r in done.collect():  # notes link the names that were given
            assert all(f"[[{a.name}" in r.markdown for a in r.attachments)
            assert [(out / p.file).read_bytes() for p in r.planned] == [bytes(p.content) for p in r.planned]


def test_many_files_of_one_name_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(notes_operators, "NAMED_ALIKE", 3)
    mails = [(f"m{k % 7}-{k}", ["a.pdf"] * (1 + 7 * (k == 20)) + ["b.pdf"] * (k == 30)) for k in range(40)]
    planned = spark.createDataFrame([(m, [(n,) for n in names]) for m, names in mails], "mail_id string, planned array<struct<file:string>>").repartition(5)
    found = {r.mail_id: [p.file for p in r.planned] for r in notes_operators.number_over_folder(planned, spark.createDataFrame([("a.pdf",)], "name string")).collect()}
    number = 0
    for m, names in sorted(mails):
        files = [f"a-{number + j + 1}.pdf" for j in range(names.count("a.pdf"))]
        assert found[m] == files + ["b.pdf"] * names.count("b.pdf")
        number += len(files)


def test_two_notes_of_one_path(spark, folder):
    rows = spark.createDataFrame([("/x/a.md", "one"), ("/x/a.md", "two"), ("/x/b.md", "three"), ("/x/c.md", None), ("/x/c.md", "four")], "path string, markdown string")
    none = spark.createDataFrame([], "path string, markdown string")
    found = sorted((r.path, r.status) for r in sinks.write_status(rows, none).collect())
    assert found == [("/x/a.md", "duplicate"), ("/x/a.md", "duplicate"), ("/x/b.md", "new"), ("/x/c.md", "failed"), ("/x/c.md", "new")]
    with pytest.raises(sinks.Conflict, match=r"/x/a\.md: several mails"):
        sinks.write_notes(rows, none, force=True)


def test_folders_are_checked_first(spark, folder):
    none = spark.createDataFrame([], "path string, markdown string")
    rows = spark.createDataFrame([(f"{folder}/in/new.md", "one"), (f"{folder}/missing/b.md", "two")], "path string, markdown string")
    with pytest.raises(sinks.Unwritable, match="missing: no such folder"):
        sinks.write_notes(rows, none)
    assert not (folder / "in" / "new.md").exists()
    (folder / "in" / "x.md").mkdir()
    with pytest.raises(sinks.Unwritable, match="cannot be written"):
        sinks.write_notes(spark.createDataFrame([(f"{folder}/in/x.md", "one")], "path string, markdown string"), none)


def test_an_unreadable_file_is_a_row(spark, folder):
    assert mail.read_one(f"file:{folder}/in/none.eml") == (None, "cannot be read: FileNotFoundError")
    assert mail.read_one(f"file:{folder}/in")[1].startswith("cannot be read")
    rows = mail.read_mail_tolerant(spark, str(folder / "in")).collect()
    assert {os.path.basename(r.path): (bytes(r.content)[:9], r.read_error) for r in rows}["b.eml"] == (b"Subject: ", None)
    bad = spark.createDataFrame([("x", "x", None, "cannot be read: PermissionError"), ("y", "y", bytearray(b"Subject: y"), None)], mail.COLUMNS + ", read_error string")
    rows = {r.path: r for r in convert(bad).collect()}
    assert rows["x"].error == "cannot be read: PermissionError" and rows["x"].markdown is None and rows["y"].error is None and "read_error" not in rows["x"]


def test_stream(spark, folder):
    run = lambda: start(note_stream(spark, str(folder / "in")), str(folder / "t"), str(folder / "cp")).awaitTermination()
    run()
    (folder / "in" / "d.eml").write_bytes(b"Subject: d\r\n\r\nlater")
    run()
    rows = spark.read.parquet(str(folder / "t")).collect()
    assert sorted(os.path.basename(r.path) for r in rows) == ["a.md", "b.md", "d.md"]


def test_command_line(spark, folder, capsys):
    path = str(folder / "in" / "b.eml")
    assert main([path]) == 0 and (folder / "in" / "b.md").exists()
    assert main([path]) == 0
    (folder / "in" / "b.md").write_text("mine")
    assert main([path]) == 1 and "differs from generated output" in capsys.readouterr().err
    assert main([path, "-f", "--format", "obsidian"]) == 0
    assert main([path, "-o", "-"]) == 0 and capsys.readouterr().out.endswith("body\n")
    assert main([str(folder / "in" / "a.eml"), "--inline-images", "-d", str(folder / "x"), "--attachment-name={name}-{date}"]) == 0
    assert "l-2026-02-03.png" in os.listdir(folder / "x")
    capsys.readouterr()
    assert main([path, "-o", str(folder / "no" / "b.md")]) == 1 and "no such folder" in capsys.readouterr().err
    assert main([str(folder / "in" / "a.eml"), "-x", "-f", "-d", str(folder / "in" / "b.eml")]) == 1 and "cannot be written" in capsys.readouterr().err
    assert main([str(folder / "none.eml")]) == 1 and "No such file" in capsys.readouterr().err
    assert main([str(folder)]) == 1 and "Is a directory" in capsys.readouterr().err
    assert main(["--version"]) == 0 and main(["-h"]) == 0 and "postmill 0" in capsys.readouterr().out
    for bad in ([], ["--format=x", path], ["--attachment-name={q}", path], ["-x", "-o", "-", path], ["--no", path], [path, path, "-o", "y"]):
        assert main(bad) == 64, bad
