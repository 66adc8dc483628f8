"""Whole mails: body selection, charsets, attachments, pictures, notes, files."""

import base64 as b64

import pytest
from pyspark.sql import functions as F

from postmill.operators import messages as M
from postmill.operators import notes as N
from postmill.plans.convert import Options, UsageError, convert
from postmill.sources.mail import from_bytes


def box(kind, *parts, head="", mark="b"):
    body = "".join(f"--{mark}\r\n{p}\r\n" for p in parts)
    return f"{head}Content-Type: multipart/{kind}; boundary={mark}\r\n\r\npreamble\r\n{body}--{mark}--\r\nepilogue"


def leaf(kind, body, *more):
    return "\r\n".join([f"Content-Type: {kind}", *more, "", body])


BODIES = {
    "plain": ("Subject: s\r\n\r\nhello  \r\n\r\n\r\nyou", "hello\n\nyou"),
    "no type": ("\r\n\r\nx", "x"),
    "headers only": ("Subject: s", ""),
    "html": (leaf("text/html", "<p>a<p>b"), "a\n\nb"),
    "last form": (box("alternative", leaf("text/plain", "p"), leaf("text/html", "<b>h</b>")), "**h**"),
    "form gives way": (box("alternative", leaf("text/plain", "p"), leaf("text/html", "<img src=x>")), "p"),
    "joined": (box("mixed", leaf("text/plain", "one"), leaf("application/pdf", "x"), leaf("text/plain", " "), leaf("text/plain", "two")), "one\n\ntwo"),
    "attached text": (box("mixed", leaf("text/plain", "one"), leaf("text/plain", "no", "Content-Disposition: attachment")), "one"),
    "nested": (box("mixed", box("alternative", leaf("text/plain", "p"), leaf("text/html", "<i>h</i>"), mark="c"), leaf("text/plain", "q")), "*h*\n\nq"),
    "only a file": (box("mixed", leaf("application/pdf", "x")), ""),
    "no boundary": ("Content-Type: multipart/mixed\r\n\r\nraw", "raw"),
    "not closed": ("Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n\r\n\r\none\r\n--b\r\n\r\n\r\nlost", "one"),
    "never closed": ("Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n\r\nlost", "--b\n\nlost"),
    "part without header": (box("mixed", "\r\nfirst\r\n\r\nsecond"), "second"),
    "base64": (leaf("text/plain; charset=utf-8", b64.b64encode("grün".encode()).decode(), "Content-Transfer-Encoding: Base64"), "grün"),
    "bad base64": (leaf("text/plain", "not base64!", "Content-Transfer-Encoding: base64"), "not base64!"),
    "quoted": (leaf("text/plain; charset=iso-8859-15", "=A4 so=\r\nft=0D=0A=0D=0A=0D=0Aend", "Content-Transfer-Encoding: quoted-printable"), "€ soft\n\nend"),
    "unknown charset": (leaf("text/plain; charset=x-none", "=C3=A4", "Content-Transfer-Encoding: quoted-printable"), "ä"),
    "bad bytes": (leaf("text/plain; charset=utf-8", "=FF", "Content-Transfer-Encoding: quoted-printable"), "=FF"),
}


@pytest.fixture(scope="module")
def bodies(spark):
    mails = from_bytes(spark, [x.encode() for x, _ in BODIES.values()])
    return {r.mail_id: r for r in M.parse(mails).collect()}


@pytest.mark.parametrize("k", range(len(BODIES)), ids=list(BODIES))
def test_bodies(bodies, k):
    assert bodies[f"stdin-{k}"].body == list(BODIES.values())[k][1]


def test_charsets_of_bytes(spark):
    mails = [
        b"Subject: \xe4\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\n\x84a\x93",
        b"Subject: \xc3\xa4\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\n\xe4",
        b"Content-Type: text/plain; charset=iso-8859-15\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n\xa4 =A4",
        box("mixed", leaf("text/plain; charset=utf-8", "a"), leaf("text/plain; charset=koi8-r", "\xc1")).encode("latin-1"),
        b"Content-Type: text/plain; charset=utf-8\r\n\r\n\xe4",
        b"",
        None,
    ]
    frame = spark.createDataFrame([(str(k), m and bytearray(m), "mine") for k, m in enumerate(mails)], "mail_id string, content binary, body string")
    rows = {r.mail_id: r for r in M.parse(frame).collect()}
    assert [(rows[str(k)].subject, rows[str(k)].body) for k in range(3)] == [("ä", "„a“"), ("ä", "ä"), (None, "€ €")]
    assert rows["3"].body == "a\n\nа" and rows["4"].error.startswith("not valid UTF-8") and rows["4"].body is None
    assert [(rows[k].body, rows[k].error) for k in "56"] == [("", None)] * 2
    assert M.parse(frame.limit(0)).count() == 0 and M.parts(frame).where("mail_id = '4'").count() == 0


FILE = "Content-Disposition: attachment; filename="
LETTER = box(
    "mixed",
    box("related", leaf("text/html", "<p>hi #x<img src='cid:l@x' width=8><img src='cid:gone'><img src='cid:f@x'>"), leaf("image/png; name=l.png", "x", "Content-ID: <l@x>", "Content-Disposition: inline"), mark="c"),
    leaf("application/pdf", b64.b64encode(b"\xff\0").decode(), FILE + '"../a#.pdf"', "Content-Transfer-Encoding: base64"),
    leaf("application/pdf", "caf=C3=A9", FILE + "a-.pdf", "Content-Transfer-Encoding: quoted-printable"),
    leaf("image/jpeg; name=f.jpg", "raw", "Content-Disposition: attachment", "Content-ID: <f@x>"),
    leaf("image/gif", "y", "Content-Disposition: inline; filename=between.gif"),
    leaf("application/zip; name=in.zip", "z", "Content-Disposition: inline"),
    leaf("application/pkcs7-signature; name=smime.p7s", "s", FILE + "smime.p7s"),
    leaf("application/octet-stream", "n", "Content-Disposition: attachment"),
    leaf("text/plain", "end"),
    head="From: J <j@x.org>\r\nDate: Tue, 3 Feb 2026 4:05:06 +0100 (CET)\r\n",
)


def files(row):
    return [(p.file, p.source_name, bytes(p.content)) for p in row.planned]


def test_attachments_and_notes(spark):
    mails = from_bytes(spark, [LETTER.encode()])
    plain = convert(mails).first()
    assert [a.name for a in plain.attachments] == ["../a#.pdf", "a-.pdf", "f.jpg", "between.gif", "in.zip", "unnamed"]
    assert plain.omitted == "inline images left out: l.png"
    assert plain.created.isoformat() == "2026-02-03T03:05:06" and plain.sender_offset_min == 60
    assert plain.markdown.split("\n")[:3] == ["---", "created: 2026-02-03T03:05", 'from: "J <j@x.org>"']
    zone = convert(mails, Options(zone="Europe/Zurich")).first().markdown
    assert "created: 2026-02-03T04:05\n" in zone
    linked = convert(mails, Options(extract=True, style="obsidian")).first()
    names = ["a-.pdf", "a--1.pdf", "f.jpg", "between.gif", "in.zip", "unnamed"]
    assert [f[0] for f in files(linked)] == names
    assert [f[2] for f in files(linked)] == [b"\xff\0", "café".encode(), b"raw", b"y", b"z", b"n"]
    assert linked.markdown.endswith(
        "hi \\#x\n\nend\n\n|  |  |\n|---|---|\n| ![[f.jpg]] | ![[between.gif]] |\n\n[[a-.pdf|../a#.pdf]]\n\n[[a--1.pdf|a-.pdf]]\n\n[[in.zip]]\n\n[[unnamed]]\n"
    )
    shown = convert(mails, Options(pictures=True, pattern="{date:yyMMdd} {name}{ext}")).first()
    assert [f[0] for f in files(shown)] == [f"260203 {n}" for n in names] + ["260203 l.png"]
    assert "hi #x![[260203 l.png]]![[260203 f.jpg]]\n\nend" in shown.markdown and "| ![[260203 between.gif]] |  |" in shown.markdown


def test_taken_names_and_dateless_mails(spark):
    raw = box("mixed", *[leaf("text/csv", "x", FILE + "a.csv") for _ in range(3)], leaf("text/csv", "x", FILE + "a-1.csv"))
    mails = from_bytes(spark, [raw.encode()]).withColumn("taken", F.array(F.lit("a.csv")))
    row = convert(mails, Options(extract=True, pattern="{time} {name}"), "taken").first()
    assert [f[0] for f in files(row)] == ["a-1.csv", "a-2.csv", "a-3.csv", "a-1-1.csv"]
    assert row.warnings == ["no readable Date header", "no date for the file names"] and row.created is None


def test_relations_agree_with_the_parser(spark):
    mails = from_bytes(spark, [LETTER.encode(), BODIES["nested"][0].encode()])
    rows, parsed = M.parts(mails, bytes_=True), M.parse(mails)
    listed = {r.mail_id: [a.name for a in r.attachments] for r in parsed.collect()}
    found = {}
    for r in M.attachments(rows).orderBy("mail_id", "position").collect():
        found.setdefault(r.mail_id, []).append(r.part.filename or "unnamed")
    assert found == {k: v for k, v in listed.items() if v}
    shown = parsed.select("mail_id", F.posexplode("pictures").alias("shown", "p")).select("mail_id", "shown", "p.*")
    assert [(r.content_id, r.width, r.part.filename) for r in M.pictures_with_parts(shown, rows).collect()] == [("l@x", 8, "l.png")]
    paths = [tuple(r.part.path) for r in rows.where("mail_id = 'stdin-1'").orderBy("position").collect()]
    assert paths == [(), (0,), (0, 0), (0, 1), (1,)]


def test_options():
    with pytest.raises(UsageError, match="unknown placeholder {x}, {y:1}"):
        Options(pattern="{x}{name}{y:1}")
    with pytest.raises(UsageError):
        Options(style="org")
    with pytest.raises(UsageError):
        Options(extract=True, output="-")


def test_write_status(spark):
    notes = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/c", "3"), ("/d", None)], "path string, markdown string")
    there = spark.createDataFrame([("/b", "2"), ("/c", "x"), ("/e", "y")], "path string, markdown string")
    for force, changed in ((False, "conflict"), (True, "changed")):
        found = {r.path: r.status for r in N.write_status(notes, there, force).collect()}
        assert found == {"/a": "new", "/b": "unchanged", "/c": changed, "/d": "failed"}


def _nested(levels):
    head = "".join(f'Content-Type: multipart/mixed; boundary="b{k}"\r\n\r\n--b{k}\r\n' for k in range(levels))
    return (head + "Content-Type: text/plain\r\n\r\nthe text" + "".join(f"\r\n--b{k}--\r\n" for k in reversed(range(levels)))).encode()


def test_containers_of_any_depth():
    from postmill.functions.message import Message

    for levels in (1, 100, 101, 5000):
        mail = Message(_nested(levels))
        assert mail.fields()["body"] == "the text" and len(list(mail.root.all())) == levels + 1
        assert [len(p.path) for p in mail.root.leaves()] == [levels]
