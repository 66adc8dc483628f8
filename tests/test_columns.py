"""Spark expressions, against the plain kernels where there are some."""

import datetime as dt

from pyspark.sql import functions as F

from postmill.functions import columns as C
from postmill.functions import mail


def values(spark, column, rows, name="x", kind="string"):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, {name} {kind}")
    return [r[0] for r in frame.orderBy("k").select(column).collect()]


def test_headers_agree_with_the_kernel(spark):
    raw = ["A: 1\r\nB:\r\n two\r\n\tthree \r\na: 4\r\n\r\nbody\r\n\r\nmore", "X:y", "", "junk\nC : d: e\n\n\nz"]
    for k, found in enumerate(values(spark, C.headers("x"), raw)):
        head, rest = mail.split_message(raw[k])
        assert found == mail.header_map(head)
        assert values(spark, C.body_block("x"), raw)[k] == rest


def test_dates(spark):
    rows = [
        "Mon, 15 Jun 2026 09:41:00 +0200", "15 Jun 2026 09:41 +0200 (CEST)", "5 jun 2026 9:41:07 EST", "Fri, 05 Jun 2026 09:41:07  ut", "(a) 05 Jun 2026 09:41:07 -0330",
        "32 Jun 2026 09:41:07 +0000", "Jun 5 2026", "", None, "Mon, 15 Jun 26 09:41:00 +0200", "15 Jun 2026 09:41:00 XYZ",
    ]
    at = values(spark, C.instant("x"), rows)
    assert at[:5] == [dt.datetime(2026, 6, 15, 7, 41), dt.datetime(2026, 6, 15, 7, 41), dt.datetime(2026, 6, 5, 14, 41, 7), dt.datetime(2026, 6, 5, 9, 41, 7), dt.datetime(2026, 6, 5, 13, 11, 7)]
    assert at[5:] == [None] * 6
    assert values(spark, C.offset_minutes("x"), rows)[:5] == [120, 120, -300, 0, -210]
    assert values(spark, C.local_time(C.instant("x"), "Asia/Tokyo"), rows)[0] == "2026-06-15T16:41"


def test_yaml(spark):
    rows = ['a"b\\c', "x\ty\r\nz", "\u0000\u001f\u007f\u0085\u009f\u2028\u2029", "\U0001f600\u0007", "", None]
    assert values(spark, C.yaml_quoted("x"), rows) == ['"a\\"b\\\\c"', '"x\ty\\r\\nz"', '"\\x00\\x1F\\x7F\\N\\x9F\\L\\P"', '"\U0001f600\\x07"', '""', None]
    assert values(spark, C.field("n", "x"), ["a", "", None]) == ['n: "a"', "n:", "n:"]
    assert values(spark, C.list_field("n", "x"), [["a", 'b"'], [], None], kind="array<string>") == ['n: ["a", "b\\""]', "n:", "n:"]


def test_mailboxes(spark):
    rows = [("Jane", "j@x"), ("", "j@x"), (None, "j@x"), ("J@X", "j@x"), ('a,"b\\', "j@x")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n string, a string").orderBy("k")
    assert [r[0] for r in frame.select(C.mailbox("n", "a")).collect()] == [mail.format_mailbox(n or "", a) for n, a in rows]


def test_names(spark):
    own = [("a/b.pdf", "x"), ("..", "application/pdf"), (None, "image/png"), ("", "no/such"), ("/", "text/plain"), (".rc", "x"), (None, "image/jpeg"), (None, "application/octet-stream")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(own)], "k int, n string, t string").orderBy("k")
    assert [r[0] for r in frame.select(C.safe_name("n", "t")).collect()] == ["b.pdf", "unnamed.pdf", "unnamed.png", "unnamed", "unnamed.txt", ".rc", "unnamed.jpeg", "unnamed"]
    split = ["a.b.c", ".rc", "a.", "plain", "a.b\n.c", ""]
    assert list(zip(values(spark, C.stem("x"), split), values(spark, C.extension("x"), split), strict=True)) == [("a.b", "c"), (".rc", ""), ("a.", ""), ("plain", ""), ("a.b\n", "c"), ("", "")]
    assert values(spark, C.linkable("x"), ["a#b|c", "a[b]c", "[[a", "a]", "a]]b", "[a] b"]) == ["a-b-c", "a[b]c", "--a", "a-", "a--b", "[a] b"]
    names = [["a.x", "a.x", "a-1.x", "a.x", "b", "b"], []]
    assert values(spark, C.unique_names("x"), names, kind="array<string>") == [["a.x", "a-1.x", "a-1-1.x", "a-2.x", "b", "b-1"], []]
    assert values(spark, C.unique_names("x", F.array(F.lit("b"), F.lit("b-1"))), [["b"]], kind="array<string>") == [["b-2"]]


def test_patterns(spark):
    p = C.NamePattern("{date:yyyy}/{name} {odd} {x {ext")
    assert p.parts == [("moment", "yyyy"), ("literal", "/"), ("name", None), ("literal", " "), ("unknown", "odd"), ("literal", " "), ("literal", "{"), ("literal", "x "), ("literal", "{"), ("literal", "ext")]
    assert p.unknown == ["odd"] and p.needs_date and not C.NamePattern("{ext}").needs_date
    moment = F.lit("2026-01-02 03:04:05").cast("timestamp")
    assert values(spark, p.apply("x", moment), ["a/b.c"]) == ["2026-a-b {odd} {x {ext.c"]
    assert values(spark, C.NamePattern("{time}-{name}").apply("x", moment, "Asia/Tokyo"), ["a.c"]) == ["12-04-a.c"]
    assert values(spark, C.NamePattern("{date} {name}").apply("x", F.lit(None).cast("timestamp")), ["a.c"]) == ["a.c"]
    assert values(spark, C.NamePattern(" {ext}x{name} ").apply("x", moment), ["a.c", "a"]) == [".cxa", "xa"]


def test_small_ones(spark):
    assert values(spark, C.base64_text("x"), ["w6Q=", "w6Q", "/w==", "a b"]) == ["ä", "w6Q", "/w==", "a b"]
    assert values(spark, C.image_grid("x"), [["a", "b", "c"]], kind="array<string>") == ["|  |  |\n|---|---|\n| ![[a]] | ![[b]] |\n| ![[c]] |  |"]
    assert values(spark, C.header_block("x"), ["a: b\r\n\r\nc", "a: b"]) == ["a: b", "a: b"] and values(spark, C.body_block("x"), ["a: b\r\n\r\nc", "a: b", "\n\nx"]) == ["c", "", "x"]
    assert values(spark, C.headers("x"), ["A: 1\nb:2\na:  3 \n"]) == [{"b": "2", "a": "3"}]


def test_numbers_of_names(spark):
    names = ["a.b", "a.b", "a-2.b", "a.b", "a-01.b", "a.b", "x", "x", "a-1.b", "a.b", "-.b", "-.b"]
    done, want = [], []
    for n in names:
        stem, _, kind = n.rpartition(".") if "." in n else (n, "", "")
        k = 1
        found = n
        while found in done:
            found, k = f"{stem}-{k}" + (f".{kind}" if kind else ""), k + 1
        done.append(found)
        want.append(found)
    assert values(spark, C.unique_names("x"), [names], kind="array<string>") == [want]
    assert values(spark, C.yaml_quoted("x"), ["a\x00\x1f\n\t\u2028\x85\x9f\\\"", None, ""]) == ['"a\\x00\\x1F\\n\t\\L\\N\\x9F\\\\\\""', None, '""']
