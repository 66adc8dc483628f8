"""The plain kernels: headers, charsets, encodings, addresses, invisible characters, body, images."""

import struct
import time

import pytest

from postmill.functions import body, images, invisible, mail


def test_headers():
    block = "Subject:\n  a long\n\t one  \nno header\n more\nX-A : 1\nTo: a\nto:\tb"
    assert mail.header_map(block) == {"subject": "a long one more", "x-a ": "1", "to": "b"}
    assert mail.split_message("a: b\r\n\r\nc\r\n\r\nd") == ("a: b", "c\n\nd")
    assert mail.split_message("a: b\nc") == ("a: b\nc", "")


@pytest.mark.parametrize(
    "raw,value,found",
    [
        ('Text/HTML; Charset="UTF-8"', "text/html", {"charset": "UTF-8"}),
        ('attachment; filename="a;b\\"c\\\\d\\e.pdf"; x=1', "attachment", {"filename": 'a;b"c\\d\\e.pdf', "x": "1"}),
        ('a; b=c"d; e=f', "a", {"b": 'c"d', "e": "f"}),
        ("a; f*=utf-8''Gr%C3%BC%C3%9Fe%zz; f=alt", "a", {"f": "Grüße%zz"}),
        ('a; f*1="two"; f*0="one ;"; f=x', "a", {"f": "one ;two"}),
        ("a; f*0*=iso-8859-1'de'%FC; f*1=%FC", "a", {"f": "ü%FC"}),
        ("a; f*0=x; f*2=y; f=plain", "a", {"f": "plain"}),
        ("a; f*=utf-8''%FF; f=plain", "a", {"f": "plain"}),
        ("a; f*x=1; flag; g=", "a", {"f*x": "1", "g": ""}),
    ],
)
def test_parameters(raw, value, found):
    assert mail.parameters(raw) == (value, found)


def test_windows_1252():
    for charset in ("iso-8859-1", "us-ascii", "Windows-1252", "latin1"):
        text = mail.decode_text(bytes(range(256)), charset)
        assert len(text) == 256 and text[0x80] == "€" and text[0x9F] == "Ÿ" and text[0xFF] == "ÿ"
        assert [text[b] for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)] == [chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    assert mail.decode_text(b"\xa4", "ISO-8859-15") == "€" and mail.decode_text(b"\xc3\xa4", "no-such") == "ä"
    assert mail.decode_text(b"\xff", None) is None and mail.codec("base64") == "utf-8"


@pytest.mark.parametrize(
    "data,out",
    [(b"a=C3=A4=\nb\nc=3d", b"a\xc3\xa4b\nc="), (b"x=", b"x"), (b"=zz =4 =\xe4", b"=zz =4 =\xe4"), (b"a=\n", b"a"), (b"_=5F", b"__"), (b"", b"")],
)
def test_quoted_printable(data, out):
    assert mail.quoted_printable(data) == out


def test_encoded_words():
    assert mail.quoted_printable(b"a_=5F=\n", header=True) == b"a _=\n"
    assert mail.decode_words("=?utf-8?B?w6Q=?= \t=?ISO-8859-1?q?=FC_x?= y =?utf-8?Q?=FF?=") == "äü x y =FF"
    assert mail.decode_words("no =? words") == "no =? words"
    assert mail.base64_bytes(" YQ\n==") == b"a" and mail.base64_bytes("YQ") is None and mail.base64_bytes("!!!!") is None


@pytest.mark.parametrize(
    "raw,out",
    [
        ('"Doe, Jane" <j@x.org>', '"Doe, Jane" <j@x.org>'),
        ('"Jane" "Doe"  <j@x.org>, b@x.org', "Jane Doe <j@x.org>, b@x.org"),
        ("=?utf-8?q?Doe=2C_J=C3=A4n?= <j@x.org>", '"Doe, Jän" <j@x.org>'),
        ("'j@x.org' <J@x.org>", "J@x.org"),
        ('"a \\" b" <j@x.org>', 'a " b <j@x.org>'),
        ('"a \\"<b" <j@x.org>', '"a \\"<b" <j@x.org>'),
        ("<j@x.org>,, ", "j@x.org"),
        ("Group: ;", "Group: ;"),
        ("Jane, Doe <j@x.org>", "Jane, Doe <j@x.org>"),
        ("j@x.org (Jane)", "j@x.org (Jane)"),
        ('"open <j@x.org>', '"open <j@x.org>'),
        ("Jane <nobody>", "Jane <nobody>"),
        ("", ""),
    ],
)
def test_addresses(raw, out):
    assert mail.address_list(raw) == out


ZW = "\u200b"


@pytest.mark.parametrize(
    "text,out,counts",
    [
        ("a\u034f \u200c \u200d \u034fb", "a b", {"zero_width_chains": 4}),
        ("a\u200c\u200c\u200cb", "ab", {"zero_width_chains": 3}),
        ("a \u200c \u200c \u200c \nb", "a\nb", {"zero_width_chains": 3}),
        ("a\u00a0\u200d\u200bb", "a b", {}),
        (f"a{ZW}b\ufeffc", "abc", {"zero_width_spaces": 1, "byte_order_marks": 1}),
        ("\U0001f3f4\U000e0067\U000e0062\U000e007f \U000e0041", "\U0001f3f4\U000e0067\U000e0062\U000e007f ", {"tag_characters": 1}),
        ("\U0001f468\u200d\U0001f469\u200d\U0001f467 a\u200db", "\U0001f468\u200d\U0001f469\u200d\U0001f467 a\u200db", {"joiners": 1}),
        ("\U0001f44b\U0001f3fd\u200d\u2642\ufe0f\u200d1", "\U0001f44b\U0001f3fd\u200d\u2642\ufe0f\u200d1", {"joiners": 1}),
        ("\u200ea\u2066b\u202e", "\u200ea\u2066b\u202e", {"direction_marks": 1, "bidi_controls": 2}),
        ("soft\u00adhyphen", "soft\u00adhyphen", {}),
    ],
)
def test_invisible(text, out, counts):
    assert invisible.clean(text) == (out, dict.fromkeys(invisible.COUNTERS, 0) | counts)


def test_emoji():
    assert invisible.is_emoji("\U0001f609") and invisible.is_emoji("\u2764\ufe0f") and not invisible.is_emoji("1\ufe0f") and not invisible.is_emoji("\u200d") and not invisible.is_emoji("")


@pytest.mark.parametrize(
    "text,out",
    [
        ("a\r\n\r\n\r\nb  \t\n", "a\n\nb"),
        ("x@y<mailto:x@y> <mailto:z@y> <x@y<mailto:x@y>>", "x@y z@y <x@y>"),
        ("https://e.org/ <https://E.org> http://e.org<https://e.org/>", "https://e.org/ http://e.org"),
        ("e.org <https://other.org>", "e.org <https://other.org>"),
        ("e.org/a?b <https://x.safelinks.protection.outlook.com/?url=http%3A%2F%2Fe.org%2Fa%3Fb&data=1>", "e.org/a?b"),
        ("a\n\n[cid:i@x]\n\nb", "a\n\nb"),
        ("a\n[cid:i@x]\nb <cid:j>", "a\nb"),
        ("[cid:i]\n\nb", "b"),
        ("> a\n>\n[cid:i]\n\nb", "> a\n\nb"),
        ("Rarely mails <https://aka.ms/LearnAboutSenderIdentification/>\n\nb", "b"),
        ("x [<logo.PNG>](https://e.org/l)  y\n[<doc.pdf>](u)", "x y\n[<doc.pdf>](u)"),
        ("```\na  \n\n\n<mailto:x@y>\n``` \nb  ", "```\na  \n\n\n<mailto:x@y>\n``` \nb"),
        ("~~~\na  ", "~~~\na"),
        ("````\n```\n\n\n````\nx", "````\n```\n\n\n````\nx"),
    ],
)
def test_body(text, out):
    assert body.clean(text) == out


def test_body_is_linear():
    start = time.time()
    body.clean("https://e.org/" + "a" * 200_000 + " <https://e.org/" + "a" * 200_000 + ">")
    body.clean("word word\n" * 50_000)
    assert time.time() - start < 5


@pytest.mark.parametrize(
    "text,out",
    [
        ("#a b#c #1 #1a", "\\#a b#c #1 \\#1a"),
        ("> #a [#b](c) **#d** _#e_ (#f)", "> \\#a [\\#b](c) **\\#d** _\\#e_ (#f)"),
        ("`#a` ``#b `#c`` `#d", "`#a` ``#b `#c`` `#d"),
        ("> ```\n> #a\n> ```\n#b", "> ```\n> #a\n> ```\n\\#b"),
        ("# a ## #- #é/x", "# a ## \\#- \\#é/x"),
    ],
)
def test_tags(text, out):
    assert body.escape_tags(text) == out


def test_picture_sizes():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    gif = b"GIF89a" + struct.pack("<HH", 31, 21)
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 32, -22)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xff\xc0\0\x11\x08" + struct.pack(">HH", 23, 33)
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + struct.pack("<HH", 34, 24)
    extended = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (34).to_bytes(3, "little") + (24).to_bytes(3, "little")
    lossless = b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + (35 | 25 << 14).to_bytes(4, "little")
    assert [images.natural_size(x) for x in (png, gif, bmp, jpeg, lossy, extended, lossless)] == [(30, 20), (31, 21), (32, 22), (33, 23), (34, 24), (35, 25), (36, 26)]
    assert images.natural_size(b"<svg/>") is None and images.natural_size(b"") is None and images.natural_size(png[:20]) is None
    assert images.display_size(10, None, (30, 20)) == (10, 7) and images.display_size(None, 10, (30, 20)) == (15, 10)
    assert images.display_size(1, 2, None) == (1, 2) and images.display_size(1, None, None) is None and images.display_size(None, None, (3, 4)) == (3, 4)


def test_cleaning_takes_no_longer_than_the_text_is_long():
    import time

    from postmill.functions.body import clean

    link = "https://example.com/" + "a" * 4000
    for text, want in ((f"{link} <{link}>", link), ("\n".join(f"An ordinary line of text {k}." for k in range(4000)), None), ("<http://a>" * 20000, None)):
        start = time.perf_counter()
        found = clean(text)
        assert time.perf_counter() - start < 1 and found == (want or text)
