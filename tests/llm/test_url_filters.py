import pytest

from postmill.llm import url_filters as u
from postmill.llm.registry import URL_RULES


def plain(url, rules):
    host, path = u.parts(url)
    fits = [(len(h + p), len(h), a == "block", h + p) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (best[3], "block" if best[2] else "allow") if best else (None, "allow")


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/en/12?x#y", "https://a.b.example.org/es/1", "ftp://org", "http://org/", "http://xorg/", "http://m.shop.com/de/1", "http://shop.com/fr", "http://com/fr/é", "x://y.com/de/#", "http://example.org?/es/", "http://example.org/en/1" + "0" * 9000]


def test_parts():
    assert u.parts("HTTP://A.Bé.org:80?x/y") == ("a.bé.org:80", "")
    assert u.parts("a://b/c://d#e") == ("b", "/c://d")


@pytest.mark.parametrize("size", [64 << 20, 40])
def test_against_brute_force(spark, monkeypatch, size):
    """With one index, and with an index a rule."""
    monkeypatch.setattr(u, "INDEX_BYTES", size)
    frame = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    rows = u.url_filters(frame, URL_RULES).collect()
    assert len(rows) == len(URLS) * 2
    for r in rows:
        assert (r.rule, r.verdict) == plain(r.url, URL_RULES), r.url
    listed = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    assert {(r.page_id, r.rule) for r in u.url_filters(frame, listed).collect()} == {(r.page_id, r.rule) for r in rows}


def test_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(u, "digest", lambda rule: 7)
    index = u.Index(u.index_bytes([("a", "/", "block"), ("b", "/x", "allow"), ("a", "/", "allow")]))
    assert index.probe([("a", "/"), ("b", "/x"), ("c", "/")]) == [("a/", True), ("b/x", False), None]


def test_no_rules_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert u.url_filters(frame, [], otherwise="block").first().verdict == "block"
    assert u.url_filters(frame.limit(0), URL_RULES).count() == 0


def test_clashing_names_nulls_and_repeats(spark):
    names = ["u", "r", "host", "verdict", "lengths"]
    frame = spark.createDataFrame([("http://a.org/x", *range(5)), ("http://a.org/x", *range(5)), (None, *range(5))], ["url", *names])
    rows = u.url_filters(frame, [("org", "/", "block")]).collect()
    assert sorted((r.verdict, r.host, r.u, r.r, r.lengths) for r in rows) == [("allow", "", 0, 1, 4), ("block", "a.org", 0, 1, 4), ("block", "a.org", 0, 1, 4)]
