import math
from collections import Counter

import pytest

from postmill.llm import license_scan as s
from postmill.llm.registry import op2_license_scan

FILES = [
    ("LICENSE", "Some words.\nReleased under the MIT License.", True),
    ("a/LICENSE", "Licensed under the Apache License,\nVersion 2.0.", True),
    ("a/COPYING", "Licensed under CC BY-NC 4.0.", True),
    ("a/b/c/x.txt", "Nothing here at all.", False),
    ("a/b/y.txt", "Copyright.\n  ALL rights reserved. \nMore text", None),
    ("a2/z.txt", None, False),
    ("q", "", False),
    (None, "Released under the MIT license.", True),
    (None, "none", True),
    ("a/b/c/LICENSE", "no licence in it", True),
    ("a/b/LICENSE", "This library is licensed under the GNU Lesser General Public License, version 3.", False),
    ("t/" * 30 + "deep", "x " * 20000 + "\nword\n" + "license " * 3000, False),
    ("a/b/c/x.txt", "Nothing here at all.", False),
]


def plain(files, threshold=s.THRESHOLD):
    lines = [Counter(s.WORD.findall(s.lower(x))) for _, t, _ in files for x in (t or "").split("\n")]
    lines = [x for x in lines if x]
    weight = lambda t: math.log((1 + len(lines)) / (1 + sum(t in x for x in lines))) + 1
    known = {t for _, x in s.TEMPLATES for t in s.terms(x)}
    rare = {t: weight(t) for t in known}

    def cosine(a, b):
        v, w = ({t: n * rare.get(t, math.log(1 + len(lines)) + 1) for t, n in x.items()} for x in (a, b))
        dot = sum(x * w.get(t, 0) for t, x in v.items())
        return dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())) if dot else 0.0

    own = []
    for _, text, lic in files:
        pieces = (text or "").split("\n") + ([(text or "").replace("\n", " ")] if lic else [])
        best = min((-round(cosine(s.terms(p), s.terms(t)), 9), name) for p in pieces for name, t in s.TEMPLATES)
        own.append((best[1], -best[0]) if -best[0] >= threshold else (None, None))
    out = []
    for k, (path, _, _) in enumerate(files):
        found = (own[k][0], path) if own[k][0] else (None, None)
        if not found[0] and path is not None:
            folder = path.rpartition("/")[0]
            while True:
                here = sorted((-own[j][1], p, own[j][0]) for j, (p, _, lic) in enumerate(files) if lic and p is not None and own[j][0] and p.rpartition("/")[0] == folder)
                if here or not folder:
                    found = (here[0][2], here[0][1]) if here else (None, None)
                    break
                folder = folder.rpartition("/")[0]
        out.append((path, own[k][0], own[k][1], *found))
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(s, "BROADCAST_ROWS", most)
    frame = spark.createDataFrame([(*f, "mine") for f in FILES], "path string, text string, is_license boolean, license string")
    rows = s.license_scan(frame).collect()
    key = lambda r: tuple(map(str, r[:2]))
    found = sorted(((r.path, r.own_license, r.own_score and pytest.approx(r.own_score), r.license, r.license_from) for r in rows), key=key)
    assert found == sorted(plain(FILES), key=key)
    assert s.license_scan(frame.limit(0)).count() == 0


def test_telling_terms_lose_nothing():
    matcher = s.Matcher(s.TEMPLATES, 1000, {"the": 900, "under": 700, "license": 3}, 0.75)
    for name, text in s.TEMPLATES:
        assert matcher.best(text)[1] == name and matcher.best(text)[0] == pytest.approx(1)


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    notices = {t: n for n, t in s.TEMPLATES}
    for r in rows:
        exact = {notices[x.strip()] for x in texts[r.doc_id].split("\n") if x.strip() in notices}
        assert r.license or not r.license_from
        assert not exact or r.own_license in exact


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_headers_that_wrap_over_lines(spark, mark):
    header = ["You can redistribute it and/or", "modify it under the terms of the GNU", "General Public License, either version 3", "of the License, or any later version."]
    other = "\n".join(f"code {i} and more words of it" for i in range(60))
    text = other + "\n\n" + "\n".join(mark + x for x in header) + "\n\n" + other
    frame = spark.createDataFrame([("a/x.c", text, False), ("a/y.c", other, False)], "path string, text string, is_license boolean")
    found = {r.path: r.own_license for r in s.license_scan(frame).collect()}
    assert found == {"a/x.c": "GPL-3.0", "a/y.c": None}


GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main(void) { return 0; }"""
BSD = """# Copyright (c) 2020, Some One
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice."""
ISC = """Copyright (c) 2021 Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
APACHE_HEADER = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at"""
MIT_FILE = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
SPDX_TAG = "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;"


def test_real_headers_and_licence_files(spark):
    wanted = {"a/gpl.c": "GPL-3.0", "b/bsd.py": "BSD-3-Clause", "c/LICENSE": "ISC", "d/COPYING": "GPL-3.0", "e/LICENSE": "Apache-2.0", "f/x.go": "Apache-2.0", "g/LICENSE": "MIT", "h/s.c": "GPL-3.0"}
    texts = [GPL_HEADER, BSD, ISC, GPL_FILE, APACHE_FILE, APACHE_HEADER, MIT_FILE, SPDX_TAG]
    rows = [(path, text, path.endswith(("LICENSE", "COPYING"))) for path, text in zip(wanted, texts, strict=True)]
    rows += [(f"z/{i}.txt", f"Some other line of text, number {i}, that is part of the program and its documentation.", False) for i in range(300)]
    frame = spark.createDataFrame(rows, "path string, text string, is_license boolean")
    found = {r.path: r.own_license for r in s.license_scan(frame).collect() if not r.path.startswith("z/")}
    assert found == wanted


def test_clashing_names(spark):
    names = ["dir", "home", "_path", "near_license", "t", "f", "r", "own_score"]
    frame = spark.createDataFrame([("a/x", "Released under the MIT License.", True, *range(8)), ("a/b/y", "", False, *range(8))], ["path", "text", "is_license", *names])
    rows = s.license_scan(frame).collect()
    assert all([r[n] for n in names[:-1]] == list(range(7)) and r.license == "MIT" and r.license_from == "a/x" for r in rows)
