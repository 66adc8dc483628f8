"""Licence scans: TF-IDF cosine to templates, then inheritance from ancestor directories.

Every line of a text, every window of consecutive lines (comment marks taken off) up to
twice the words of the longest notice, so any header that wraps, and the whole text of a
licence file, is compared with notices of known licences as a sparse TF-IDF vector.
Notices are what headers say and what licence files begin with; a tag that names a
licence by its SPDX identifier is read as it is. Files without a licence of their own
take that of the nearest directory above them that holds a licence file, by joins on
paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import Scratch, lean, small_batches

#: Notices by which licences are known.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "All rights reserved."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]
#: A tag that names a licence; its score is 1. Suffixes of versions are taken off.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]*[A-Za-z0-9+])")
SUFFIX = re.compile(r"(?:-only|-or-later|\+)\Z")
#: Cosine from which a line has a template's licence.
THRESHOLD = 0.75
#: Directories with licences that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Words of texts whose A-Z are lower-cased; the same in Python and in Spark's functions.
WORD = re.compile(r"[a-z0-9_]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What comments put before a line and behind it.
MARKS = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|\(\*|dnl\b|rem\b)?\s*|\s*(?:\*+/|-->|\*\))?\s*$", re.IGNORECASE)


def lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def terms(line: str) -> Counter:
    return Counter(WORD.findall(lower(line)))


class Matcher:
    """Cosine of lines to templates; a term that no template has counts as one that no line has."""

    def __init__(self, templates, lines: int, holding: dict[str, int], threshold: float):
        self.unknown = math.log(1 + lines) + 1
        self.threshold = threshold
        self.rarity = {t: math.log((1 + lines) / (1 + holding.get(t, 0))) + 1 for _, text in templates for t in terms(text)}
        self.templates, self.telling = [], set()
        # words of the longest notice; windows may have twice as many
        self.longest = max((sum(terms(text).values()) for _, text in templates), default=0)
        for name, text in templates:
            vector = {t: n * self.rarity[t] for t, n in terms(text).items()}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            self.templates.append((name, {t: x / norm for t, x in vector.items()}))
            # a line with none of the heaviest terms is below the threshold, whatever else it holds
            rest = 1.0
            for t, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
                if rest < threshold * threshold - 1e-9:
                    break
                self.telling.add(t)
                rest -= (x / norm) ** 2

    def best(self, line: str) -> tuple[float, str] | None:
        """(cosine, licence) of the nearest template, if near enough; of equals the first name."""
        low = lower(line)
        if not any(t in low for t in self.telling):
            return None
        counts = Counter(WORD.findall(low))
        if self.telling.isdisjoint(counts):
            return None
        vector = {t: n * self.rarity.get(t, self.unknown) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        found = [(sum(x * vector.get(t, 0.0) for t, x in weights.items()) / norm, name) for name, weights in self.templates]
        score, name = min(((-s, n) for s, n in found))
        return (-score, name) if -score >= self.threshold else None

    def best_window(self, text: str) -> tuple[float, str] | None:
        """best of the windows of two or more consecutive non-blank lines that have at most twice the longest notice's words."""
        low = lower(text)
        if not any(t in low for t in self.telling):
            return None
        found, run = [], []
        for line in [*low.split("\n"), ""]:
            line = MARKS.sub("", line)
            if line:
                run.append((line, WORD.findall(line)))
                continue
            # only windows that begin and end with a line that has a term of a notice can be the nearest
            useful = [not self.rarity.keys().isdisjoint(w) for _, w in run]
            for i in range(len(run)):
                if not useful[i]:
                    continue
                words, telling = len(run[i][1]), not self.telling.isdisjoint(run[i][1])
                for j in range(i + 1, len(run)):
                    words += len(run[j][1])
                    if words > 2 * self.longest:
                        break
                    telling = telling or not self.telling.isdisjoint(run[j][1])
                    if useful[j] and telling:
                        found.append(self.best(" ".join(x for x, _ in run[i : j + 1])))
            run = []
        return min(filter(None, found), key=lambda p: (-p[0], p[1]), default=None)


def tagged(text: str) -> str | None:
    """The licence that the first SPDX tag of a text names."""
    found = SPDX.search(text)
    return SUFFIX.sub("", found[1]) if found else None


def rarity(frame: DataFrame, text: str, templates) -> tuple[int, dict[str, int]]:
    """Lines with words in all texts, and those that hold each term of a template (as many as the templates have)."""
    known = sorted({t for _, x in templates for t in terms(x)})
    lines = frame.select(F.explode(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), "\n")).alias("line"))
    held = lines.select(F.array_distinct(F.regexp_extract_all("line", F.lit(f"({WORD.pattern})"), F.lit(1))).alias("held")).where(F.size("held") > 0)
    each = held.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("held", F.array(*map(F.lit, known)).cast("array<string>")))).alias("term"))
    counts = {r["term"]: r["n"] for r in each.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def license_scan(frame: DataFrame, path: str = "path", text: str = "text", is_license="is_license", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """frame without text, with own_license, own_score, license and license_from added, in place of columns so named.

    own_license: the licence that the first SPDX tag names (own_score 1), or that of the
    template with the highest cosine to a line, to a window of consecutive lines (without
    comment marks; blank lines end it), or to the whole text of a row that is_license
    says is a licence file (null: it is none), if the cosine reaches threshold;
    own_score is that cosine. license: the own one, or that of the nearest directory
    above path with a licence file that has one (of several the highest score, then the
    least path); license_from: the path it comes from. Directories end at the last "/";
    "" is above all. Null paths have no directory and inherit nothing. Null and empty
    texts have no own licence. Repeated rows each get the same; texts of any length are
    read whole. Columns may have any names.
    """
    small_batches(frame.sparkSession)
    scratch = Scratch(frame.sparkSession)
    matcher = Matcher(templates, *rarity(frame, text, templates), threshold)
    added = ("own_license", "own_score", "license", "license_from")
    rest = [c for c in frame.columns if c not in (*added, text)]
    packed = frame.select(F.col(text).alias("t"), F.coalesce(F.col(is_license), F.lit(False)).alias("f"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))
    schema = packed.select("r", "f").schema.add("own_license", "string").add("own_score", "double")

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for x, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = x or ""
                if tag := tagged(text):
                    names.append(tag)
                    scores.append(1.0)
                    continue
                found = [matcher.best(line) for line in text.split("\n")]
                found.append(matcher.best_window(text))
                if whole:
                    found.append(matcher.best(text.replace("\n", " ")))
                score, name = min(((-s, n) for s, n in filter(None, found)), default=(None, None))
                names.append(name)
                scores.append(None if score is None else -score)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["r", "f", "own_license", "own_score"])

    # the verdicts are needed three times, the texts once
    own = scratch.write(packed.mapInArrow(lean(run), schema), "own")
    own = own.withColumn("path", F.col(f"r.`{path}`")).withColumn("dir", F.regexp_replace("path", r"[^/]*\z", ""))
    giving = own.where(F.col("f") & F.col("own_license").isNotNull() & F.col("path").isNotNull())
    giving = giving.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("l"))).alias("best"))
    giving = scratch.write(giving, "giving")
    few = giving.count() <= BROADCAST_ROWS
    steps = F.split(F.col("dir"), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.concat_ws("/", F.slice(steps, 1, k), F.lit("")))
    homes = own.select("dir").where(F.col("dir").isNotNull()).distinct()
    levels = homes.select("dir", F.posexplode(up).alias("depth", "above")).withColumn("above", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.col("above")))
    near = levels.join(F.broadcast(giving) if few else giving, "above").groupBy("dir").agg(F.max_by("best", "depth").alias("best"))
    near = scratch.write(near.select(F.col("dir").alias("home"), F.col("best.l").alias("near_license"), F.col("best.p").alias("near_from")), "near")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    done = own.join(near, F.col("dir") == F.col("home"), "left")
    return done.select(
        *[F.col(f"r.`{c}`").alias(c) for c in rest], "own_license", "own_score",
        F.coalesce("own_license", "near_license").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("near_from")).alias("license_from"),
    )


def documents_as_files(documents: DataFrame) -> DataFrame:
    """documents with a path source/language/doc_id; each may be the licence file of its directory.

    The table has no paths or names, so any document with a notice of its own can give
    its licence to those beside it that have none.
    """
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return documents.select("doc_id", "text", path.alias("path"), F.lit(True).alias("is_license"))
