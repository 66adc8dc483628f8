import hashlib
from collections import defaultdict

import numpy as np
import pytest

from postmill.llm import line_dedup as d
from postmill.llm.registry import op6_line_dedup


def plain(rows, least=40, holders=5):
    """rows of (doc_id, text) -> [(doc_id, n_lines, n_dropped, kept text)]"""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    fold = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in strip(x))
    holds = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(strip(line)) >= least:
                holds[fold(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holds.get(fold(x), ())) < holders or max(holds[fold(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_perfect_hash_is_minimal_and_finds_its_keys_only():
    keys = [b"line %d" % i for i in range(5000)]
    high, low = d.digests(keys)
    ids = np.arange(5000)
    shard = d.Shard(d.build(high, low, (ids % 9).astype(np.uint32), ids))
    held, number = shard.probe(high, low)
    assert held.all() and sorted(number) == list(range(5000))
    assert (shard.keepers[number] == ids).all() and (shard.counts[number] == ids % 9).all()
    assert not shard.probe(*d.digests([b"other %d" % i for i in range(5000)]))[0].any()
    empty = d.Shard(d.build(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint32, np.int64))))
    assert not empty.probe(high, low)[0].any()


def test_the_counts_decide(spark, monkeypatch):
    rows = [(i, "a line that is as long as it has to be, at least") for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert d.line_dedup(frame).where("n_dropped > 0").count() == 0
    monkeypatch.setattr(d, "build", lambda high, low, counts, keepers, plain=d.build: plain(high, low, counts + 1, keepers))
    assert d.line_dedup(frame).where("n_dropped > 0").count() == 3


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in op6_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert found == sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain(rows))
    assert sum(r[2] for r in found) > 0


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_many_shards_nulls_repeats_and_clashes(spark, monkeypatch, most):
    monkeypatch.setattr(d, "BROADCAST_BYTES", most)
    monkeypatch.setattr(d, "SHARD_LINES", 20)  # and shards with 41 lines or more are lent out
    long = [f"{k} " + "é" * 40 for k in range(40)]
    rows = [(i, "\n".join([long[(i + j) % 40].upper().lower() + " \t" * (i % 2) for j in range(20)] + ["x", ""])) for i in range(30)]
    rows += [(None, long[3]), (None, None), (7, long[3] + "\n" + long[3]), (8, ""), (9, "\n"), (100, "Y" * 40), (100, "y" * 40), (101, "x" * 50000)]
    frame = spark.createDataFrame([(*r, 5, "old", 1, 2, 3) for r in rows], "doc_id long, text string, n_lines int, extra string, ks int, th int, gone_id int")
    found = d.line_dedup(frame)
    assert sorted(found.columns) == ["doc_id", "extra", "gone_id", "ks", "n_dropped", "n_lines", "text", "th"]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=key) == sorted(plain(rows), key=key)
    assert d.line_dedup(frame.limit(0)).count() == 0
