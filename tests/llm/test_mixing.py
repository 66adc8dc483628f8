import random
from collections import defaultdict

import pytest

from postmill.llm import mixing
from postmill.llm.registry import op9_mixing


def shares(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, total = {}, set(order), float(sum(sizes.values()))
    while left:
        unit = (total - sum(out.values())) / sum(w[s] for s in left)
        over = {s for s in left if w[s] * unit > most * sizes[s]}
        if not over:
            return out | {s: w[s] * unit for s in left}
        out |= {s: most * sizes[s] for s in over}
        left -= over
    return out


def hold(rows, sources):
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = sources[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    want = shares(sizes)
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] + 1e-6, s


def test_whole_table(spark, sf_dir):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_mixing(spark, sf_dir).collect()
    assert len(rows) == len(sources)
    hold(rows, sources)


@pytest.mark.parametrize("meet,sources", [(1_000_000, 100_000), (3, 1)])
def test_the_tree_loses_no_words_and_reruns_agree(spark, monkeypatch, meet, sources):
    """Also with a deep tree, sources ranked by ranges, and looked up by a salted shuffle."""
    monkeypatch.setattr(mixing, "MEET", meet)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    dice = random.Random(5)
    data = [(i, "w " * dice.choice([0, 1, 2, 5, 400]), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    real = mixing.pivotal
    monkeypatch.setattr(mixing, "pivotal", lambda f, s, seed=1: real(f, s, seed, 40))
    rows = mixing.mix(frame).collect()
    hold(rows, {i: s for i, _, s in data})
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_many_sources_of_one_document_each(spark, monkeypatch):
    real = mixing.pivotal
    monkeypatch.setattr(mixing, "pivotal", lambda f, s, seed=1: real(f, s, seed, 20))
    data = [(i, "w " * (1 + i % 5), f"s{i:04d}") for i in range(300)]
    rows = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    hold(rows, {i: s for i, _, s in data})


def test_clashing_names_and_ids_of_any_kind(spark):
    names = ["i", "s", "of", "nth", "r", "m_of", "_of", "_id", "_nth", "copies"]
    frame = spark.createDataFrame([(x, "a b c", "src", *range(10)) for x in ("d1", "d2", "d2")], ["doc_id", "text", "source", *names])
    kept = mixing.mix(frame, keep=True).collect()
    assert len(kept) == 3 and all([r[n] for n in names[:-1]] == list(range(9)) and r.copies == 1 and r.text == "a b c" for r in kept)


def test_nulls_repeats_ties_and_empty_tables(spark):
    data = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", None), (3, "a", None), (4, "a", "zero")]
    frame = spark.createDataFrame([(*r, "mine") for r in data], "doc_id long, text string, source string, size string")
    rows = mixing.mix(frame).collect()
    assert len(rows) == 6 and sum(r.taken for r in rows if r.size == 0) == 0
    kept = mixing.mix(frame, keep=True)
    assert kept.count() == 6 and {"doc_id", "text", "source", "taken"} <= set(kept.columns)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_fractions_are_fair():
    """Over many seeds a document's mean fraction stays what it was."""
    hits = 0
    for seed in range(400):
        done = {k: p for k, _, _, p in mixing._settle([(i, "s", 1 + i % 3, 0.3) for i in range(30)], seed, 0)}
        hits += sum(p for p in done.values())
    assert hits / (400 * 30) == pytest.approx(0.3, abs=0.03)
