import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import ngram_join as g


def grams(text):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    """Sorted (doc_id, class_id, n_links) of rows (doc_id, text), by all pairs."""
    sets = [grams(x) for _, x in rows]
    n, up, links = len(rows), list(range(len(rows))), Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], least.get(root(i)), links[i]) for i in range(n)), key=str)


def test_bands_reach_the_recall():
    b = g.bands()
    assert 1 - (1 - 0.8**g.ROWS) ** b >= g.RECALL > 1 - (1 - 0.8**g.ROWS) ** (b - 1)


def test_shingle_sets_depend_on_words_alone(monkeypatch):
    texts = ["a b  C d\ne f", None, "", " \t", "A b c D e\x0bf", "one", "one two", "é" * 3, "two one", "x " * 4000, "a b c d e f"]
    found = [tuple(s) for s in g.shingle_sets(pa.array(texts))]
    assert found[0] == found[4] == found[10] and len(found[0]) == 2
    assert found[1] == found[2] == found[3] == () and found[6] != found[8] and len(found[9]) == 1
    monkeypatch.setattr(g, "STEP", 7)
    assert [tuple(s) for s in g.shingle_sets(pa.array(texts).slice(0))] == found
    assert [tuple(s) for s in g.shingle_sets(pa.array(["zz zz", *texts]).slice(1))] == found


def near_copies(seed=1, base=6, each=40):
    dice, rows, word = random.Random(seed), [], lambda: dice.choice("abcdefghij") + str(dice.randint(0, 300))
    for _ in range(base):
        words = [word() for _ in range(dice.randint(60, 260))]
        for _ in range(each):
            copy = list(words)
            for _ in range(dice.choice([0, 0, 1, 2, 3, 4, 6, 9])):
                copy[dice.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("cross", [False, True])
def test_verify_against_all_pairs(cross):
    sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in grams(t)], np.uint64)) for _, t in near_copies(base=3, each=25)]
    dice = np.random.default_rng(0)
    copies, side = dice.integers(1, 5, len(sets)), dice.integers(0, 2, len(sets)) if cross else np.zeros(len(sets), np.int64)
    links, roots = g.verify(sets, copies, side, cross, Fraction("0.8"))
    want = np.zeros(len(sets), np.int64)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                if not cross or side[i] != side[j]:
                    want[i] += copies[j]
                    want[j] += copies[i]
                    assert roots[i] == roots[j] or cross
    assert (links == want).all()


@pytest.mark.parametrize("block", [None, 16])
def test_against_brute_force(spark, monkeypatch, block):
    """Whole, and with buckets and components cut into many blocks and texts fetched by a shuffle."""
    if block:
        monkeypatch.setattr(g, "BUCKET_BLOCK", block // 4)
        monkeypatch.setattr(g, "LEADER_FROM", 2)
        monkeypatch.setattr(g, "BROADCAST_LEADERS", block // 16)
        monkeypatch.setattr(g, "BLOCK_NODES", block)
        monkeypatch.setattr(g, "BROADCAST_IDS", 1)
    rows = near_copies(seed=4) + [(1000 + i, "just four words here") for i in range(5)] + [(2000, None), (2001, ""), (2002, " \n"), (3, "three"), (None, "just four words here"), (None, None), (2003, "y" * 30000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(5)
    assert sorted((tuple(r) for r in g.ngram_join(frame).collect()), key=str) == plain(rows)


def test_one_of_each(spark):
    rows = near_copies(seed=6, base=3, each=10) + [(0, None), (0, ""), (None, " "), (500, "a b c d e f"), (500, "a b c d e f"), (501, "a b c d e f")]
    frame = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, source string, class_id int")
    kept = g.one_of_each(frame).collect()
    classes = plain(rows)
    want = sorted({c for i, c, _ in plain([r for r in rows if grams(r[1])])})
    assert sorted(r.doc_id for r in kept if grams(r.text)) == want
    assert len([r for r in kept if not grams(r.text)]) == 3 and len(classes) == len(rows)
    assert g.one_of_each(frame.limit(0)).count() == 0 and g.ngram_join(frame.limit(0)).count() == 0


def test_a_leader_leaves_no_alike_pair_apart(spark, monkeypatch):
    """Two groups in every bucket: one like the leader, one not, and both are whole."""
    dice = np.random.default_rng(3)
    base = dice.integers(0, 256, (2, 126), dtype=np.uint8)
    rows = []
    for i in range(60):
        sketch = base[i % 2].copy()
        sketch[dice.integers(0, 126, 6)] = 255 - base[i % 2][0]
        rows.append((b"%03d" % i, 100, sketch.tobytes(), [1, 2 + i % 3]))
    nodes = spark.createDataFrame([(bytearray(a), n, bytearray(k), b) for a, n, k, b in rows], "node binary, n long, sketch binary, bands array<long>")
    monkeypatch.setattr(g, "LEADER_FROM", 5)
    monkeypatch.setattr(g, "BUCKET_BLOCK", 7)
    scratch = g.Scratch(spark)
    found = g.components(scratch, scratch.write(g.candidates(nodes, scratch, 0.8, 126), "edges")).collect()
    assert len(found) == 60 and len({bytes(r.root) for r in found}) == 2
    assert all(int(bytes(r.node)) % 2 == int(bytes(r.root)) % 2 for r in found)


def test_alike_starts_from_what_is_joined():
    same = np.zeros((6, 126), np.uint8)
    assert g.alike(same, np.full(6, 9), 0.7, 0.8, np.array([0, 0, 0, 1, 1, 1], bool)) == [(0, 1), (0, 2), (0, 3)]
    assert g.alike(same, np.full(6, 9), 0.7, 0.8, np.ones(6, bool)) == []


def test_clashing_names_and_ids_of_any_kind(spark):
    text = "a text of some more words than five"
    rows = [("b", text, 1, 2, 3, 4, 5), ("a", text, 6, 7, 8, 9, 10), ("c", "another text", 11, 12, 13, 14, 15), (None, "", 1, 1, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, d int, th int, h int, r int, i int")
    kept = g.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    assert sorted(map(tuple, g.ngram_join(frame).collect()), key=str) == [("a", "a", 1), ("b", "a", 1), ("c", "c", 0), (None, None, 0)]
