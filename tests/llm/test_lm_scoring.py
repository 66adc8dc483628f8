import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postmill.llm import lm_scoring as m
from postmill.llm.registry import op4_lm_scoring


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Plain:
    """The same tree in dictionaries."""

    def __init__(self, texts, depth=m.DEPTH):
        self.depth = depth
        self.c = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.next = defaultdict(Counter)
        for t in texts:
            w = tokens(t)
            for i in range(len(w)):
                for k in range(1, min(i, depth) + 1):
                    self.next[tuple(w[i - k : i])][w[i]] += 1
        self.size = {s: sum(x.values()) for s, x in self.next.items()}
        self.kept = set()
        for s, found in self.next.items():
            here = {w: k / self.size[s] for w, k in found.items()}
            gain = sum(x * math.log(x / self.p(w, s[1:])) for w, x in here.items())
            if gain - len(here) / (2 * self.size[s]) >= m.DIVERGENCE:
                self.kept.add(s)

    def p(self, w, s, kept=None):
        if not s:
            return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))
        shorter = self.p(w, s[1:], kept)
        if s not in self.size or (kept is not None and s not in kept):
            return shorter
        k, c = self.next[s], self.size[s]
        return (k.get(w, 0) + (len(k) + 1) * shorter) / (c + len(k) + 1)

    def score(self, text):
        w = tokens(text)
        base = sum(math.log10(self.p(x, ())) for x in w)
        full = sum(math.log10(self.p(x, tuple(w[max(0, i - self.depth) : i]), self.kept)) for i, x in enumerate(w))
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, full


def check(found, rows, depth=m.DEPTH):
    model = Plain([t for i, t in rows if not out(i)], depth)
    want = sorted(((str(i), out(i), *model.score(t)) for i, t in rows), key=lambda r: (r[0], r[-1]))
    found = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=lambda r: (r[0], r[-1]))
    assert [x[:5] for x in found] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in found], [x[5:] for x in want], rtol=1e-7, atol=1e-4)
    return model


@pytest.mark.parametrize("depth,shard,common", [(1, 1000, 1 << 24), (3, 150, 40), (4, 300, 100), (2, 1_000_000, 1 << 24)])
def test_against_brute_force(spark, monkeypatch, depth, shard, common):
    """Also where contexts of any length are hot, up to the longest, and most words have no code."""
    monkeypatch.setattr(m, "SHARD_TOKENS", shard)
    monkeypatch.setattr(m, "BLOCK_TOKENS", 1500)
    monkeypatch.setattr(m, "PIECE_TOKENS", 70)
    monkeypatch.setattr(m, "COMMON", common)
    dice = random.Random(7)
    rows = []
    for i in range(300):
        lang = dice.choice("xy")
        w = [lang + dice.choice("abcdefghij") if dice.random() < 0.7 else f"{lang}{dice.randint(0, 500)}" for _ in range(dice.randint(0, 60))]
        rows.append((i, " ".join(w).title()))
    rows += [(None, None), (None, "Xa xb"), (3, ""), (3, "é É\x0bzz"), (20, "xa xb"), (20, "xa xb"), (21, "new " * 3000), (22, "new " * 9), (30, "new new new other")]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    model = check(m.lm_scores(frame, depth=depth).collect(), rows, depth)
    assert len(model.kept) > 5 and (shard > 1000 or max(model.size.values()) > 2 * shard)


def test_ids_of_any_type(spark):
    rows = [(f"d{i}", "a b c d") for i in range(40)]
    found = m.lm_scores(spark.createDataFrame([(*r, 0) for r in rows], "doc_id string, text string, block int")).collect()
    check(found, rows)


def test_probabilities_sum_to_one():
    texts = ["a b a b c", "b a b a d d", "a b a b"] * 9
    model = Plain(texts)
    for s in model.size:
        left = 0.1 / (model.n + 0.1 * (model.v + 1))
        for k in range(1, len(s) + 1):
            t = s[-k:]
            left *= (len(model.next[t]) + 1) / (model.size[t] + len(model.next[t]) + 1)
        assert sum(model.p(w, s) for w in model.c) + left == pytest.approx(1)


def test_empty_and_untrained_tables(spark):
    frame = spark.createDataFrame([(i, "a b") for i in range(200)], "doc_id long, text string")
    assert m.lm_scores(frame.limit(0)).count() == 0
    held = frame.where(m.held_out(frame.doc_id))
    rows = m.lm_scores(held).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == r.score == 0 for r in rows)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = op4_lm_scoring(spark, sf_dir).collect()
    check(found, rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_contexts_are_learned_in_tables_of_any_size(spark, monkeypatch):
    """A phrase seen twice is expected after its first words, however much other text there is."""
    monkeypatch.setattr(m, "COMMON", 50)
    monkeypatch.setattr(m, "OFTEN", 1)
    monkeypatch.setattr(m, "SHARD_TOKENS", 5000)
    dice = random.Random(5)
    rows = [(i, " ".join(dice.choices("abcdefgh", k=400))) for i in range(100, 200) if not out(i)]
    held = next(i for i in range(1000) if out(i))
    rows += [(1001, "rare phrase here"), (1002, "rare phrase here"), (held, "rare phrase here")]
    found = m.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    model = check(found, rows)
    assert {("rare",), ("rare", "phrase")} & model.kept
    row = next(r for r in found if r.doc_id == held)
    assert row.score > row.base_score + 6
