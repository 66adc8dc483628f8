import random
import zlib

import pytest

from postmill.llm import toxicity as t
from postmill.llm.registry import op10_toxicity


def test_windows_hold_the_whole_text():
    text = "A bb  ccc\n" + "x" * 300 + " é end"
    cut = t.windows(text)
    assert b"".join(b"".join(w.split()) for w in cut) == "".join(text.split()).encode().lower()
    assert max(map(len, cut)) <= t.WINDOW + 2
    assert t.windows(None) == t.windows("") == [b"  "]


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "i", "or", "u")]
    word = lambda: "".join(dice.choices(syllables, k=dice.randint(1, 4)))
    bad, out = ["zounds", "knavewit", "quaxly"], []
    for i in range(900):
        words = [word() for _ in range(dice.randint(20, 400))]
        if toxic := i % 4 == 0:
            for _ in range(dice.randint(2, 5)):
                words.insert(dice.randrange(len(words)), dice.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark, rows):
    frame = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {r.doc_id: r for r in t.toxicity(frame, labels).collect()}
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [r for r in found.values() if r.held_out]
    hit = sum(r.predicted for r in held if truth[r.doc_id])
    wrong = sum(r.predicted for r in held if not truth[r.doc_id])
    assert hit >= 0.85 * sum(truth[r.doc_id] for r in held) and wrong <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)


def test_held_out_labels_are_not_learned(spark, rows):
    frame = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    a, b = (t.fit(frame, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in rows], turned))
    assert a == b


def test_copies_train_nothing():
    cut = t.windows("Several words that only copies hold " * 5)
    seen = set()
    assert not t._is_copy(cut, seen) and t._is_copy(cut, seen)


def test_nulls_repeats_and_no_labels(spark):
    frame = spark.createDataFrame([(1, None, 3.0), (1, "", 3.0), (None, "a", 3.0), (2, "y" * 20000, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.toxicity(frame, none).where("predicted = 0 and score between 0 and 1").count() == 4
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert t.toxicity(frame, odd).count() == 4
    assert t.toxicity(frame.limit(0), odd).count() == 0


def test_dictionaries_are_trained_on_the_classes(rows, monkeypatch):
    calls, plain = [], t.zstandard.train_dictionary
    monkeypatch.setattr(t.zstandard, "train_dictionary", lambda size, samples, **how: calls.append((size, samples)) or plain(size, samples, **how))
    sample = [(t.windows(x), y) for _, x, y in rows]
    frequent, ordinary, toxic = t.train(sample)
    assert [size for size, _ in calls] == [t.FREQUENT, t.OWN, t.OWN] and len(ordinary) == len(toxic) == t.OWN
    toxic_windows = {w for cut, y in sample if y for w in cut}
    assert set(calls[2][1]) <= toxic_windows and not toxic_windows & {*calls[0][1], *calls[1][1]} and not {*calls[0][1]} & {*calls[1][1]}
    few = t.train([([b" a "], 1), ([b" b "], 0)])
    assert few == (b" b ", b"", b" a ")


def test_rare_words_with_many_endings_are_learned():
    """Each occurs once in a text, among words that every text repeats."""
    dice = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "i", "or", "u")]
    common = ["".join(dice.choices(syllables, k=dice.randint(1, 3))) for _ in range(150)]
    stems, sample = ["vequ", "lowei", "chlla", "jyxo"], []
    for i in range(900):
        words = [dice.choice(common) if dice.random() < 0.7 else "".join(dice.choices(syllables, k=4)) for _ in range(200)]
        if toxic := i % 3 == 0:
            for stem in dice.sample(stems, 2):
                words.insert(dice.randrange(len(words)), stem + "".join(dice.choices(syllables, k=2)))
        sample.append((t.windows(" ".join(words)), int(toxic)))
    contents = t.train(sample[:600])
    assert all(stem.encode() in contents[2] and stem.encode() not in contents[1] for stem in stems)
    distance = t.Distance(*contents)
    score = {y: [sum(distance.features(cut)[:2]) for cut, z in sample[600:] if z == y] for y in (0, 1)}
    above = sorted(score[0])[int(0.95 * len(score[0]))]
    assert sum(x > above for x in score[1]) >= 0.7 * len(score[1])


def test_words_among_frequent_pieces_are_caught(spark):
    """Texts of few syllables, whose pieces are far more frequent than any word that tells the classes apart."""
    dice = random.Random(11)
    syllables = "the ing and ion er ed th an re on at en nd st es or ti ha ou it wh ea ly ble".split()
    bad = "zoundsel knavewit quaxly grumblefop mufkin dolzard pluvic vrackish jobbernol skwim gorbelly puttock maggotpy flapjaw cumberwo druxyk".split()
    texts = []
    for i in range(1800):
        words = ["".join(dice.choices(syllables, k=dice.randint(1, 5))) for _ in range(dice.randint(60, 400))]
        if toxic := i % 3 == 0:
            for word in dice.choices(dice.sample(bad, 2), k=2 + len(words) // 60):
                words.insert(dice.randrange(len(words)), word)
        texts.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame([(i, x) for i, x, _ in texts], "doc_id long, text string")
    found = t.toxicity(frame, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")).where("held_out").collect()
    caught, wrong = ([r.predicted for r in found if texts[r.doc_id][2] == y] for y in (1, 0))
    assert len(caught) > 100 and sum(caught) >= 0.93 * len(caught) and sum(wrong) <= 0.03 * len(wrong)


def test_separation():
    rows = [([3.0, 1.0, 0.0, 9.0], 1), ([1.0, 0.0, 0.0, 0.0], 1), ([2.0, -1.0, 0.0, 5.0], 0), ([0.0, 0.0, 0.0, 9.0], 0)]
    assert t.separation(rows) == (2 + 1.5) / 4
    assert t.separation(rows[:2]) == t.separation([]) == 0.5


def test_whole_table_against_brute_force(spark, sf_dir):
    found = {r.doc_id: r for r in op10_toxicity(spark, sf_dir).collect()}
    documents, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    (frequent, ordinary, toxic), weights = t.pickle.loads(t.fit(documents, labels))
    how = t.zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=17, search_log=6, min_match=4, strategy=t.zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
    )

    def size(content, window):  # a compressor of its own for each window
        held = t.zstandard.ZstdCompressionDict(content, dict_type=t.zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return len(t.zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(window))

    rows = documents.collect()
    assert len(found) == len(rows)
    for r in rows[::25]:
        cut = t.windows(r.text)
        best = [*sorted((size(ordinary + frequent, w) - size(toxic + frequent, w) for w in cut), reverse=True)[:3], 0, 0]
        z = sum(a * b for a, b in zip([*best[:3], t.math.log(len(cut)), 1.0], weights, strict=True))
        assert found[r.doc_id].score == pytest.approx(1 / (1 + t.math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert found[r.doc_id].predicted == (found[r.doc_id].score >= 0.3)


def test_names_and_ids_of_any_kind(spark, rows):
    ids = [(f"d{i}", x, "mine", 7.0) for i, x, _ in rows[:120]]
    frame = spark.createDataFrame(ids, "doc_id string, text string, t string, score double")
    labels = spark.createDataFrame([(f"d{i}", y, 0) for i, _, y in rows[:120]], "doc_id string, toxic int, t int")
    found = t.toxicity(frame, labels)
    assert found.columns == ["doc_id", "text", "t", "held_out", "score", "predicted"]
    assert sorted((r.doc_id, r.text, r.t) for r in found.collect()) == sorted(x[:3] for x in ids)
    assert t.toxicity(frame, labels, toxic_docs=5, ordinary_docs=5).count() == 120


def test_calibration_sees_all_windows_of_long_texts(spark, rows, monkeypatch):
    long = [(i, " ".join([x] * 60) if i % 5 == 0 and not y else x, y) for i, x, y in rows]
    frame = spark.createDataFrame([(i, x) for i, x, _ in long], "doc_id long, text string").repartition(2)
    seen, plain = [], t.calibrate
    monkeypatch.setattr(t, "calibrate", lambda found: seen.extend(found) or plain(found))
    contents, _ = t.pickle.loads(t.fit(frame, spark.createDataFrame([(i, y) for i, _, y in long], "doc_id long, toxic int")))
    distance = t.Distance(*contents)
    whole = {tuple(distance.features(t.windows(x))) for _, x, _ in long}
    assert any(f[3] > 6 for f, _, _ in seen) and {tuple(f) for f, _, _ in seen} <= whole
