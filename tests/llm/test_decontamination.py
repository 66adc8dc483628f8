import itertools
import random

from postmill.llm import decontamination as d
from postmill.llm.registry import op5_decontamination


def plain(docs, items):
    """{(doc_id, item_id): most agreeing words}"""
    out = {}
    for (i, text), (j, item) in itertools.product(docs, items):
        a, b = (text or "").lower().split(), (item or "").lower().split()
        span = min(len(b), d.SPAN)
        need = d.NEED if len(b) >= d.SPAN else len(b) - (len(b) >= d.WHOLE)
        if not b or len(a) < span or not set(a) & set(b):
            continue
        for shift in range(-len(b), len(a)):
            same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
            if sum(same) >= need:
                low, high = max(0, -shift), min(len(b), len(a) - shift)
                most = max((sum(same[k : k + span]) for k in range(low, high - span + 1)), default=0)
                if most >= need:
                    out[i, j] = max(out.get((i, j), 0), most)
    return out


def test_masks_meet_every_tolerated_window():
    for span, wrong, masks in ((d.SPAN, d.SPAN - d.NEED, d.MASKS), *((n, 1, (d.SHORT,)) for n in range(d.WHOLE, d.SPAN))):
        for bad in itertools.combinations(range(span), wrong):
            assert any(not {i + o for o in m} & set(bad) for m in masks for i in range(span - m[-1])), (span, bad)


def corpus(seed=2):
    dice = random.Random(seed)
    word = lambda: dice.choice("abcdefgh") + str(dice.randint(0, 60))
    items = [(k, " ".join(word() for _ in range(dice.choice([2, 5, 7, 8, 10, 12, 13, 14, 27, 50])))) for k in range(40)]
    docs = []
    for i in range(200):
        words = [word() for _ in range(dice.randint(0, 120))]
        if i % 2:
            passage = dice.choice(items)[1].split()
            a = dice.randint(0, max(0, len(passage) - 13))
            passage = passage[a : a + dice.randint(8, 20)]
            for _ in range(dice.randint(0, 4)):
                passage[dice.randrange(len(passage))] = "other"
            at = dice.choice([0, len(words), dice.randint(0, len(words))])
            words[at:at] = passage
        docs.append((i, " ".join(words).replace(" a", "\n A")))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    a = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    want = plain(docs, items)
    found = {(r.doc_id, r.item_id): r.agreeing for r in d.leaks(a, b).collect()}
    assert found == want and len(want) > 30
    shuffled = d.leaks(a, b, broadcast_bytes=0)
    assert {(r.doc_id, r.item_id): r.agreeing for r in shuffled.collect()} == want
    kept = d.decontaminate(a, b)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want}) and kept.columns == a.columns


def test_short_items_match_whole(spark):
    a = spark.createDataFrame([(1, "so the seven words stand here as one thing"), (2, "seven words stood here as one thing"), (3, "Seven")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "Seven words stand here as one thing"), (1, "seven"), (8, "seven words stand here as one other thing")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.item_words, r.agreeing, r.at) for r in d.leaks(a, b).collect()}
    assert found == {(1, 7, 7, 7, 2), (1, 1, 1, 1, 2), (2, 1, 1, 1, 0), (3, 1, 1, 1, 0)}


def test_long_items_are_not_broadcast(spark):
    dice = random.Random(5)
    items = [(k, " ".join(f"{dice.randrange(1 << 30):x}" for _ in range(2000))) for k in range(250)]
    cut = lambda k, at, n: " ".join(items[k][1].split()[at : at + n])
    docs = [(k, f"some {cut(k, 7 * k, 15)} text") for k in range(250)] + [(900, items[3][1]), (901, "nothing")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    found = d.leaks(a, b)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "item_look" in plan and "item_hashes" not in plan
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(250)} | {(900, 3)}


def test_clashing_names_and_ids_of_any_kind(spark):
    item = " ".join(f"w{k}" for k in range(20))
    a = spark.createDataFrame([("a", item, 1, 2), ("b", "fine", 3, 4), (None, "", 5, 6)], "doc_id string, text string, leak int, r int")
    b = spark.createDataFrame([("i", item, 9)], "item_id string, text string, seed int")
    kept = d.decontaminate(a, b)
    assert kept.columns == a.columns and sorted(map(tuple, kept.collect()), key=str) == [("b", "fine", 3, 4), (None, "", 5, 6)]


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(None, item), (None, "clean"), (1, None), (1, item), (1, item), (2, ""), (3, "x " * 30000 + item + " y" * 30000)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (7, item), (8, None), (None, ""), (9, "the of and"), (10, "clean w1")], "item_id long, text string")
    found = d.leaks(a, b).collect()
    assert sorted((str(r.doc_id), r.item_id, r.item_words, r.agreeing, r.at) for r in found) == [("1", 7, 20, 13, 0), ("3", 7, 20, 13, 30000), ("None", 7, 20, 13, 0)]
    assert d.leaks(a.limit(0), b).count() == 0 and d.leaks(a, b.limit(0)).count() == 0
    assert [r.doc_id for r in d.decontaminate(a, b).collect()] == [2]


def test_whole_table(spark, sf_dir):
    rows = {t: [(r[0], r.text) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()] for t in ("documents", "benchmark")}
    found = {(r.doc_id, r.item_id): r.agreeing for r in op5_decontamination(spark, sf_dir).collect()}
    held = {(i, j) for i, text in rows["documents"] for j, item in rows["benchmark"] if item and " ".join(item.split()) in " ".join((text or "").split())}
    assert held <= set(found) and held
    assert found == plain(rows["documents"][:60], rows["benchmark"]) | {k: v for k, v in found.items() if k[0] not in {i for i, _ in rows["documents"][:60]}}
