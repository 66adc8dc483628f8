import random
import re
from collections import Counter

from postmill.llm import quality_rules as q
from postmill.llm.registry import op3_quality_rules

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed", "n_lost", "clean_text"]


def fails(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    symbols = sum(c in q.SYMBOLS for c in bare)
    return not re.search(q.ENDS.replace(r"\z", r"\Z"), bare) or symbols * 100 >= len(bare) * q.SYMBOL_SHARE or bool(re.search(q.NAVIGATION, bare, re.A) or re.search(q.BOILERPLATE, bare, re.A))


def plain(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = text.split("\n")
    full = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)})
    bad = [x for x in full if fails(x)]
    lost, chars = sum(map(len, bad)), sum(map(len, full))
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    clean = "\n".join(x for x in lines if x not in full or x not in bad)
    return len(words), sum(map(len, words)), sum(c in q.SYMBOLS for c in text), len(full) - len(set(full)), repeated, failed, not failed and lost * 100 <= chars * 50, len(full), len(bad), lost, clean


ODD = [
    None, "", " \n\t", "word", "a b c d e f g h i j k.", "a b c d e a b c d e a b c d e", "x " * 30000, "Home | About | News | More\nA sentence ends here.\nA sentence ends here.",
    "All Rights Reserved.\n" + "one two three four five six seven eight nine ten.", 'He said "so."\n\n  He went (home.)  \n', "é ü\x0bñ ##$ a*b <c> 100%.", "a / b / c / d / e f g h i j k l m.",
]


def texts():
    dice = random.Random(1)
    for _ in range(150):
        lines = [" ".join(dice.choice("abcd") for _ in range(dice.randint(0, 30))) + dice.choice([".", "", "!", " |", "?)", "%%"]) for _ in range(dice.randint(0, 8))]
        yield "\n".join(lines + lines[: dice.choice([0, 0, 3])])


def test_against_brute_force(spark):
    rows = [*ODD, *texts()]
    frame = spark.createDataFrame([(i, x, "mine", 1) for i, x in enumerate(rows)], "doc_id long, text string, kept string, extra int")
    found = {r.doc_id: r for r in q.quality_rules(frame).collect()}
    assert len(found) == len(rows) and "extra" in found[0]
    for i, x in enumerate(rows):
        assert tuple(found[i][n] for n in NAMES) == plain(x), x
    assert q.quality_rules(frame.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op3_quality_rules(spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r[n] for n in NAMES[:7]) == plain(rows[r.doc_id])[:7]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op3_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clashing_names(spark):
    names = ["body", "words", "lines", "stay", "chars", "left", "r", "_body", "_words"]
    frame = spark.createDataFrame([(1, "A line that ends.", *range(9))], ["doc_id", "text", *names])
    row = q.quality_rules(frame).first()
    assert [row[n] for n in names] == list(range(9)) and row.n_words == 4 and row.text == "A line that ends."
