"""Line-first quality rules, in DataFrame functions only.

Each line is judged alone: it fails if it does not end as a sentence does, if it is
navigation, boilerplate or mostly symbols. Failing lines are removed; a document that
loses too much of its text with them is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import SPACES, let, words

#: Words of a repeated window; a document fails at so few words, or so many words of 100 in such windows.
WINDOW, FEWEST, REPEATED = 5, 10, 20
#: Of 100 characters of its lines with words, a document may lose so many.
LOSS = 50
#: Ends of a sentence, with closing marks behind them.
ENDS = r"""[.!?…:;]["'”’»)\]]*\z"""
#: Three separators that stand alone.
NAVIGATION = r"(?:^|\s)[|»›>·•/](?:\s(?:.*\s)?[|»›>·•/]){2}(?:\s|$)"
BOILERPLATE = (
    r"(?i)all rights reserved|cookie (?:policy|settings)|we use cookies|privacy policy|terms (?:of use|of service|and conditions)"
    r"|enable javascript|click here|sign (?:in|up)\b|log ?in\b|subscribe to|share (?:this|on)\b|read more|skip to (?:main )?content|powered by|lorem ipsum"
)
#: A line fails from so many symbols in 100 characters on.
SYMBOLS, SYMBOL_SHARE = "#*$%&|<>", 10


def _count_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


def repeat_words(tokens: Column) -> Column:
    """The words that stand in windows of WINDOW words found twice or more."""
    last = F.size(tokens) - F.lit(WINDOW)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + F.lit(k)) for k in range(WINDOW)]))

    def covered(g):
        # windows beside their equals, by a sort of (hash, place)
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda p: F.filter(p, lambda x, k: (x["h"] == F.get(p, k + F.lit(1))["h"]) | (F.when(k > 0, x["h"] == F.get(p, k - F.lit(1))["h"]).otherwise(F.lit(False)))),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places, start, lambda s, x: F.struct((x + F.lit(WINDOW)).alias("end"), (s["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), s["end"] - x)).alias("n")), lambda s: s["n"]
        )

    return let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def line_fails(line: Column) -> Column:
    """Whether a line with words fails a rule."""
    bare = F.btrim(line, F.lit(SPACES))
    symbols = _count_symbols(bare) * F.lit(100) >= F.char_length(bare) * F.lit(SYMBOL_SHARE)
    return ~bare.rlike(ENDS) | symbols | bare.rlike(NAVIGATION) | bare.rlike(BOILERPLATE)


def quality_rules(frame: DataFrame, text: str = "text") -> DataFrame:
    """frame with its base counts, verdicts and clean_text added, in place of columns so named.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: counts over the whole
    text. base_failed: fewer than FEWEST words, or over REPEATED of 100 words in windows
    of WINDOW words found twice or more. n_lines and n_removed: lines with words, and
    those that fail; n_lost: the characters of these. kept: not base_failed, and n_lost
    is at most LOSS of 100 characters of the lines with words. clean_text: the other
    lines, blank ones too. Null texts count as empty; repeated rows each get the same
    verdict; texts of any length are judged whole; columns may have any names. One
    narrow pass.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed", "n_lost", "clean_text"]
    rest = [c for c in frame.columns if c not in added]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(F.col("body"), "\n", -1)
    # foreign columns ride along in one struct, so their names cannot clash
    cut = frame.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"), body.alias("body"), words(F.col(text)).alias("words"))

    def has_word(line):
        return F.btrim(line, F.lit(SPACES)) != F.lit("")

    cut = cut.withColumn("lines", F.filter(lines, has_word))
    cut = cut.withColumn("stay", F.filter("lines", lambda line: ~line_fails(line)))
    counted = cut.select(
        "r",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_symbols(F.col("body")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_removed"),
        F.char_length(F.array_join("lines", "")).cast("long").alias("chars"),
        F.char_length(F.array_join("stay", "")).cast("long").alias("left"),
        F.array_join(F.filter(lines, lambda line: ~has_word(line) | ~line_fails(line)), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < FEWEST) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    judged = counted.withColumn("n_lost", F.col("chars") - F.col("left")).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost") * 100 <= F.col("chars") * LOSS))
    return judged.select(*[F.col(f"r.`{c}`").alias(c) for c in rest], *added)
