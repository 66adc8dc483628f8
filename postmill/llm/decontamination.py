"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of the words at the selected positions of a fixed mask; the other
positions may differ. Test and training seeds are joined, and around each hit the two
texts are laid side by side: a window of SPAN words leaks if NEED of them agree. The two
masks below meet every window of 13 words with at most 2 substitutions, wherever these
are; SHORT meets every whole item of 8 to 12 words with at most 1, and shorter items are
met as a whole.

Seeds are joined without texts: a test seed is three numbers. A hit carries the LOOK
words of the document around it, hits of one stretch of an item are made one, and only
then the words of that stretch are joined. So no row holds more than LOOK words of an
item, however long items are, and what is broadcast is bounded in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import Scratch, let, words

SPAN, NEED = 13, 11
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: For items of WHOLE to SPAN - 1 words, all but one of which must agree; all words of shorter ones must.
SHORT, WHOLE = (0, 1, 2, 3), 8
#: Words of an item from SPAN - 1 before a stretch of SPAN words to SPAN - 1 behind it.
LOOK = 3 * SPAN - 2
#: Bytes that may be broadcast, and those that a seed and a stretch take there; what is more is joined by a shuffle.
BROADCAST_BYTES, SEED_BYTES, STRETCH_BYTES = 32 << 20, 64, 8 * LOOK + 120


def word_hashes(text: Column) -> Column:
    """The lower-cased words as 64-bit hashes."""
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    """The masks that meet items of so many words."""
    return MASKS if length >= SPAN else (SHORT,) if length >= WHOLE else (tuple(range(length)),)


def seeds(hashes: Column, mask: tuple[int, ...]) -> Column:
    """The seeds at each position where the mask fits, in order."""
    last = F.size(hashes) - F.lit(mask[-1] + 1)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(str(mask)), *[F.get(hashes, i + F.lit(o)) for o in mask]))


def _seeded(frame: DataFrame, masks, keep: list[str]) -> DataFrame:
    """keep, seed and at of each seed of frame (hashes, ...) by all masks."""
    listed = frame.withColumn("seeds", let(F.col("hashes"), lambda h: F.concat(*[seeds(h, m) for m in masks])))
    # outer: for an inner explode the optimizer adds a filter that computes all seeds once more
    dealt = listed.select(*keep, F.size("hashes").alias("length"), F.posexplode_outer("seeds").alias("place", "seed"))
    at, before = F.col("place"), F.lit(0)
    for mask in masks[:-1]:
        fits = F.greatest(F.col("length") - F.lit(mask[-1]), F.lit(0))
        before = before + fits
        at = F.when(F.col("place") >= before, F.col("place") - before).otherwise(at)
    return dealt.withColumn("at", at).drop("place", "length")


def _around(hashes: Column, first: Column) -> Column:
    """The LOOK words from the first on; null where there are none."""
    return F.transform(F.sequence(F.lit(0), F.lit(LOOK - 1)), lambda i: F.get(hashes, first + i))


def _agreeing() -> Column:
    """The most words that agree in a window of the item's span that lies in both texts; negative where none does."""
    span = F.least(F.col("item_words"), F.lit(SPAN))
    marks = F.zip_with("look", "item_look", lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(-100)).when(a == b, 1).otherwise(0))
    return let(
        marks,
        lambda m: F.array_max(F.transform(F.sequence(F.lit(1), F.lit(LOOK + 1) - span), lambda s: F.aggregate(F.slice(m, s, span), F.lit(0), lambda a, x: a + x))),
    )


def leaks(frame: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, agreeing, at) of each document and benchmark item of which it holds a passage.

    A passage is a window of SPAN words of the item of which NEED stand at the same
    places in the document; of an item of WHOLE to SPAN - 1 words it is the whole item,
    of which one word may differ, and of a shorter one the whole item as it is. Words
    are runs of other than white space, lower-cased. agreeing: the most words that agree
    in one window; at: the first word of the document where the item would begin (it may
    be negative). Null and empty texts, and items without words, leak nowhere. Ids may
    have any type. Rows of one doc_id, null included, are judged together, as are rows
    of one item_id; repeated rows change nothing. Texts of any length are read whole.
    """
    scratch = Scratch(frame.sparkSession)
    tests = items.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("hashes")).where(F.size("hashes") > 0)
    tests = tests.withColumn("item", F.xxhash64("hashes")).withColumn("item_words", F.size("hashes")).distinct()
    tests = scratch.write(tests, "items")
    lengths = sorted(r["n"] for r in tests.select(F.least("item_words", F.lit(SPAN)).alias("n")).distinct().collect())
    masks = list(dict.fromkeys(m for n in lengths for m in masks_of(n)))
    wanted = [F.when(F.least("item_words", F.lit(SPAN)).isin([n for n in lengths if m in masks_of(n)]), _placed(F.col("hashes"), m)).otherwise(F.array().cast("array<struct<seed:bigint,at:int>>")) for m in masks]
    empty = F.array().cast("array<struct<seed:bigint,at:int>>")
    asked = tests.select("item", F.explode(F.concat(empty, *wanted)).alias("s")).select("s.seed", "item", F.col("s.at").alias("item_at")).distinct()
    asked = scratch.write(asked, "seeds")
    stretch = F.sequence(F.lit(0), F.floor((F.col("item_words") - 1) / SPAN).cast("int"))
    looks = tests.select("item_id", "item", "item_words", "hashes", F.explode(stretch).alias("stretch"))
    looks = looks.select("item_id", "item", "item_words", "stretch", _around(F.col("hashes"), F.col("stretch") * SPAN - (SPAN - 1)).alias("item_look"))

    found = [(F.col("at") - F.col("item_at")).alias("start"), F.floor(F.col("item_at") / SPAN).cast("int").alias("stretch")]
    look = _around(F.col("hashes"), F.col("start") + F.col("stretch") * SPAN - (SPAN - 1)).alias("look")
    texts = frame.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), word_hashes(F.col(text)).alias("hashes"))
    if not masks:
        hits = texts.where(F.lit(False)).select("doc_id", F.lit(0).cast("long").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("stretch"), F.col("hashes").alias("look"))
    elif asked.count() * SEED_BYTES <= broadcast_bytes:
        hits = _seeded(texts, masks, ["doc_id", "hashes"]).join(F.broadcast(asked), "seed").select("doc_id", "hashes", "item", *found)
        hits = hits.select("doc_id", "item", "start", "stretch", look).distinct()
    else:  # only seeds are shuffled; the texts hit are read again
        where = _seeded(texts, masks, ["th"]).join(asked, "seed").select("th", "item", *found).distinct()
        hits = texts.join(where, "th").select("doc_id", "item", "start", "stretch", look).distinct()
    few = looks.count() * STRETCH_BYTES <= broadcast_bytes
    judged = hits.join(F.broadcast(looks) if few else looks, ["item", "stretch"]).select("doc_id", "item_id", "item_words", "start", _agreeing().alias("most"))
    need = F.when(F.col("item_words") >= SPAN, F.lit(NEED)).when(F.col("item_words") >= WHOLE, F.col("item_words") - 1).otherwise(F.col("item_words"))
    enough = F.col("most") >= need
    # the filter stands behind the aggregate: in front, it would become a condition of the join
    passages = judged.groupBy("doc_id", "item_id").agg(
        F.max(F.when(enough, F.col("item_words"))).cast("long").alias("item_words"),
        F.max(F.when(enough, F.col("most"))).cast("long").alias("agreeing"),
        F.min(F.when(enough, F.col("start"))).cast("long").alias("at"),
    )
    return passages.where(F.col("agreeing").isNotNull())


def _placed(hashes: Column, mask: tuple[int, ...]) -> Column:
    return F.transform(seeds(hashes, mask), lambda s, i: F.struct(s.alias("seed"), i.alias("at")))


def decontaminate(frame: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **names) -> DataFrame:
    """frame without the rows whose doc_id leaks a benchmark passage; see leaks. Columns may have any names."""
    scratch = Scratch(frame.sparkSession)
    found = scratch.write(leaks(frame, items, text, doc_id, **names).select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    found = F.broadcast(found) if found.count() * SEED_BYTES <= BROADCAST_BYTES else found
    packed = frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("r"))
    return packed.join(found, F.col(f"r.`{doc_id}`").eqNullSafe(F.col("leak")), "left_anti").select("r.*")
