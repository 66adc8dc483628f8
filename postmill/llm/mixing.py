"""Mixing sources to target weights by pivotal dependent rounding.

A document's copies are a whole part, the same for its source, and a fractional part
that is rounded. Two documents of a source with fractions p and q and sizes s and t give
each other mass, s*dp = -t*dq, until one of them is 0 or 1; which of them gains is drawn
so that no fraction changes in expectation. So the words that a source takes stay as
they were at every step, and one document is left over. Groups of documents leave one
residual a source; residuals meet again in a reduction tree until one is left.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import SPACES, Scratch, lean, small_batches

#: Documents that one group of the tree takes in, on average; residuals of a source that may meet in one.
GROUP, MEET = 50_000, 1_000_000
#: Rows of the mix that may be broadcast to its texts (60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Sources that may be ranked by one task and broadcast to their documents (100 bytes each); beyond, a document's source is
#: looked up by a shuffle, salted so that a hot source is dealt over SALTS groups.
BROADCAST_SOURCES, SALTS = 100_000, 32
#: No source's target is above so many times its size.
MOST = 3


def size_of(text: Column) -> Column:
    """Words of a text: blank characters become one kind, and starts of words are counted."""
    return F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)) == "", F.lit(0)).otherwise(
        F.size(F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    ).cast("long")


def ranked(sources: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """sources (source, source_size; count rows) with place, counting from 0 in the order of code points, null last."""
    order = F.col("source").asc_nulls_last()
    if count <= BROADCAST_SOURCES:
        return sources.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)
    ranged = scratch.write(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranged")
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = sources.sparkSession.createDataFrame(offsets, "part int, before long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("nth", nth).join(F.broadcast(offsets), "part").select("source", "source_size", (F.col("before") + F.col("nth")).alias("place"))


def targets(sizes: DataFrame, scratch: Scratch, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) of each source of sizes (source, size).

    Sources in the order of their code points, null last, get the weights in turn. A
    target above most times its source's size stops there, and the excess is shared out
    by weight again until none is above. The table has one row a source; it stays a
    DataFrame, and only sums reach the driver.
    """
    totals = scratch.write(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    places = ranked(totals, totals.count(), scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = scratch.write(places.select("source", "source_size", weight.alias("weight")), "sources")
    share = 0.0
    while True:  # each round stops at least one more source, or ends
        full = F.col("weight") * share > most * F.col("source_size")
        total, stopped, weight_left = table.agg(
            F.sum("source_size").cast("double"),
            F.sum(F.when(full, most * F.col("source_size"))).cast("double"),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        following = ((total or 0.0) - (stopped or 0.0)) / weight_left if weight_left else share
        if following <= share:
            break
        share = following
    return table.select("source", "source_size", F.least(F.col("weight") * share, (most * F.col("source_size")).cast("double")).alias("target"))


def _draw(seed: int, *key) -> float:
    return xxhash.xxh64_intdigest(repr(key).encode(), seed) / 2**64


def _settle(rows, seed: int, level: int):
    """(row, fraction) of rows (key, group, size, fraction) as each is done, in the order given.

    The last of each group that is still fractional comes with its fraction.
    """
    held = {}
    for row, group, size, p in rows:
        if p <= 0 or p >= 1 or size <= 0:
            yield row, group, size, min(1.0, max(0.0, p)) if size > 0 else 0.0
            continue
        if group not in held:
            held[group] = (row, size, p)
            continue
        other, other_size, q = held.pop(group)
        # words that can move to the one, or from it
        up = min((1 - q) * other_size, p * size)
        down = min(q * other_size, (1 - p) * size)
        move = up if _draw(seed, level, row, other) * (up + down) < down else -down
        p, q = p - move / size, q + move / other_size
        p, q = (x if 1e-12 < x < 1 - 1e-12 else float(round(x)) for x in (p, q))
        if 0 < q < 1:
            held[group] = (other, other_size, q)
        else:
            yield other, group, other_size, q
        if 0 < p < 1:
            if group in held:  # both fractional by rounding errors only: round the smaller
                yield row, group, size, float(round(p))
            else:
                held[group] = (row, size, p)
        else:
            yield row, group, size, p
    for group, (row, size, p) in held.items():
        yield row, group, size, p


def pivotal(frame: DataFrame, scratch: Scratch, seed: int = 1, group: int = GROUP) -> DataFrame:
    """(key, source, size, up) for rows (key long, source string, size long, fraction double); up is 0 or 1.

    Groups are ranges of a hash of the key with no regard to the source, so a hot source
    is dealt over all of them; a task keeps one residual a source. A level leaves at most
    one row a group and source. Once no source has more residuals than MEET, those of a
    source meet in one group; many sources are many groups.
    """
    schema = "key long, source string, size long, fraction double, done boolean"
    done, level, rows = None, 0, frame.select("key", "source", "size", "fraction")
    count = frame.count()
    while True:
        groups = max(1, -(-count // group))
        most = rows.groupBy("source").count().agg(F.max("count")).first()[0] if level and groups > 1 else None
        last = groups == 1 or (most is not None and most <= MEET)
        by = [F.col("key"), F.lit(level)] if most is None or not last else [F.coalesce("source", F.lit("")), F.col("source").isNull()]
        spread = F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int")
        dealt = rows.withColumn("spread", spread).repartition(groups, "spread")
        dealt = dealt.sortWithinPartitions("spread", F.xxhash64("key", F.lit(seed)), "key").drop("spread")

        def run(batches, level=level, last=last):
            def stream():
                for batch in batches:
                    yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

            made = []

            def packed():
                keys, sources, sizes, fractions = zip(*made, strict=True)
                open_ = [0 < p < 1 and not last for p in fractions]
                # what is left at the root is drawn
                fractions = [float(_draw(seed, "root", k) < p) if 0 < p < 1 and last else p for k, p in zip(keys, fractions, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sources, pa.string()), pa.array(sizes, pa.int64()), pa.array(fractions, pa.float64()), pa.array([not x for x in open_])], names=["key", "source", "size", "fraction", "done"])

            for x in _settle(((k, s, n, p) for k, s, n, p in stream()), seed, level):
                made.append(x)
                if len(made) >= 20_000:
                    yield packed()
                    made.clear()
            if made:
                yield packed()

        settled = scratch.write(dealt.mapInArrow(lean(run), schema), f"level-{level}")
        part = settled.where("done").select("key", "source", "size", F.col("fraction").cast("long").alias("up"))
        done = part if done is None else done.union(part)
        rows = settled.where("not done").select("key", "source", "size", "fraction")
        count, level = 0 if last else rows.count(), level + 1
        if count == 0:
            return done


def mix(frame: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=(1, 2, 3), seed: int = 1, keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of frame.

    Size: words of the text (null: 0). copies * size words are taken of a document,
    never over MOST times its size; a source's taken words differ from its target by
    less than the size of one of its documents. Documents without words take nothing.
    Null sources are a source, the last. Rows of one doc_id are documents of their own;
    ids may have any type, columns any names. Texts of any length are counted whole.
    keep: with all other columns of frame. The draws depend on seed, doc_id, size and
    text alone, so reruns agree however the table is partitioned.
    """
    small_batches(frame.sparkSession)
    scratch = Scratch(frame.sparkSession)
    base = frame.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("of"))
    # rows that agree in all of this are as good as each other; they get numbers of their own
    same = Window.partitionBy("doc_id", "source", "of", "size").orderBy("doc_id")
    numbered = base.withColumn("nth", F.row_number().over(same))
    numbered = scratch.write(numbered.withColumn("key", F.xxhash64("doc_id", "source", "of", "nth")), "sizes")
    shares = targets(numbered, scratch, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = scratch.write(shares, "shares").withColumnRenamed("source", "of_source")
    agree = F.col("source").eqNullSafe(F.col("of_source"))
    if shares.count() <= BROADCAST_SOURCES:
        rated = numbered.join(F.broadcast(shares), agree)
    else:
        shares = shares.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = numbered.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(shares, agree & (F.col("salt") == F.col("of_salt"))).drop("salt", "of_salt")
    rated = rated.drop("of_source").withColumn("rate", rate)
    rated = rated.withColumn("whole", F.floor("rate"))
    asked = rated.select("key", "source", "size", (F.col("rate") - F.col("whole")).alias("fraction"))
    rounded = pivotal(asked, scratch, seed)
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("up"), F.lit(MOST).cast("long"))).otherwise(F.lit(0).cast("long"))
    # of documents whose keys collide, source and size tell the rows apart
    rounded = rounded.select("key", F.col("source").alias("_s"), F.col("size").alias("_n"), "up")
    mixed = rated.join(rounded, (rated["key"] == rounded["key"]) & rated["source"].eqNullSafe(rounded["_s"]) & (rated["size"] == rounded["_n"]))
    mixed = mixed.withColumn("copies", copies)
    found = ["size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"]
    if not keep:
        return mixed.select("doc_id", *found)
    rest = [c for c in frame.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    mixed = mixed.select(*[F.col(c).alias(f"m_{c}") for c in ("doc_id", "source", "of", "nth")], *found)
    mixed = scratch.write(mixed, "mixed")
    count, most = mixed.agg(F.count("*"), F.max("m_nth")).first()
    # foreign columns ride along in one struct, so their names cannot clash
    whole = frame.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"), F.xxhash64(F.col(text)).alias("of"), F.col(doc_id).alias("i"), F.col(source).alias("s"))
    if (most or 1) > 1:  # only then are rows numbered, which moves their texts once more
        whole = whole.withColumn("nth", F.row_number().over(Window.partitionBy("i", "s", "of").orderBy("i")))
    else:
        whole = whole.withColumn("nth", F.lit(1))
    agree = F.col("i").eqNullSafe(F.col("m_doc_id")) & F.col("s").eqNullSafe(F.col("m_source")) & (F.col("of") == F.col("m_of")) & (F.col("nth") == F.col("m_nth"))
    joined = whole.join(F.broadcast(mixed) if count <= BROADCAST_ROWS else mixed, agree)
    return joined.select(*[F.col(f"r.`{c}`").alias(c) for c in rest], *found)
