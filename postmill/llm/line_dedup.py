"""Line dedup by a sharded minimal perfect hash over the hashes of all distinct lines.

The 128-bit hashes of distinct lines are dealt into shards; each shard becomes a minimal
perfect hash (levels of bits, each key at its first level without a collision; the rank
of its bit is its number) over arrays of 64-bit fingerprints, document counts and keeping
documents. Documents probe these arrays: the hashes of their lines, never the lines, are
sent to where a shard lies, and come back only for lines that go. A shard that many
lines ask is lent to several tasks, each of which answers a part of them. So no task or
driver ever holds more than a shard of the index.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import Scratch, lean, small_batches

#: Lines of a shard on average, and those that one task answers at once.
SHARD_LINES = 50_000
#: Bytes of decisions that may be broadcast to the texts; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Shards lent to several tasks whose list may be broadcast (16 bytes each).
BROADCAST_ROWS = 500_000
#: Bits of a level for each key that reaches it.
ROOM = 2


def key_of(line: str, least: int) -> bytes | None:
    """The line without outer white space, A-Z lower-cased, as UTF-8; None if under least code points."""
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return stripped.encode().lower() if len(stripped) >= least else None


def digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64)
    return pairs[0::2], pairs[1::2]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _level(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    return _mix(high ^ _mix(low + np.uint64(level + 1)))


def build(high: np.ndarray, low: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> tuple:
    """(level sizes, words, fingerprints, counts, keepers) of a shard with distinct keys (high, low)."""
    left, sizes, words, order = np.arange(len(high)), [], [], []
    while len(left):
        size = -(-max(64, ROOM * len(left)) // 64) * 64
        at = (_level(high[left], low[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        bits = np.zeros(size, np.uint8)
        bits[at[placed]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(left[placed][np.argsort(at[placed])])
        sizes.append(size)
        left = left[~placed]
    order = np.concatenate(order) if order else left
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64), low[order], counts[order], keepers[order]


class Shard:
    """One perfect hash and its arrays."""

    def __init__(self, made: tuple):
        sizes, self.words, self.prints, self.counts, self.keepers = made
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and their numbers."""
        number = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=True)):
            at = (_level(high[left], low[left], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            number[left[hit]] = self.ranks[at[hit] >> 6] + below
            left = left[~hit]
        held = number >= 0
        held[held] = self.prints[number[held]] == low[held]
        return held, number


def line_hashes(frame: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(high, low, doc_id, th, k) of each line, the k-th of its text, whose key has least code points at least."""

    def run(batches):
        for batch in batches:
            keys, row, place = [], [], []
            for d, body in enumerate(batch.column(0).to_pylist()):
                for k, line in enumerate((body or "").split("\n")):
                    if key := key_of(line, least):
                        keys.append(key)
                        row.append(d)
                        place.append(k)
            high, low = digests(keys)
            rows = pa.array(row, pa.int64())
            columns = [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "doc_id", "th", "k"])

    return frame.select(F.col(text), F.col(doc_id).cast("long"), F.xxhash64(F.col(text))).mapInArrow(lean(run), "high long, low long, doc_id long, th long, k int")


def line_dedup(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 40, holders: int = 5) -> DataFrame:
    """frame with text replaced by the lines that stay, and n_lines and n_dropped added (in place of columns so named).

    A line's key is the line without outer white space, A-Z lower-cased. Keys of at
    least least code points in at least holders distinct documents lose all their lines
    except in the largest doc_id holding them. Null and empty texts are one empty line
    and stay as an empty text. Rows of one doc_id are one document and keep or lose
    their lines alike; rows with a null doc_id never keep and do not count as holders.
    doc_id is a whole number, or what casts to one. Texts of any length are read whole.
    """
    spark = frame.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    lines = scratch.write(line_hashes(frame, text, doc_id, least), "lines")
    total = max(1, -(-lines.count() // SHARD_LINES))
    high = F.col("high")
    shard_of = F.when(high >= 0, high % total).otherwise(F.pmod(F.pmod(high, F.lit(total)) + F.lit((1 << 64) % total), F.lit(total)))
    lines = lines.withColumn("shard", shard_of)
    # shards that get far more lines than others, and the tasks that each is lent to
    hot = scratch.write(lines.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD_LINES).select("shard", F.ceil(F.col("n") / SHARD_LINES).alias("lent")), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot

    def made(table):
        columns = {c: table.column(c).to_numpy() for c in ("high", "low", "n_docs", "keeper")}
        shard = build(columns["high"].view(np.uint64), columns["low"].view(np.uint64), np.minimum(columns["n_docs"], 2**32 - 1).astype(np.uint32), columns["keeper"])
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps(shard)], pa.binary())})

    # a document in several rows is one document; both steps combine before they shuffle
    once = lines.groupBy("shard", "high", "low", "doc_id").agg(F.count("*").alias("rows"))
    keys = once.groupBy("shard", "high", "low").agg(F.count("doc_id").alias("n_docs"), F.coalesce(F.max("doc_id"), F.lit(0).cast("long")).alias("keeper"))
    shards = scratch.write(keys.groupBy("shard").applyInArrow(made, "shard long, blob binary"), "shards")

    def answered(asked: pa.Table, index: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked.select(["doc_id", "th", "k"])
        shard = Shard(pickle.loads(index["blob"][0].as_py()))
        held, number = shard.probe(*(asked[c].to_numpy().view(np.uint64) for c in ("high", "low")))
        own = asked["doc_id"].is_null().to_numpy(zero_copy_only=False), asked["doc_id"].fill_null(0).to_numpy()
        many, keeper = np.zeros(len(held), bool), np.zeros(len(held), np.int64)
        many[held] = shard.counts[number[held]] >= holders
        keeper[held] = shard.keepers[number[held]]
        return asked.select(["doc_id", "th", "k"]).filter(pa.array(many & (own[0] | (own[1] != keeper))))

    lent = F.coalesce("lent", F.lit(1))
    asked = lines.join(hot, "shard", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "th", "k"), lent)).select("shard", "part", "high", "low", "doc_id", "th", "k")
    index = shards.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), lent - 1)).alias("part"), "blob")
    gone = asked.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(answered, "doc_id long, th long, k int")
    gone = scratch.write(gone.groupBy("doc_id", "th").agg(F.collect_set("k").alias("ks")), "gone")  # a text's lines at most
    size = gone.agg(F.sum(F.size("ks") * 4 + 64)).first()[0] or 0
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "ks")
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    added = ("n_lines", "n_dropped")
    rest = [c for c in frame.columns if c not in (*added, text)]
    packed = frame.select(F.col(text).alias("t"), F.col(doc_id).cast("long").alias("i"), F.xxhash64(F.col(text)).alias("th"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))
    packed = packed.join(gone, F.col("i").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left").select("t", "ks", "r")
    schema = packed.select("r", "t").schema.add("n_lines", "long").add("n_dropped", "long")

    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for body, ks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body, out = body or "", set(ks or ())
                texts.append("\n".join([x for k, x in enumerate(body.split("\n")) if k not in out]) if out else body)
                n_lines.append(body.count("\n") + 1)
                n_dropped.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["r", "t", *added])

    done = packed.mapInArrow(lean(run), schema)
    columns = [F.col("t").alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in frame.columns if c not in added]
    return done.select(*columns, *added)
