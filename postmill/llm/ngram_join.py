"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of its word five-grams, a 128-bit digest of the set, MinHash
   minima, band hashes and a sketch (one byte a minimum). Texts with one set are one node.
2. Nodes are shuffled on their band hashes. In a bucket, sketches decide which nodes may
   be alike, and a spanning forest of those pairs leaves it, never all pairs. In a large
   bucket all nodes are first compared with one of them, its leader, without a shuffle of
   the bucket; only those unlike the leader are compared with the others.
3. The forests' components are sent their full sets once, and every pair in a component
   is verified on the full sets. The Jaccard distance is a metric, so distances to one
   leader settle most pairs; only the others are intersected. Links are counted there,
   and a spanning forest of them gives the classes.

Buckets and components of any size are cut into blocks by a hash of the node; a task
holds two blocks, and each pair of blocks is one group. So no pair is lost and no group
is gathered whole.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import SPACES, Scratch, components, lean, small_batches

#: Words of a shingle, the similarity that links, and the recall that banding must reach there.
WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.998, 6
#: Buckets of more nodes get a leader; nodes of a block of these, and nodes and shingles of a block of a component.
LEADER_FROM, BUCKET_BLOCK, BLOCK_NODES, BLOCK_SHINGLES = 128, 1024, 512, 2_000_000
#: Standard errors below the similarity at which sketches give a pair up.
ERRORS = 5.0
#: Nodes whose ids may be broadcast (16 bytes each, and overhead), and leaders (200 bytes each); more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_LEADERS = 500_000, 100_000
#: Bytes of text that one vectorised step takes in, unless one text is longer.
STEP = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of rows minima that a pair of the similarity shares one of with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _UNBASE)]))
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts' first word numbers and their total) of the words of texts in UTF-8 that begin at starts (sorted)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts) + 1, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.zeros(n + 1, bool)
    fresh[starts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | fresh[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | fresh[1:n]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    up, down = _powers.get(n + 1)
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = _mix((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, np.append(starts, n))


def shingle_sets(column: pa.Array, words: int = WORDS):
    """The sorted distinct shingle hashes of each text; texts of fewer words have one shingle, those without words none."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        hashes, at = word_hashes(part, np.minimum(offsets[i:j] - offsets[i], len(part)))
        grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            grams = grams * _BASE + hashes[k : k + len(grams)]
        grams = _mix(grams)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = _mix(whole * _BASE + hashes[k : k + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)
        i = j


class MinHash:
    def __init__(self, n_bands: int, rows: int = ROWS, seed: int = 11):
        dice = np.random.default_rng(seed)
        self.bands, self.rows = n_bands, rows
        self.a = dice.integers(1, 1 << 63, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = dice.integers(0, 1 << 63, n_bands * rows, dtype=np.uint64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row a set; sets must not be empty."""
        flat = np.concatenate(sets)
        at = np.cumsum([0, *map(len, sets[:-1])])
        return np.stack([np.minimum.reduceat(flat * a + b, at) for a, b in zip(self.a, self.b, strict=True)], axis=1)

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        parts = minima.reshape(len(minima), self.bands, self.rows)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2])
        for k in range(self.rows):
            out = _mix(out * _BASE + parts[:, :, k])
        return out

    def sketches(self, minima: np.ndarray) -> np.ndarray:
        return (_mix(minima) & np.uint64(255)).astype(np.uint8)


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _binary(rows, size: int) -> pa.Array:
    data = b"".join(rows)
    return pa.Array.from_buffers(pa.binary(size), len(data) // size if size else 0, [None, pa.py_buffer(data)]).cast(pa.binary())


def signatures(frame: DataFrame, minhash: MinHash) -> DataFrame:
    """(doc_id, th, node, n, sketch, bands) of frame (text, doc_id, th); node is null where there are no shingles."""

    def run(batches):
        for batch in batches:
            keep, sets, held = [], [], 0
            names = ["doc_id", "th", "node", "n", "sketch", "bands"]

            def packed(batch=batch):
                rows = pa.array(keep, pa.int64())
                full = [s for s in sets if len(s)]
                minima = minhash.minima(full) if full else np.zeros((0, len(minhash.a)), np.uint64)
                sketches, keys = iter(minhash.sketches(minima)), iter(minhash.band_hashes(minima).view(np.int64))
                columns = [batch.column(k).take(rows) for k in (1, 2)]
                columns.append(pa.array([digest(s) if len(s) else None for s in sets], pa.binary()))
                columns.append(pa.array([len(s) for s in sets], pa.int64()))
                columns.append(pa.array([next(sketches).tobytes() if len(s) else None for s in sets], pa.binary()))
                columns.append(pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())))
                return pa.RecordBatch.from_arrays(columns, names=names)

            for k, s in enumerate(shingle_sets(batch.column(0))):
                keep.append(k)
                sets.append(s)
                held += len(s)
                if held > 300_000:
                    yield packed()
                    keep, sets, held = [], [], 0
            if keep:
                yield packed()

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.select("text", "doc_id", "th").mapInArrow(lean(run), f"doc_id {kind}, th long, node binary, n long, sketch binary, bands array<long>")


def _groups(batches, n_keys: int):
    """Tables of the rows that agree in the first n_keys columns; the rows come sorted by these, batches cut anywhere."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = pa.Table.from_batches([batch])
        found = found if rest is None else pa.concat_tables([rest, found])
        change = np.zeros(found.num_rows - 1, bool)
        for k in range(n_keys):
            column = found.column(k).combine_chunks()
            change |= np.asarray(pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), bool)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield found.slice(a, b - a)
        rest = found.slice(cuts[-1]).combine_chunks()
    if rest is not None:
        yield rest


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def alike(sketches: np.ndarray, sizes: np.ndarray, least: float, similarity: float, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches agree in a share of least and whose sizes allow the similarity.

    joined: nodes that are connected already, behind all others; no pair of theirs is made.
    """
    n, made = len(sizes), []
    label = np.arange(n)
    last = n - 1
    if joined is not None and joined.any():
        last = n - int(joined.sum())
        label[joined] = last
    for i in range(last):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1  # pairs that are connected already add nothing
        fits = np.minimum(sizes[other], sizes[i]) >= similarity * np.maximum(sizes[other], sizes[i]) - 1e-9
        other = other[fits]
        if not len(other):
            continue
        share = (sketches[other] == sketches[i]).mean(axis=1)
        for j in other[share >= least].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                made.append((i, j))
    return made


def _blocks(rows: DataFrame, key: str, blocks) -> DataFrame:
    """rows once for each pair of blocks that its block is in, with the pair (i, j) and its block."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def candidates(nodes: DataFrame, scratch: Scratch, similarity: float, n_minima: int) -> DataFrame:
    """Edges (a, b) between nodes that share a band and may be alike: what connects each bucket's alike nodes."""
    least = similarity - ERRORS * math.sqrt(similarity * (1 - similarity) / n_minima)
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = scratch.write(spread.groupBy("band").agg(F.count("*").alias("m"), F.min("node").alias("leader")).where("m > 1"), "buckets")
    drawn = nodes.select("node", "n", "sketch")

    def edges(pairs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def matrix(column) -> np.ndarray:
        rows = column.to_pylist()
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)

    def forest(batches):
        # groups (band, i, j) of (node, n, sketch, near), those alike to the leader behind the others
        made = []
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            names, near = group.column(3).to_pylist(), group.column(6).to_numpy()
            pairs = alike(matrix(group.column(5)), group.column(4).to_numpy(), least, similarity, near)
            made += [(names[i], names[j]) for i, j in pairs]
            if len(made) > 10_000:
                yield edges(made)
                made = []
        yield edges(made)

    def compared(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, other = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            near = (np.minimum(sizes, other) >= similarity * np.maximum(sizes, other) - 1e-9) & ((matrix(batch.column(3)) == matrix(batch.column(6))).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(near)], names=["band", "node", "leader", "near"])

    order = ["band", "i", "j"]
    small = spread.join(shared.where(F.col("m") <= LEADER_FROM).select("band"), "band").join(drawn, "node")
    small = small.select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "n", "sketch", F.lit(False).alias("near"))
    found = small.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(forest), "a binary, b binary")
    large = shared.where(F.col("m") > LEADER_FROM)
    n_large = large.count()
    if n_large:
        leaders = large.join(drawn, large["leader"] == drawn["node"]).select("band", "leader", F.col("n").alias("leader_n"), F.col("sketch").alias("leader_sketch"))
        leaders = F.broadcast(leaders) if n_large <= BROADCAST_LEADERS else leaders
        members = nodes.select("node", "n", "sketch", F.explode("bands").alias("band")).join(leaders, "band")
        members = members.select("band", "node", "n", "sketch", "leader", "leader_n", "leader_sketch").mapInArrow(lean(compared), "band long, node binary, leader binary, near boolean")
        members = scratch.write(members, "compared")
        found = found.union(members.where("near and node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        apart = members.groupBy("band").agg(F.count_if(~F.col("near")).alias("r"), F.count("*").alias("m")).where("r > 0")
        # blocks of those unlike the leader meet each other and the blocks of those like it
        rest, like = F.ceil(F.col("r") / BUCKET_BLOCK).cast("int"), F.ceil((F.col("m") - F.col("r")) / BUCKET_BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("like")).otherwise(F.col("rest"))).cast("int")
        dealt = members.join(apart.select("band", rest.alias("rest"), like.alias("like")), "band").withColumn("own", own)
        others = F.sequence(F.lit(0), F.when(F.col("near"), F.col("rest")).otherwise(F.col("rest") + F.col("like")) - 1)
        dealt = dealt.withColumn("other", F.explode(others))
        # i: a block of the rest; j: one of the rest from i on, or rest + a block of the others
        i = F.when(F.col("near") | (F.col("other") >= F.col("rest")), F.when(F.col("near"), F.col("other")).otherwise(F.col("own"))).otherwise(F.least("own", "other"))
        j = F.when(F.col("near"), F.col("rest") + F.col("own")).when(F.col("other") >= F.col("rest"), F.col("other")).otherwise(F.greatest("own", "other"))
        dealt = dealt.select("band", i.alias("i"), j.alias("j"), "node", "near").join(drawn, "node").select("band", "i", "j", "node", "n", "sketch", "near")
        dealt = dealt.repartition(*order).sortWithinPartitions(*order, "near")
        found = found.union(dealt.mapInArrow(lean(forest), "a binary, b binary"))
    return found.distinct()


def verify(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, cross: bool, similarity: Fraction) -> tuple[np.ndarray, list[int]]:
    """(links, roots) of nodes: the copies of those linked to each, and a forest of the links.

    cross: only pairs of nodes of different sides count. |A & B| (p + q) >= p (|A| + |B|)
    says that A and B are p/q alike, in whole numbers. Distances to the first node bound
    all others: a pair whose distances sum to 1 - p/q at most is linked, and one whose
    distances differ by more is not.
    """
    p, q = similarity.numerator, similarity.denominator
    far = 1 - p / q
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marks = np.zeros(int(codes.max()) + 1, bool)

    def shared(mine: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        marks[mine] = True
        found = np.add.reduceat(marks[codes], begins, dtype=np.int64)
        marks[mine] = False
        return found

    common = shared(codes[: sizes[0]], codes, ends - sizes)
    distance = 1 - common / (sizes + sizes[0] - common)
    order = np.argsort(distance, kind="stable")
    near, sizes, copies, side = distance[order], sizes[order], copies[order], side[order]
    codes = np.concatenate([codes[ends[k] - len(sets[k]) : ends[k]] for k in order.tolist()])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    links, forest = np.zeros(n, np.int64), _Forest(n)
    for k in np.flatnonzero(near <= far - 1e-9).tolist():
        forest.join(0, k)
    sure = np.searchsorted(near, far - 1e-9 - near, "right")  # of k: all before sure[k], but itself
    sums = np.stack([np.concatenate([[0], np.cumsum(np.where(side == s, copies, 0))]) for s in (0, 1)])
    for k in range(n):
        until = int(sure[k])
        total = sums[1 - side[k], until] if cross else sums[:, until].sum()
        links[k] += total - (copies[k] if until > k and not cross else 0)
        low, high = max(until, k + 1), int(np.searchsorted(near, near[k] + far + 1e-9, "right"))
        if low >= high:
            continue
        found = shared(codes[begins[k] : ends[k]], codes[begins[low] : ends[high - 1]], begins[low:high] - begins[low])
        hit = found * (p + q) >= p * (sizes[low:high] + sizes[k])
        if cross:
            hit &= side[low:high] != side[k]
        for j in (np.flatnonzero(hit) + low).tolist():
            links[k] += copies[j]
            links[j] += copies[k]
            forest.join(k, j)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return links[back], [int(order[forest.root(int(k))]) for k in back]


def ngram_classes(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, class_id, n_links, class_node) of each row of frame.

    Words are runs of other than white space, A-Z lower-cased; shingles are WORDS words,
    or all words of a shorter text. n_links: the other rows whose shingle sets are
    similarity alike at least, copies included. class_id: the least doc_id of the rows
    that links connect (null if all are null). Null texts and texts without words have
    no links and are a class each, with a null class_node. Rows of one doc_id are
    documents of their own; ids may have any type with an order. Texts of any length are
    compared whole. th: xxhash64 of the text.
    """
    scratch = scratch or Scratch(frame.sparkSession)
    small_batches(frame.sparkSession)
    minhash = MinHash(bands(similarity, recall))
    base = frame.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"))
    rows = scratch.write(signatures(base, minhash), "signatures")
    full = rows.where(F.col("node").isNotNull())
    nodes = full.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("n").alias("n"))
    texts = full.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes, texts = scratch.write(nodes, "nodes"), scratch.write(texts, "texts")
    edges = scratch.write(candidates(texts, scratch, similarity, len(minhash.a)), "candidates")
    rough = scratch.write(components(scratch, edges, "rough"), "rough")
    wanted = rough.join(nodes, "node")
    sizes = wanted.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    wanted = scratch.write(wanted.join(sizes, "root"), "wanted")
    count = wanted.count()
    ids = wanted.select("node", "root", "copies", "m", "total", F.col("least").alias("d"))
    ids = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    found = base.join(ids, F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "node", "root", "copies", "m", "total")

    def sets(batches):
        for batch in batches:
            made = [s.tobytes() if len(s) and digest(s) == node else None for s, node in zip(shingle_sets(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            mine = pa.array([k for k, x in enumerate(made) if x is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(mine) for k in range(1, 6)], pa.array([x for x in made if x is not None], pa.binary())], names=["node", "root", "copies", "m", "total", "shingles"])

    full_sets = found.mapInArrow(lean(sets), "node binary, root binary, copies long, m long, total long, shingles binary")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_NODES, F.col("total") / BLOCK_SHINGLES))
    dealt = _blocks(full_sets, "root", blocks).select("root", "i", "j", "node", "copies", "block", "shingles")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    exact = Fraction(str(similarity))

    def check(batches):
        for group in _groups(batches, 3):
            kept = list({node: k for k, node in enumerate(group.column(3).to_pylist())}.items())  # a node's text may come twice
            arrays = group.column(6).to_pylist()
            side = group.column(5).to_numpy()
            cross = group.column(1)[0].as_py() != group.column(2)[0].as_py()
            at = [k for _, k in kept]
            side = (side[at] != group.column(1)[0].as_py()).astype(np.int64)
            links, roots = verify([np.frombuffer(arrays[k], np.uint64) for k in at], group.column(4).to_numpy()[at], side, cross, exact)
            names = [node for node, _ in kept]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[k] for k in roots], pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    verified = scratch.write(dealt.mapInArrow(lean(check), "a binary, b binary, links long"), "verified")
    classes = components(scratch, verified.select("a", "b"), "classes")
    links = verified.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    known = nodes.join(links, "node", "left").join(classes, "node", "left")
    known = known.select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("class_node"))
    first = known.groupBy("class_node").agg(F.min("least").alias("class_id"))
    known = scratch.write(known.join(first, "class_node"), "known").select("node", "class_node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "th", "node").join(known, "node", "left").select(
        "doc_id", "th", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_node"
    )


def ngram_join(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of frame; see ngram_classes."""
    return ngram_classes(frame, text, doc_id, similarity, recall).select("doc_id", "class_id", "n_links")


def one_of_each(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """frame with one row of each class: one of the least doc_id; rows without words all stay. Columns may have any names."""
    scratch = Scratch(frame.sparkSession)
    classes = scratch.write(ngram_classes(frame, text, doc_id, similarity, recall, scratch), "result")
    full = classes.where(F.col("class_node").isNotNull())
    first = full.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_node").agg(F.min("doc_id").alias("d"), F.min("th").alias("least_th"))
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("least_th"))
    # those that go are fewer than those that stay
    gone = full.join(first, "class_node").where(~stays).select(F.col("doc_id").alias("d"), F.col("th").alias("gone_th")).distinct()
    gone = scratch.write(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    packed = frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("r"))
    packed = packed.select("r", F.col(f"r.`{doc_id}`").alias("i"), F.xxhash64(F.col(f"r.`{text}`")).alias("h"))
    kept = packed.join(gone, F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("gone_th")), "left_anti")
    repeated = full.groupBy("doc_id", "th").agg(F.count("*").alias("k")).where("k > 1")
    if not repeated.isEmpty():  # rows that agree in doc_id and text: one of them
        blank = F.btrim(F.coalesce(F.col(f"r.`{text}`"), F.lit("")), F.lit(SPACES)) == ""
        kept = kept.where(~blank).dropDuplicates(["i", "h"]).unionByName(kept.where(blank))
    return kept.select("r.*")
