"""Toxicity by compression distance with zstandard dictionaries of the two classes.

Texts are cut into windows of whole words. One dictionary is trained on windows of toxic
texts and one, of the same size, on windows of ordinary texts: of each text those that
other texts of its class shorten most beside texts of the other class. Each is put in
front of a larger third one, trained on other ordinary windows, that holds what any text has. A
window is compressed once in either way, and the toxic dictionary shortens it more if it
holds what toxic texts share. The three largest differences of a text and its number of
windows are turned into a probability, calibrated on labelled texts that no dictionary
was trained on; these also tell which of two ways to train the dictionaries of the
classes separates better.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import lean, small_batches

#: Bytes of a window, of a class's dictionary and of the dictionary of frequent text.
WINDOW, OWN, FREQUENT = 128, 4096, 200_000
#: Segment and match lengths by which zstandard chooses a dictionary's content. For the classes both are tried: by
#: matches of six bytes it finds stems with many endings, by eight whole words among pieces that any text has.
OWN_SEGMENTS, FREQUENT_SEGMENT = ((10, 6), (10, 8)), (50, 8)
#: Windows of a text that train a class's dictionary, how often they are chosen anew, and bytes of the other texts that choose them.
TELLING, ROUNDS, BESIDE = 5, 2, 1 << 20
#: Labelled documents of each class that fit() reads at most, with all their windows.
TOXIC_DOCS, ORDINARY_DOCS = 2000, 4000
THRESHOLD = 0.3


def windows(text: str | None) -> list[bytes]:
    """The text, A-Z lower-cased, as windows of whole words of about WINDOW bytes; words longer than that are cut."""
    out, held, n = [], [], 0
    for word in (text or "").encode().lower().split():
        for part in [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word), WINDOW)]:
            if n and n + len(part) + 1 > WINDOW:
                out.append(b" " + b" ".join(held) + b" ")
                held, n = [], 0
            held.append(part)
            n += len(part) + 1
    out.append(b" " + b" ".join(held) + b" ")
    return out


def _compressor(content: bytes, window_log: int = 18, table_log: int = 17) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=window_log, hash_log=table_log, chain_log=table_log, search_log=6, min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


class Distance:
    """The features of a text: its three largest differences and the logarithm of its windows."""

    def __init__(self, frequent: bytes, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary + frequent).compress, _compressor(toxic + frequent).compress

    def features(self, cut: list[bytes]) -> list[float]:
        found = sorted((len(self.ordinary(w)) - len(self.toxic(w)) for w in cut), reverse=True)[:3]
        return [*map(float, found), *[0.0] * (3 - len(found)), math.log(len(cut))]


def _is_copy(cut: list[bytes], seen: set[int]) -> bool:
    """Whether half of the text's four least word five-gram hashes were seen; notes them otherwise."""
    words = b" ".join(cut).split()
    least = sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})[:4]
    if sum(h in seen for h in least) >= min(2, len(least)):
        return True
    seen.update(least)
    return False


def _dictionary(size: int, samples: list[bytes], segment: tuple[int, int]) -> bytes:
    """A dictionary trained on samples; their end where they are too few to train one."""
    try:
        k, d = segment
        return zstandard.train_dictionary(size, samples, k=k, d=d, f=20, split_point=1.0, level=3).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def telling(ordinary: list[list[bytes]], toxic: list[list[bytes]], frequent: bytes) -> tuple[list[bytes], list[bytes]]:
    """Of each text the TELLING windows that tell its class best, for ordinary and for toxic texts.

    Half of the texts judge the other half: a window is compressed after windows of the
    judges of its class and after as many bytes (BESIDE at most) of those of the other,
    each before the frequent text, and the difference counts. In later rounds the judges
    are what was chosen of them. Windows stay as they are where a class has no judges.
    """
    halves = {(y, h): [list(dict.fromkeys(cut)) for cut in texts[h::2]] for y, texts in ((0, ordinary), (1, toxic)) for h in (0, 1)}
    chosen = dict(halves)
    for _ in range(ROUNDS):
        after = dict(chosen)
        for h in (0, 1):
            judges = [b"".join(w for cut in chosen[y, 1 - h] for w in cut) for y in (0, 1)]
            size = min(BESIDE, *map(len, judges))
            if not size:
                continue
            same = [_compressor(x[:size] + frequent, 22, 18).compress for x in judges]
            for y in (0, 1):
                own, other = same[y], same[1 - y]
                after[y, h] = [sorted(cut, key=lambda w, own=own, other=other: len(own(w)) - len(other(w)))[:TELLING] for cut in halves[y, h]]
        chosen = after
    first, second = ([w for h in (0, 1) for cut in chosen[y, h] for w in cut] for y in (0, 1))
    return first, second


def prepare(sample: list[tuple[list[bytes], int]]) -> tuple[bytes, list[bytes], list[bytes]]:
    """The dictionary of frequent text, and the windows that train those of ordinary and of toxic text, from (windows, toxic) of labelled texts.

    Near copies of a text train nothing. Ordinary texts, in the order given, are kept
    for the ordinary dictionary until they have as many windows as the toxic ones (a
    third of them at most); the others train that of frequent text. The telling windows
    of these and of the toxic texts train the dictionaries of the classes.
    """
    seen: set[int] = set()
    texts = [x for x in sample if not _is_copy(x[0], seen)]
    toxic = [cut for cut, y in texts if y]
    most = sum(map(len, toxic))
    ordinary = [cut for cut, y in texts if not y]
    used, windows_used = 0, 0
    while used < len(ordinary) // 3 and windows_used < most:
        windows_used += len(ordinary[used])
        used += 1
    frequent = _dictionary(FREQUENT, [w for cut in ordinary[used:] for w in cut], FREQUENT_SEGMENT)
    return frequent, *telling(ordinary[:used], toxic, frequent)


def classes(prepared: tuple[bytes, list[bytes], list[bytes]], segment: tuple[int, int]) -> tuple[bytes, bytes, bytes]:
    """The dictionaries of frequent, ordinary and toxic text."""
    frequent, own, bad = prepared
    return frequent, _dictionary(OWN, own, segment), _dictionary(OWN, bad, segment)


def train(sample: list[tuple[list[bytes], int]]) -> tuple[bytes, bytes, bytes]:
    """The dictionaries of frequent, ordinary and toxic text by the first of OWN_SEGMENTS."""
    return classes(prepare(sample), OWN_SEGMENTS[0])


def separation(rows: list[tuple[list[float], int]]) -> float:
    """How often the differences of a toxic text add up to more than those of an ordinary one, of (features, toxic); ties count half."""
    a, b = (np.sort([sum(f[:3]) for f, y in rows if y == k]) for k in (1, 0))
    if not len(a) or not len(b):
        return 0.5
    return float((np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).mean() / (2 * len(b)))


def calibrate(rows: list[tuple[list[float], int, float]]) -> list[float]:
    """Logistic weights (constant last, at most as steep as a ridge lets them) of (features, toxic, weight)."""
    if not rows:
        return [0.0, 0.0, 0.0, 0.0, -20.0]
    x = np.array([[*f, 1.0] for f, _, _ in rows])
    y, w = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w = w / w.mean()
    b, ridge = np.zeros(5), np.diag([0.1, 0.1, 0.1, 0.1, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return b.tolist()


def _learnable(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2


def fit(
    frame: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS
) -> bytes:
    """The model, from a bounded sample of the labelled rows of which crc32(doc_id as text) mod 4 is not 2.

    At most toxic_docs and ordinary_docs documents, the least by a hash of doc_id, are
    used, with all their windows. A document with several labels is toxic if one says
    so; of rows that agree in doc_id the first text in order counts. Two thirds train
    the dictionaries, and their windows reach the driver. The rest tells which of
    OWN_SEGMENTS separates the classes best, and calibrates, weighted to the share of
    toxic labels among all; the features are those that toxicity() scores, and only
    they reach the driver.
    """
    known = labels.groupBy(F.col(doc_id).alias("d")).agg(F.max(label).alias("y")).where(F.col("d").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(_learnable(F.col("d"))).select(F.col("d").cast("string").alias("d"), "y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = []
    for y, most in ((0, ordinary_docs), (1, toxic_docs)):
        rows = known.where(F.col("y") == y).orderBy(F.xxhash64("d", F.lit("sample")), "d").limit(most)
        picked += [(r["d"], y, k) for k, r in enumerate(rows.collect())]
    spark = frame.sparkSession
    chosen = F.broadcast(spark.createDataFrame(picked, "d string, y int, k int"))

    def cut(batches):
        for batch in batches:
            rows = [windows(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (1, 2, 3)], pa.array(rows, pa.list_(pa.binary()))], names=["d", "y", "k", "cut"])

    joined = frame.select(F.col(text).alias("t"), F.col(doc_id).cast("string").alias("d")).join(chosen, "d").select("t", "d", "y", "k")
    found = joined.where("k % 3 <> 0").mapInArrow(lean(cut), "d string, y int, k int, cut array<binary>").collect()
    base = {}
    for r in sorted(found, key=lambda r: (r["k"], r["y"], [bytes(w) for w in r["cut"]])):
        base.setdefault(r["d"], ([bytes(w) for w in r["cut"]], r["y"]))
    prepared = prepare(list(base.values()))
    tried = [classes(prepared, segment) for segment in OWN_SEGMENTS]

    def measured(batches):
        distances = [Distance(*contents) for contents in tried]
        for batch in batches:
            rows = [[distance.features(cut) for distance in distances] for cut in map(windows, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (1, 2, 3)], pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=["d", "y", "k", "f"])

    held = {}
    for r in sorted(joined.where("k % 3 = 0").mapInArrow(lean(measured), "d string, y int, k int, f array<array<double>>").collect(), key=lambda r: (r["k"], r["y"], r["f"])):
        held.setdefault(r["d"], (r["f"], r["y"]))
    best = max(range(len(tried)), key=lambda i: separation([(f[i], y) for f, y in held.values()]))
    each = Counter(y for _, y in held.values())
    weights = calibrate([(list(f[best]), y, counts[y] / each[y]) for f, y in held.values()])
    return pickle.dumps((tried[best], weights))


def toxicity(
    frame: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS
) -> DataFrame:
    """frame with held_out, score (0 to 1) and predicted (1 if score >= THRESHOLD) added, in place of columns so named.

    held_out: crc32(doc_id as text) mod 4 is 2; false for a null doc_id. Scores come
    from texts alone, all windows of them, however long; null and empty texts are scored
    as one empty window, and repeated rows each get the same score. Without labels of
    both classes nothing tells them apart, and scores say how frequent toxic labels are.
    toxic_docs and ordinary_docs bound the labelled rows that are learned from; see fit.
    doc_id may have any type that casts to a string. One narrow pass; a task holds one
    Arrow batch.
    """
    small_batches(frame.sparkSession)
    model = fit(frame, labels, text, doc_id, label, toxic_docs, ordinary_docs)
    added = ("held_out", "score", "predicted")
    rest = [c for c in frame.columns if c not in added]
    packed = frame.select(F.col(text).alias("t"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))
    schema = packed.select("r").schema.add("score", "double")

    def run(batches):
        contents, weights = pickle.loads(model)
        distance = Distance(*contents)
        for batch in batches:
            scores = []
            for x in batch.column(0).to_pylist():
                z = sum(a * b for a, b in zip([*distance.features(windows(x)), 1.0], weights, strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores, pa.float64())], names=["r", "score"])

    done = packed.mapInArrow(lean(run), schema)
    held_out = F.coalesce(~_learnable(F.col(f"r.`{doc_id}`")), F.lit(False))
    return done.select(*[F.col(f"r.`{c}`").alias(c) for c in rest], held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
