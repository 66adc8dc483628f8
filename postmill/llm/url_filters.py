"""URL filters by a sorted array of 64-bit digests.

Rules (host, path, action) are stored as an array of xxhash64 keys in order, beside the
full rule strings. Executors map the array into memory, probe it by a vectorised binary
search, and compare the stored string before they believe a hit.
"""

from __future__ import annotations

import mmap
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import lean, small_batches

#: Bytes of one index; longer rule lists become several indexes, probed in turn.
INDEX_BYTES = 64 << 20
#: Characters that lower() may touch in a host; others have no case here.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode())


def index_bytes(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """One index: counts, path lengths, then keys in order, string ends, path starts, actions, strings."""
    rows = sorted({(digest(h + p), (h + p).encode(), len(h.encode()), a == "block") for h, p, a in rules})
    lengths = sorted({len(rule[cut:].decode()) for _, rule, cut, _ in rows})
    keys = np.array([r[0] for r in rows], np.uint64)
    ends = np.cumsum([len(r[1]) for r in rows], dtype=np.int64)
    starts = np.array([r[2] for r in rows], np.int64)
    block = np.array([r[3] for r in rows], np.uint8)
    head = struct.pack("<qq", len(rows), len(lengths))
    return head + b"".join(x.tobytes() for x in (np.array(lengths, np.int64), keys, ends, starts, block)) + b"".join(r[1] for r in rows)


class Index:
    """An index mapped into memory; its file is unlinked at once, so nothing stays behind."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = struct.unpack_from("<qq", self.map)
        at = 16
        self.lengths = np.frombuffer(self.map, np.int64, m, at).tolist()
        at += 8 * m
        self.keys = np.frombuffer(self.map, np.uint64, n, at)
        self.ends = np.frombuffer(self.map, np.int64, n, at + 8 * n)
        self.starts = np.frombuffer(self.map, np.int64, n, at + 16 * n)
        self.block = np.frombuffer(self.map, np.uint8, n, at + 24 * n)
        self.strings = at + 25 * n

    def probe(self, asked: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """(rule, whether it blocks) of each (host, path) that is a rule; among rules of one string the host decides."""
        keys = np.array([digest(h + p) for h, p in asked], np.uint64)
        first = np.searchsorted(self.keys, keys)
        found: list[tuple[str, bool] | None] = [None] * len(asked)
        near = first < len(self.keys)
        near[near] = self.keys[first[near]] == keys[near]
        for i in np.flatnonzero(near).tolist():
            host, rule = asked[i][0].encode(), "".join(asked[i]).encode()
            k = int(first[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # past collisions and repeats
                low = self.strings + (int(self.ends[k - 1]) if k else 0)
                if self.starts[k] == len(host) and self.map[low : self.strings + int(self.ends[k])] == rule:
                    found[i] = (rule.decode(), bool(self.block[k]) or bool(found[i] and found[i][1]))
                k += 1
        return found


def parts(url: str | None) -> tuple[str, str]:
    """Host (after the first :// up to /, ?, # or end, A-Z lower-cased) and path (up to ?, # or end)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = re.search(r"[/?#]|\Z", rest).start()
    return rest[:cut].translate(LOWER), re.split(r"[?#]", rest[cut:], maxsplit=1)[0]


def suffixes(host: str) -> Iterator[str]:
    while host:
        yield host
        host = host.partition(".")[2]


def _indexes(rules) -> list[bytes]:
    """Indexes of at most INDEX_BYTES each; a DataFrame of rules passes through the driver one index at a time."""
    rows = rules.select("host", "path", "action").toLocalIterator() if isinstance(rules, DataFrame) else rules
    made, part, held = [], [], 0
    for h, p, a in rows:
        if h is None or p is None or a not in ("allow", "block"):
            raise ValueError(f"not a rule: {(h, p, a)}")
        part.append((h, p, a))
        held += 33 + len((h + p).encode())
        if held >= INDEX_BYTES:
            made.append(index_bytes(part))
            part, held = [], 0
    return [*made, index_bytes(part)] if part or not made else made


def url_filters(frame: DataFrame, rules, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to frame, in place of columns so named.

    rules: tuples or a DataFrame of (host, path, action), action allow or block. A rule
    fits its host and all subdomains if the url's path starts with the rule's path; the
    longest (host and path together, then the host) wins, and of two equal rules the
    blocking one. Urls without a fitting rule, with null or without "://" get a null
    rule and the verdict otherwise. One narrow pass without a shuffle; repeated rows
    each get a verdict.
    """
    small_batches(frame.sparkSession)
    context = frame.sparkSession.sparkContext
    shipped = [context.broadcast(x) for x in _indexes(rules)]
    added = ("host", "path", "rule", "verdict")
    rest = [c for c in frame.columns if c not in added]
    packed = frame.select(F.col(url).alias("u"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))
    schema = packed.select("r").schema
    for name in added:
        schema = schema.add(name, "string")

    def run(batches):
        indexes = [Index(x.value) for x in shipped]
        for batch in batches:
            split = [parts(x) for x in batch.column(0).to_pylist()]
            best: list[tuple] = [(0, 0, False, None)] * len(split)
            for index in indexes:
                asked, owner = [], []
                for i, (host, path) in enumerate(split):
                    heads = [path[:n] for n in index.lengths if n <= len(path)]
                    for tail in suffixes(host):
                        asked += [(tail, head) for head in heads]
                        owner += [i] * len(heads)
                for i, (host, _), hit in zip(owner, asked, index.probe(asked), strict=True):
                    if hit:
                        best[i] = max(best[i], (len(hit[0]), len(host), hit[1], hit[0]))
            rule = [x[3] for x in best]
            verdict = [otherwise if x[3] is None else "block" if x[2] else "allow" for x in best]
            columns = [[x[0] for x in split], [x[1] for x in split], rule, verdict]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x, pa.string()) for x in columns]], names=["r", *added])

    done = packed.mapInArrow(lean(run), schema)
    return done.select(*[F.col(f"r.`{c}`").alias(c) for c in rest], *added)
