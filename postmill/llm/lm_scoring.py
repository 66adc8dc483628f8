"""Language-model scoring by a probabilistic suffix tree over words.

The tree's root holds the words' frequencies. Every context of the training texts, the
one to DEPTH words before a token, is a candidate, and it is retained if its next-word
distribution diverges enough from that of the next shorter context. A distribution
lists all next words seen in that context; what it does not list is left to the shorter
context, so all distributions are smoothed down to the root and sum to one. A token is
scored in the longest retained context that it follows.

The tree grows with the training texts and is never gathered. Tokens, each with the
words before it, are dealt into shards by the word before; so a shard holds all that
follows that word, builds that part of the tree and scores the tokens. A context that
more tokens follow than a shard should hold is hot: its counts are aggregated beside the
shards, its tokens are dealt by one word more (by the document, at full depth), and each
shard asks for the counts that it needs. Words are written as short codes, frequent ones
by a broadcast table; counts of rarer words are asked for likewise. Scores return to the
block of texts that they came from, packed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from postmill.llm.common import Scratch, lean, small_batches
from postmill.llm.ngram_join import _BASE, STEP, _mix, word_hashes

#: Words of the longest context. Each one more is some two bytes a token to shuffle.
DEPTH = 2
#: Nats a token by which a retained context diverges.
DIVERGENCE = 0.01
#: Hash of the end of a text, which is a token.
END = np.uint64(0x5851F42D4C957F2D)
ADDED = 0.1
#: Words that have a code in the broadcast table: those that make up 1 / COMMON of the tokens and occur OFTEN times at least (a
#: rarer word costs more there than where it occurs); results do not depend on it.
COMMON, OFTEN = 1 << 24, 8
#: Tokens of a shard on average, and those that a task deals at once. A context that more tokens follow is hot, and dealt to
#: shards of its own by the half.
SHARD_TOKENS, BLOCK_TOKENS = 1_000_000, 1_000_000
#: Tokens that are scored at once, or all that follow one word. Scores travel in units of 1 / UNIT.
PIECE_TOKENS, UNIT = 200_000, float(1 << 20)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(10)) == 0, F.lit(False))


def token_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, first token of each text) of some texts at a time, in order; each text ends with END."""
    column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        hashes, at = word_hashes(part, np.minimum(offsets[i:j] - offsets[i], len(part)))
        ends = at[1:] + np.arange(j - i)
        tokens = np.empty(len(hashes) + j - i, np.uint64)
        word = np.ones(len(tokens), bool)
        word[ends] = False
        tokens[word], tokens[ends] = hashes, END
        yield tokens, np.concatenate([[0], ends[:-1] + 1])
        i = j


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of asked in the sorted keys, -1 where they are not."""
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


class Codes:
    """Codes 1, 2, ... of common words, the most frequent first; hashes in order, with their codes, and counts and hashes by code."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((hashes, -counts))
        self.counts = np.concatenate([[0], counts[by_count]])
        self.words = np.concatenate([np.zeros(1, np.uint64), hashes[by_count]])
        code = np.empty(len(hashes), np.int64)
        code[by_count] = np.arange(1, len(hashes) + 1)
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], code[order].astype(np.int32)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(data: memoryview, kind: str, n: int) -> tuple[np.ndarray, memoryview]:
    size = np.dtype(kind).itemsize
    found = np.frombuffer(data, np.uint8, n * size).reshape(size, n)
    return found.T.copy().view(kind).ravel(), data[n * size :]


def pack(columns: list[np.ndarray], kinds: str) -> bytes:
    """Columns (of lengths of their own) as byte planes, compressed; kinds: i for 32 bits, q for 64, d for doubles."""
    lengths = np.array([len(x) for x in columns], "<i8").tobytes()
    planes = b"".join(_planes(np.ascontiguousarray(x.astype({"i": "<i4", "q": "<i8", "d": "<f8"}[k]))) for x, k in zip(columns, kinds, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(lengths + planes)


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    rest = memoryview(zstandard.ZstdDecompressor().decompress(data))
    lengths, rest, out = np.frombuffer(rest, "<i8", len(kinds)).tolist(), rest[8 * len(kinds) :], []
    for n, k in zip(lengths, kinds, strict=True):
        found, rest = _unplaned(rest, {"i": "<i4", "q": "<i8", "d": "<f8"}[k], n)
        out.append(found)
    return out


def longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run of words, known by gram, with word in front of it."""
    return _mix(gram * _BASE + word)


def grams(hashes: np.ndarray, most: int) -> list[np.ndarray]:
    """The hashes of the runs of 1, ..., most words that end at each token (only those within a text mean anything)."""
    out = [hashes]
    for k in range(1, most):
        out.append(longer(out[-1], np.roll(hashes, k)))
    return out


def _places(firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each token and its place in it."""
    rows = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, n)))
    return rows, np.arange(n) - firsts[rows]


def shards_of(hashes: np.ndarray, into: np.ndarray, salt: np.ndarray, hot: list[tuple[np.ndarray, np.ndarray]], shards: int) -> np.ndarray:
    """Shards of tokens: by the word before, or by itself at the head of a text, or by more words while these are hot.

    hot: for contexts of 1, 2, ... words the hashes in order of the hot ones, and the
    parts that each is dealt into: by the word before it, or, where there is none or no
    longer context counts, by salt, a number of the token's document.
    """
    ends = grams(hashes, max(1, len(hot)))
    key = np.where(into >= 1, np.roll(hashes, 1), hashes)
    open_ = np.flatnonzero(into >= 1)
    for k, (contexts, parts) in enumerate(hot, 1):
        context = np.roll(ends[k - 1], 1)
        at = _find(contexts, context[open_])
        open_, at = open_[at >= 0], at[at >= 0]
        if not len(open_):
            break
        more = np.where(into[open_] > k, np.roll(hashes, k + 1)[open_], salt[open_]) if k < len(hot) else salt[open_]
        key[open_] = longer(context[open_], _mix(more) % parts[at])
        open_ = open_[into[open_] > k]
    return ((_mix(key) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def deal(block: int, hashes: np.ndarray, firsts: np.ndarray, salt: np.ndarray, learned: np.ndarray, codes: Codes, hot: list[tuple], shards: int) -> list[tuple]:
    """(shard, block, data, rare) of the tokens of a block of texts.

    data: codes of the words before, the last one first (0: none), and of the token, and
    twice the text's place in the block, plus 1 if it is learned from. Words without a
    code have one after those, by their place in rare.
    """
    n, most, depth = len(hashes), len(codes.counts), len(hot)
    at = _find(codes.hashes, hashes)
    word = np.empty(n, np.int32)
    word[at >= 0] = codes.codes[at[at >= 0]]
    unknown, place = np.unique(hashes[at < 0], return_inverse=True)
    word[at < 0] = most + place
    rows, into = _places(firsts, n)
    columns = [np.where(into >= k, np.roll(word, k), np.int32(0)) for k in range(1, depth + 1)] + [word]
    texts = (2 * rows + learned[rows]).astype(np.int32)
    shard = shards_of(hashes, into, salt[rows], hot, shards)
    del at, rows, into
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    out = []
    for s in np.flatnonzero(np.diff(bounds)):
        take = order[bounds[s] : bounds[s + 1]]
        mine = [x[take] for x in columns]
        rare = np.unique(np.concatenate([x[x >= most] for x in mine]))
        if len(rare):
            mine = [np.where(x >= most, most + np.searchsorted(rare, x), x) for x in mine]
        text = texts[take]
        out.append((int(s), block, pack([*mine, np.diff(text, prepend=0)], "i" * (depth + 2)), unknown[rare - most].view(np.int64)))
    return out


class Hot:
    """What is known of the hot contexts of one length: hashes in order, tokens that follow, distinct ones, and whether it is retained."""

    def __init__(self, contexts=(), sizes=(), listed=(), kept=()):
        contexts = np.array(contexts, np.int64).view(np.uint64)
        order = np.argsort(contexts)
        self.contexts = contexts[order]
        self.sizes, self.listed, self.kept = np.array(sizes, float)[order], np.array(listed, float)[order], np.array(kept, bool)[order]

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.contexts, np.ceil(2 * self.sizes / SHARD_TOKENS).astype(np.uint64)


def score_shard(before: list[np.ndarray], word: np.ndarray, learned: np.ndarray, root: np.ndarray, hashes: np.ndarray, hot: list[Hot], asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The probability of each token.

    before: codes of the words before, the last one first, 0 where there is none. Unless
    hot, a context has all its tokens here; learned are those that count. asked: hashes
    in order of runs of words, and their counts, for what follows hot contexts. root and
    hashes: by code.
    """
    width, group = len(root), np.zeros(len(word), np.int64)
    every = root[word]  # by the whole context so far, retained or not
    score = every.copy()
    context, run = None, hashes[word]
    for k, code in enumerate(before, 1):
        deep = np.flatnonzero(code > 0)
        if not len(deep):
            break
        context = hashes[code] if k == 1 else longer(context, hashes[code])
        run = longer(run, hashes[code])
        _, first, own = np.unique(group[deep] * width + code[deep], return_index=True, return_inverse=True)
        pairs, one, pair = np.unique(own * width + word[deep], return_index=True, return_inverse=True)
        mine = pairs // width
        n = np.bincount(pair, learned[deep], len(pairs))
        known = _find(hot[k - 1].contexts, context[deep[first]])
        if (known >= 0).any():
            outside = np.flatnonzero(known[mine] >= 0)
            at = _find(asked[0], run[deep[one[outside]]])
            n[outside] = np.where(at >= 0, asked[1][at] if len(asked[1]) else 0, 0)
        size, listed = np.bincount(mine, n, len(first)), np.bincount(mine[n > 0], minlength=len(first)).astype(float)
        seen = np.flatnonzero(n > 0)
        share = n[seen] / size[mine[seen]]
        shorter = every[deep[one]]
        gain = np.bincount(mine[seen], share * np.log(share / shorter[seen]), len(first)).astype(float)
        kept = (size > 0) & (gain - listed / (2 * np.maximum(size, 1)) >= DIVERGENCE)
        there = known >= 0
        size[there], listed[there], kept[there] = hot[k - 1].sizes[known[there]], hot[k - 1].listed[known[there]], hot[k - 1].kept[known[there]]
        below, total = (listed + 1)[mine], (size + listed + 1)[mine]
        best = score[deep[one]]
        every[deep] = ((n + below * shorter) / total)[pair]
        score[deep] = np.where(kept[mine], (n + below * best) / total, best)[pair]
        group[deep] = own
    return score


def score_tokens(before: list[np.ndarray], word: np.ndarray, learned: np.ndarray, *known) -> np.ndarray:
    """score_shard of a shard piece by piece: what follows one word is whole in a piece."""
    order = np.argsort(before[0], kind="stable")
    fresh = np.flatnonzero(np.diff(before[0][order], prepend=-1))  # where the word before changes
    out, start = np.empty(len(word)), 0
    while start < len(order):
        ahead = int(np.searchsorted(fresh, start + PIECE_TOKENS))
        end = int(fresh[ahead]) if ahead < len(fresh) else len(order)
        take = order[start:end]
        out[take] = score_shard([x[take].astype(np.int64) for x in before], word[take].astype(np.int64), learned[take], *known)
        start = end
    return out


def lm_scores(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of frame.

    Tokens are the runs of other than white space, A-Z lower-cased, and one end a text.
    The model learns from rows of which crc32(doc_id as text) mod 10 is not 0 (a null
    doc_id counts as not 0). base_score: the sum over tokens of
    log10((c + 0.1) / (N + 0.1 (V + 1))); score: that of the suffix tree's probabilities,
    with contexts of up to depth words. Null and empty texts are their end alone. Rows of
    one doc_id, repeated rows too, are texts of their own; ids may have any type. Texts
    of any length are scored whole. Without training rows every token has the
    probability 1 / (V + 1) = 1.
    """
    small_batches(frame.sparkSession)
    scratch, context = Scratch(frame.sparkSession), frame.sparkSession.sparkContext
    given = F.col(doc_id)
    base = frame.select(F.col(text).alias("text"), given.alias("doc_id"), (~held_out(given)).alias("learned"), F.xxhash64(given).alias("salt"))
    learned_texts = base.where("learned").select("text")

    def words(batches):
        for batch in batches:
            for hashes, _ in token_hashes(batch.column(0)):
                keys, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    table = scratch.write(learned_texts.mapInArrow(lean(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    tokens, vocabulary = map(int, table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    common = (F.col("n") * COMMON >= tokens) & (F.col("n") >= OFTEN)
    often = table.where(common).toPandas()  # COMMON at most
    shipped = context.broadcast(Codes(often["h"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)))
    shards, limit = max(1, math.ceil(tokens / SHARD_TOKENS)), SHARD_TOKENS

    # hot contexts, length by length: at most tokens / limit of a length
    contexts = [r["h"] for r in table.where(F.col("n") > limit).select("h").collect()]
    shorter = table.select("h", ((F.col("n") + ADDED) / (tokens + ADDED * (vocabulary + 1))).alias("p"))
    hot, counted = [], table.where(~common)
    for k in range(1, depth + 1):
        if not contexts:
            hot.append(Hot())
            continue
        here = np.sort(np.array(contexts, np.int64).view(np.uint64))

        def following(batches, k=k, here=here):
            for batch in batches:
                for hashes, firsts in token_hashes(batch.column(0)):
                    ends = grams(hashes, k + 1)
                    _, into = _places(firsts, len(hashes))
                    before = np.roll(ends[k - 1], 1)
                    take = np.flatnonzero((into >= k) & (_find(here, before) >= 0))
                    _, first, counts = np.unique(ends[k][take], return_index=True, return_counts=True)
                    take = take[first]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[take].view(np.int64)) for x in (ends[k], before, ends[k - 1])), pa.array(counts.astype(np.int64))], names=["h", "context", "up", "n"])

        runs = learned_texts.mapInArrow(lean(following), "h long, context long, up long, n long").groupBy("h", "context", "up").agg(F.sum("n").alias("n"))
        runs = runs.join(shorter.select(F.col("h").alias("up"), F.col("p").alias("below")), "up")
        runs = scratch.write(runs.select("h", "context", "n", "below"), f"hot-{k}")
        stats = runs.groupBy("context").agg(F.sum("n").alias("size"), F.count("*").alias("listed"), F.sum(F.col("n") * F.log(F.col("n") / F.col("below"))).alias("x"))
        found = stats.collect()
        gains = [r["x"] / r["size"] - math.log(r["size"]) - r["listed"] / (2 * r["size"]) for r in found]
        hot.append(Hot(*[[r[c] for r in found] for c in ("context", "size", "listed")], [g >= DIVERGENCE for g in gains]))
        counted = counted.union(runs.select("h", "n"))
        p = (F.col("n") + (F.col("listed") + 1) * F.col("below")) / (F.col("size") + F.col("listed") + 1)
        shorter = runs.join(stats.select("context", "size", "listed"), "context").select("h", p.alias("p"))
        contexts = [r["h"] for r in runs.where(F.col("n") > limit).select("h").collect()]
    known = context.broadcast(hot)
    kind = frame.schema[doc_id].dataType

    def dealt(batches):
        codes, lists = shipped.value, [x.parts for x in known.value]
        count, held, size = 0, [], 0

        def block():
            hashes, firsts, ids, learned, salt = zip(*held, strict=True)
            hashes, firsts, learned, salt = map(np.concatenate, (hashes, firsts, learned, salt))
            ids = pa.concat_arrays(ids)
            name = ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32) + count
            rows, _ = _places(firsts, len(hashes))
            at = _find(codes.hashes, hashes)
            n = np.where(at >= 0, codes.counts[codes.codes[at]] if len(codes.codes) else 0, 0)
            mine = np.where(n > 0, np.log10((n + ADDED) / (tokens + ADDED * (vocabulary + 1))), 0.0)
            home = pack([np.bincount(rows, minlength=len(ids)), np.bincount(rows, n > 0, len(ids)), np.bincount(rows, mine, len(ids))], "qqd")
            made = [(-1 - name % shards, name, home, None, ids), *((*x, None) for x in deal(name, hashes, firsts, salt, learned, codes, lists, shards))]
            columns = [pa.array([r[c] for r in made], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            lists_of_ids = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(made), pa.int32()), ids)
            return pa.RecordBatch.from_arrays([*columns, lists_of_ids], names=["s", "block", "data", "rare", "ids"])

        for batch in batches:
            learned, salt, begin = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64), 0
            for hashes, firsts in token_hashes(batch.column(0)):
                rows = slice(begin, begin + len(firsts))
                held.append((hashes, firsts + size, batch.column(1).slice(begin, len(firsts)), learned[rows], salt[rows]))
                begin, size = begin + len(firsts), size + len(hashes)
                if size >= BLOCK_TOKENS:
                    yield block()
                    count, held, size = count + 1, [], 0
        if held:
            yield block()

    def asking(batches):
        codes, lists = shipped.value, [x.parts for x in known.value]
        held, size = [], 0

        def distinct():
            at, found = map(np.concatenate, zip(*held, strict=True))
            order = np.lexsort((found, at))
            found, at = found[order], at[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
            return at[new], found[new]

        def packed(at, found):
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(found.view(np.int64))], names=["shard", "h"])

        for batch in batches:
            salt, begin = batch.column(1).to_numpy().view(np.uint64), 0
            for hashes, firsts in token_hashes(batch.column(0)):
                rows, into = _places(firsts, len(hashes))
                shard = shards_of(hashes, into, salt[begin + rows], lists, shards).astype(np.int32)
                begin += len(firsts)
                rare = _find(codes.hashes, hashes) < 0
                before = len(held)
                held.append((shard[rare], hashes[rare]))
                ends = grams(hashes, depth + 1)
                for k, (here, _) in enumerate(lists, 1):
                    if len(here):
                        take = (into >= k) & (_find(here, np.roll(ends[k - 1], 1)) >= 0)
                        held.append((shard[take], ends[k][take]))
                size += sum(len(x) for x, _ in held[before:])
                if size > BLOCK_TOKENS:  # what a task asks again and again is asked once, while it fits
                    held = [distinct()]
                    if len(held[0][0]) > BLOCK_TOKENS // 2:
                        yield packed(*held.pop())
                    size = sum(len(x) for x, _ in held)
        if held:
            yield packed(*distinct())

    def scored(part: pa.Table, counts: pa.Table) -> pa.Table:
        if not part.num_rows or part["s"][0].as_py() < 0:
            return part.select(["block", "data", "ids"])
        codes = shipped.value
        most, columns, texts, ends = len(codes.counts), [], [], [0]
        rare = np.unique(np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in part["rare"])]))
        for data, few in zip(part["data"], part["rare"], strict=True):
            *mine, text = unpack(data.as_py(), "i" * (depth + 2))
            code = (most + np.searchsorted(rare, few.values.to_numpy())).astype(np.int32)
            for x in mine if len(code) else ():
                x[x >= most] = code[x[x >= most] - most]
            columns.append(mine)
            texts.append(np.cumsum(text))
            ends.append(ends[-1] + len(text))
        *before, word = (np.concatenate(x) for x in zip(*columns, strict=True))
        del columns
        asked = counts["h"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        order = np.argsort(asked[0])
        asked = asked[0][order], asked[1][order]
        at = _find(asked[0], rare.view(np.uint64))
        n = np.concatenate([codes.counts, np.where(at >= 0, asked[1][at] if len(order) else 0, 0)])
        root = (n + ADDED) / (tokens + ADDED * (vocabulary + 1))
        learned = np.concatenate([x & 1 for x in texts]).astype(float)
        p = np.log10(score_tokens(before, word, learned, root, np.concatenate([codes.words, rare.view(np.uint64)]), known.value, asked))
        del before
        out = []
        for a, b, text in zip(ends[:-1], ends[1:], texts, strict=True):
            place, row = np.unique(text >> 1, return_inverse=True)
            odd = word[a:b] >= most  # words that had no code at home
            score = np.rint(np.bincount(row, p[a:b], len(place)) * UNIT)
            out.append(pack([np.diff(place, prepend=0), score, np.diff(text[odd] >> 1, prepend=0), n[word[a:b][odd]]], "iqiq"))
        return pa.table([part["block"], pa.array(out, pa.binary()), pa.nulls(len(out), part["ids"].type)], names=["block", "data", "ids"])

    def summed(part: pa.Table) -> pa.Table:
        ids = part["ids"].combine_chunks()
        home = next(k for k in range(part.num_rows) if ids[k].is_valid)
        n_tokens, n_known, base_score = (x.copy() for x in unpack(part["data"][home].as_py(), "qqd"))
        score = np.zeros(len(n_tokens))
        for k in range(part.num_rows):
            if k != home:
                place, mine, seldom, n = unpack(part["data"][k].as_py(), "iqiq")
                score[np.cumsum(place)] += mine / UNIT
                seldom = np.cumsum(seldom)
                n_known += np.bincount(seldom, n > 0, len(ids[home])).astype(np.int64)
                base_score += np.bincount(seldom, np.log10((n + ADDED) / (tokens + ADDED * (vocabulary + 1))), len(ids[home]))
        return pa.table([ids[home].values, *(pa.array(x) for x in (n_tokens, n_known, base_score, score))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    ids = StructField("ids", ArrayType(kind))
    parts = base.select("text", "doc_id", "learned", "salt").mapInArrow(lean(dealt), StructType.fromDDL("s long, block long, data binary, rare array<long>").add(ids))
    asked = base.select("text", "salt").mapInArrow(lean(asking), "shard long, h long").join(counted.select("h", "n"), "h").select("shard", "h", "n")
    scores = parts.groupBy("s").cogroup(asked.groupBy("shard")).applyInArrow(scored, StructType.fromDDL("block long, data binary").add(ids))
    done = scores.groupBy("block").applyInArrow(summed, StructType([StructField("doc_id", kind), *StructType.fromDDL("n_tokens long, n_known long, base_score double, score double")]))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
