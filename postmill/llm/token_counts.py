"""Token counts by the whole-token shortcut.

Offline, the vocabulary is proved string by string: a string that the library encodes
alone as one token counts 1 wherever it is a whole pre-token. Only other pre-tokens are
merged, each distinct one once for a task. Texts are cut into pre-tokens only where the
vocabulary proves that no merge crosses the cut; if it proves nothing, whole texts go to
the library.
"""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import lean, small_batches

#: Distinct pre-tokens that a task remembers at once.
REMEMBERED = 400_000
MARK = "▁"


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; values of variable length are bytes."""
    at = 0

    def whole() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(whole(), 8)
        if kind == 0:
            yield number, whole()
            continue
        size = {1: 8, 5: 4}.get(kind) or whole()
        yield number, data[at : at + size]
        at += size


def plain_normalizer(model: bytes) -> bool:
    """Whether a model's normaliser leaves texts as they are but for one space in front, and spaces as marks.

    Read from the rules in the model: no character map, no rules of its own, runs of
    spaces kept, a space put in front, spaces written as marks. Fixed values: the fields'
    numbers in the file format.
    """
    spec = dict(_fields(dict(_fields(model)).get(3, b"")))
    return not spec.get(2) and not spec.get(6) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


class PieceCounter:
    """Counts the tokens of a sentencepiece model, given as bytes."""

    def __init__(self, model: bytes, single: frozenset | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        pieces = [self.library.id_to_piece(i) for i in plain]
        self.cuts = self._cuts(pieces) and plain_normalizer(model)
        if single is None:
            single = self._single(pieces) if self.cuts else frozenset()
        self.single = single
        self.spaced = dict.fromkeys(single, 1)  # pre-tokens after one space
        self.bare = {}  # pre-tokens after a line break
        self.line_break = len(self.library.encode("\n")) - 1 if self.cuts else 0

    def _cuts(self, pieces: list[str]) -> bool:
        """Whether no merge crosses the start of a run of spaces or either side of \\n.

        No piece may hold a space after another character or a line break.
        """
        return not any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in pieces)

    def _single(self, pieces: list[str]) -> frozenset:
        found = [piece[1:] for piece in pieces if len(piece) > 1 and piece[0] == MARK and piece[1] != MARK]
        found.append("")  # a space alone, which the library has no other way to ask for
        return frozenset(x for x, ids in zip(found, self.library.encode(found, num_threads=1), strict=True) if len(ids) == 1 or not x)

    def _learn(self, cache: dict, missing: list[str], spaced: bool) -> None:
        # a line break in front keeps the library's own space away from a bare pre-token
        asked = missing if spaced else ["\n" + x for x in missing]
        less = 0 if spaced else 1 + self.line_break
        for x, ids in zip(missing, self.library.encode(asked, num_threads=1), strict=True):
            cache[x] = len(ids) - less

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(ids) for ids in self.library.encode(texts, num_threads=1)]
        if len(self.spaced) > REMEMBERED + len(self.single):
            self.spaced = dict.fromkeys(self.single, 1)
        if len(self.bare) > REMEMBERED:
            self.bare = {}
        cut, wanted, bare = [], set(), set()
        for text in texts:
            lines = text.replace(MARK, " ").split("\n")
            spaced, open_ = [], []
            for k, line in enumerate(lines):
                parts = line.split(" ") if line else []
                if "" in parts:  # runs of spaces: a pre-token takes all spaces before it
                    parts = re.findall(r"^[^ ]+| +[^ ]*", " " + line if k == 0 else line)
                    if k and parts[0][0] != " ":
                        open_.append(parts.pop(0))
                    spaced += [x[1:] for x in parts]
                elif k and parts:
                    open_.append(parts[0])
                    spaced += parts[1:]
                else:
                    spaced += parts
            cut.append((spaced, open_, len(lines) - 1, text.startswith("\n")))
            wanted.update(spaced)
            bare.update(open_)
        self._learn(self.spaced, [x for x in wanted if x not in self.spaced], True)
        self._learn(self.bare, [x for x in bare if x not in self.bare], False)
        a, b = self.spaced, self.bare
        # the space that the library puts in front stands alone if a line break follows it
        return [sum(map(a.__getitem__, x)) + sum(map(b.__getitem__, y)) + breaks * self.line_break + alone for x, y, breaks, alone in cut]


class JsonCounter:
    """Counts the tokens of a tokenizers file, given as bytes."""

    def __init__(self, model: bytes, single: frozenset | None = None):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x["content"] for x in json.loads(model).get("added_tokens", [])]
        if single is None:
            single = frozenset(x for x in self.library.get_vocab(with_added_tokens=False) if len(self.library.model.tokenize(x)) == 1)
        self.single = single
        self.known = dict.fromkeys(single, 1)

    def count(self, texts: list[str]) -> list[int]:
        return [self._count(text) for text in texts]

    def _count(self, text: str) -> int:
        if any(x in text for x in self.special) or self.library.pre_tokenizer is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        total, known = 0, self.known
        for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            n = known.get(x)
            if n is None:
                if len(known) > REMEMBERED:
                    known.clear()
                    known.update(dict.fromkeys(self.single, 1))
                known[x] = n = len(self.library.model.tokenize(x))
            total += n
        return total


def counter(kind: str, model: bytes, single: frozenset | None = None):
    return (PieceCounter if kind == ".model" else JsonCounter)(model, single)


def token_counts(frame: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to frame, in place of columns so named.

    The model (a .json or .model file on the driver) is proved there once; model and
    proof, both bounded by the vocabulary, go to the executors as a broadcast. One
    narrow pass: no shuffle, a task holds one Arrow batch. Null texts count as empty
    (0 bytes); empty texts have the library's count, 0; repeated rows each get theirs.
    """
    small_batches(frame.sparkSession)
    kind, model = Path(model_path).suffix, Path(model_path).read_bytes()
    shipped = frame.sparkSession.sparkContext.broadcast((kind, model, counter(kind, model).single))
    added = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in frame.columns if c not in added]
    # only the text crosses to Python; the other columns ride along as one struct
    packed = frame.select(F.col(text).alias("t"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"))
    schema = packed.select("r").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches):
        count = counter(*shipped.value).count
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(count(texts), pa.int64())], names=["r", "n_bytes", "n_tokens"])

    done = packed.mapInArrow(lean(run), schema)
    return done.select(*[F.col(f"r.`{c}`").alias(c) for c in rest], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
