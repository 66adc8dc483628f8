import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm.registry import op7_token_counts
from postmill.llm.token_counts import JsonCounter, PieceCounter, plain_normalizer, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "\n\n x", "  a  b ", "a\n", "a \n b", "a▁b ▁", "▁\n", "<s> </s> <unk>", "é ñ ｆ ½ \x00 \r\n\tx", "x" * 5000, "the " * 3000, " \n \n", "日本 語\n 日本"]


@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as f:
        model = f.read()
    return PieceCounter(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_the_shortcut_is_in_use(pieces):
    assert pieces[0].cuts and len(pieces[0].single) > 10_000


def test_the_normalizer_is_read_from_the_model():
    spec = lambda **fields: b"\x1a" + bytes([sum(map(len, fields.values()))]) + b"".join(fields.values())
    plain = dict(name=b"\x0a\x01x", front=b"\x18\x01", runs=b"\x20\x00", marks=b"\x28\x01")
    assert plain_normalizer(b"\x0a\x02ab" + spec(**plain)) and plain_normalizer(spec(runs=b"\x20\x00"))
    for changed in (dict(map=b"\x12\x02ab"), dict(front=b"\x18\x00"), dict(runs=b"\x20\x01"), dict(marks=b"\x28\x00"), dict(rules=b"\x32\x01a")):
        assert not plain_normalizer(spec(**(plain | changed)))
    assert not plain_normalizer(b"")


def test_pieces_agree_with_the_library_on_odd_texts(pieces):
    assert pieces[0].count(ODD) == [len(x) for x in pieces[1].encode(ODD)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abe é\n \t▁#日<s>.", max_size=40))
def test_pieces_agree_with_the_library(pieces, text):
    assert pieces[0].count([text]) == [len(pieces[1].encode(text))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_json_files_agree_with_the_library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        model = f.read()
    library, texts = Tokenizer.from_file(public_tokenizers.path(name)), [*ODD, "a <|endoftext|> b", "Don't  stop", "<|startoftext|>"]
    assert JsonCounter(model).count(texts) == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_whole_table(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "a b", None)], "doc_id long, text string, n_tokens int")
    rows = token_counts(frame, PIECES).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == [(0, 0), (0, 0), (3, 2)]
    assert token_counts(frame.limit(0), PIECES).count() == 0
