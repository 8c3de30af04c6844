"""Piece encoding and token counts against the libraries."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseweave.llm import pieces, queries, tokencount

PIECES = public_tokenizers.path("piece_bpe_32k.model")
PAIRS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a", "\n\n x\t\t y ", "▁a▁▁ b", "é é 𝔘 日本語テキスト　漢字", "a" * 999, " " * 100, "!" * 77 + "===--->>>", "<s></s><unk><0x0A>",
    "a\x00b", "ﬁ½İ ΑΣ Σς ẞ", "the" * 3000, "0123456789" * 33, "<|endoftext|>it's<|startoftext|>", "<|ENDOFTEXT|", "word " * 30_000, "ꟋꟜ ꟊ Ɤ ΣΑΣ",
]
texts = st.lists(st.sampled_from(list("abcdethinron  .,\n'éß\t▁<>s/0123456789|") + ["the", "tion", "日", "🙂", "́"]), max_size=80).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(text):
    codec = pieces.codec(PIECES)
    assert codec.encode(text) == codec.library.encode(text)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_library(text):
    assert tokencount.counter(PAIRS).count(text) == len(_tokenizer().encode(text, add_special_tokens=False).ids)


_kept = []


def _tokenizer():
    if not _kept:
        _kept.append(Tokenizer.from_file(PAIRS))
    return _kept[0]


def test_odd_texts(library):
    codec, counter = pieces.codec(PIECES), tokencount.counter(PAIRS)
    for text in ODD:
        assert codec.encode(text) == library.encode(text)
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text))
        assert counter.count(text) == len(_tokenizer().encode(text, add_special_tokens=False).ids)


def test_memos_start_again():
    codec = pieces.PieceCodec(PIECES, memo_parts=3, memo_pairs=3)
    text = "one two three four five six seven"
    assert codec.encode(text) == codec.library.encode(text) and len(codec.parts) <= 3


def test_frames(spark, library):
    rows = [(1, None, "x"), (1, "Hi the<re", "y"), (1, "Hi the<re", "y"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "IDS")
    got = pieces.encode_decode(docs, PIECES)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got.collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    counted = tokencount.count_tokens(docs.withColumnRenamed("IDS", "n_tokens"), PAIRS)
    assert sorted((r["text"] or "", r["n_tokens"]) for r in counted.collect()) == [("", 0), ("", 0), ("Hi the<re", 4), ("Hi the<re", 4)]
    assert pieces.encode_decode(docs.limit(0), PIECES).count() == 0
    digests = queries.piece_digests(got).filter("text is null").first()
    assert digests["ids_sha256"] == digests["decoded_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_memo_of_parts_is_bounded_by_characters():
    from caseweave.llm.batches import TextMemo

    asked = []
    memo = TextMemo(lambda part: asked.append(part) or len(part), 10)
    assert memo["x" * 65] == 65 and memo["x" * 65] == 65 and not memo and len(asked) == 2
    for k in range(8):
        assert memo[str(k) * 60] == 60 and sum(map(len, memo)) <= 12 * 10
    assert memo["ab"] == 2 and memo["ab"] == 2 and asked.count("ab") == 1
