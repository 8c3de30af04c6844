"""Packing against the tokenizers library and against the least number of sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseweave.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
library = Tokenizer.from_file(VOCABULARY)


_shared = packing.Encoder(VOCABULARY)


def ids_of(text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r  ᠎ 　'sdrtvl<|>\x1c\x85 ")), max_size=60))
def test_parts_give_the_library_ids(text):
    assert np.frombuffer(_shared.encode([text])[0], "<u4").tolist() == ids_of(text) if text else True


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("abAB z019.,;:!?'\"-_()[]{}|>/\\#$%&*+=~`^@\n\t\r\x0b\x0c\x1c\x00sdmtrvel"), max_size=50))
def test_ascii_parts_give_the_library_ids(text):
    assert np.frombuffer(_shared.encode([text])[0], "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("text", [
    "a  b", " a", "a ", "  ", "\n a", "a \n b", "x <|endoftext|> y<|endoftext|>z", "it's 's  's", "a  b", "a\x1c b \x1c c", "   a", "don't  ", "a 　b",
    "Привет мир  как дела", "日本 語 テキスト", "12 34  5", "end. \nNext", "é é", " ᠎a",
])
def test_spaces(text):
    assert np.frombuffer(_shared.encode([text])[0], "<u4").tolist() == ids_of(text)


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 2000)
    e = packing.Encoder(VOCABULARY)
    for k in range(50):
        text = f"word{k} other{k} {'x' * 500}"
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == ids_of(text)
        assert e.held <= 4000 and max(map(len, e)) <= packing.PART_CHARS


def used(patterns, size):
    counts = np.zeros(size + 1, int)
    for p in patterns:
        assert 0 < sum(p.lengths) <= size and p.times > 0
        for x in p.lengths:
            counts[x] += p.times
    return counts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=21, max_size=21))
def test_plan_uses_every_piece_once(counts):
    counts = np.array([0, *counts[1:]])
    assert (used(packing.plan(counts), 20) == counts).all()


def least(counts, size):
    """The fewest sequences, by trying all (small) packings."""
    items = [x for x in range(size, 0, -1) for _ in range(counts[x])]
    best = [len(items)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= items[k]:
                bins[i] -= items[k]
                put(k + 1, bins)
                bins[i] += items[k]
        put(k + 1, [*bins, size - items[k]])

    put(0, [])
    return best[0]


def test_plan_is_near_the_least():
    draw = np.random.default_rng(5)
    over = 0
    for _ in range(60):
        counts = np.zeros(13, int)
        for x in draw.integers(1, 13, 9):
            counts[x] += 1
        n, fewest = sum(p.times for p in packing.plan(counts)), least(counts, 12)
        assert n <= fewest + 1
        over += n > fewest
    assert over <= 6


@pytest.mark.parametrize("seed", range(3))
def test_plan_reaches_the_bound_on_mixed_lengths(seed):
    draw = np.random.default_rng(seed)
    lengths = np.clip(draw.lognormal(5.5, 1.2, 40_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    patterns = packing.plan(counts)
    assert (used(patterns, 2048) == counts).all()
    assert sum(p.times for p in patterns) <= -(-int(lengths.sum()) // 2048) + 1
    assert len(patterns) < 8192


def test_a_hot_length_is_a_short_plan():
    counts = np.zeros(2049, int)
    counts[[1, 700, 1348]] = 10**9, 10**10, 10**10
    patterns = packing.plan(counts)
    assert sum(p.times for p in patterns) == 10**10 + -(-10**9 // 2048) and len(patterns) < 10


def check(rows, texts, size):
    """Every piece of every row is there, and every sequence is filled without gaps."""
    want = sorted(
        (i, k, at, upto - at, crc(ids[at:upto]))
        for i, ids in ((i, [*ids_of(t), 0]) for i, t in texts)
        for k, (at, upto) in enumerate((max(0, len(ids) - (n + 1) * size), len(ids) - n * size) for n in range(-(-len(ids) // size) - 1, -1, -1))
    )
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_pack(spark):
    draw = np.random.default_rng(2)
    words = ["the", "thntble", "a", "ing,", "été", "日本", "x\n", " "]
    texts = [(i, " ".join(draw.choice(words, draw.integers(0, 60)))) for i in range(400)]
    texts += [(400, None), (401, ""), (402, "word " * 5000), (3, texts[3][1]), (3, "other")] + [(500 + i, "same text of seven or so words") for i in range(300)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, number int").repartition(6)
    rows = packing.pack(df, VOCABULARY, size=64).collect()
    n = check(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 64) + 1


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.length for r in packing.pack(df, VOCABULARY).collect()) == [1, 3]
    assert packing.pack(df.limit(0), VOCABULARY).collect() == []
