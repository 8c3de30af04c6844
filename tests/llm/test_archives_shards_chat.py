"""WARC round trips, sharding and chat formatting."""

import gzip
import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseweave.llm import chat, sharding, warc
from caseweave.session import fresh_path

PAGES = [
    (3, "http://a/x y\r\nz", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "http://b", None), (4, "http://c", ""), (5, "u", "é" * 70_000),
    (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "u", "\r\n\r\n"), (1, None, "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "alone"),
]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted(warc.round_trip(pages).collect(), key=str)
    first = {}
    for p, _, h in PAGES:
        if p is not None or (h or "") not in first:
            first[h or ""] = p if first.get(h or "") is None else min(first[h or ""], p)
    want = []
    for p, _, h in PAGES:
        body, one = (h or "").encode(), first[h or ""]
        want.append((p, len(body), warc.digest(body), "response" if p == one else "revisit", None if p == one else one))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_members_and_sidecar(spark):
    pages = spark.createDataFrame([(k, "u", "x" * k) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    plain = warc.write_archives(pages, fresh_path(spark, "warc"))
    for r in warc.normalise(plain).collect():
        path = r["archive"].removeprefix("file://")
        data = open(path, "rb").read()
        lines = [line.split("\t") for line in open(path + ".idx").read().splitlines()]
        assert sum(int(n) for _, n, _ in lines) == len(data)
        for offset, length, record in lines:
            member = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert f"WARC-Record-ID: {record}".encode() in member
    machine = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    cut = machine.compress(warc.make_record(1, "u", b"abc", None, False)[:-5]) + machine.flush()
    with pytest.raises(ValueError):
        list(warc.split_records(iter([gzip.decompress(cut)])))


def test_shards(spark):
    rows = [(k, f"text {k % 7}", 1) for k in range(4000)] + [(5, "again", 1)] * 500 + [(None, None, 1), (None, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    got = sharding.shard_records(docs).collect()
    assert len(got) == len(rows)
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    counts = [sum(r["shard"] == s and r["doc_id"] != 5 for r in got) for s in range(8)]
    assert min(counts) > 400 and max(counts) < 600 and 350 < sum(r["grown_shard"] == 8 for r in got if r["doc_id"] != 5) < 550
    named = {(r["doc_id"], r["size"], r["text_crc32"]) for r in got}
    assert (3, len("text 3") + 1, zlib.crc32(b"text 3")) in named and (None, 1, 0) in named
    moved = {r["doc_id"]: r["shard"] for r in sharding.shard_records(docs, weights=(1.0,) * 9).collect()}
    assert moved == {r["doc_id"]: r["grown_shard"] for r in got}
    double = spark.range(6000).select(sharding.rendezvous(F.col("id"), (1.0, 2.0, 1.0)).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: round(r["count"] / 1500) for r in double} == {0: 1, 1: 2, 2: 1}
    assert sharding.shard_records(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("x"), (1.0, 0.0))


TURNS = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<s>\\<s> <\\s> <\\\\/s> [\\INST] &<"), (1, 3, "assistant", None),
    (2, 0, "us%er\n</s>", "x"), (2, 0, None, "y"), (2, None, "assistant", "first"), (2, 0, "us%er\n</s>", "x"), (None, 5, "assistant", ""), (None, 6, "%0A", "[INST"),
    (3, 1, "assistant", "\n"), *[(4, k, "assistant" if k % 2 else "user", f"<s>{k}") for k in range(200)],
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    turns = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    formatted = chat.format_conversations(turns)
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert set(back) == {1, 2, 3, 4, None}
    for conv in back:
        rows = sorted(((-1 if n is None else n, r or "", t or "") for c, n, r, t in TURNS if c == conv))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r, t) for _, r, t in rows]
        assert back[conv]["loss_text"] == "".join(t for _, r, t in rows if r == "assistant")
    for r in formatted.collect():
        inner = r["formatted"]
        assert inner.count("<s>") + inner.count("[INST]") == len(back[r["conv_id"]]["turns"])
        assert len(inner) == back[r["conv_id"]]["formatted_chars"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


@given(st.lists(st.lists(st.sampled_from(list("<>[]/\\s\n%0A25IaN") + ["<s>", "</s>", "[INST]", "[/INST]", "INST]"]), max_size=12).map("".join), min_size=40, max_size=40))
@settings(max_examples=5, deadline=None)
def test_any_text_comes_back(spark, texts):
    rows = [(k, 0, texts[-k - 1], t) for k, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["turns"][0]["role"], r["turns"][0]["text"], len(r["turns"])) for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert got == {k: (role, t, 1) for k, _, role, t in rows}
