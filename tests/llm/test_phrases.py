"""Phrase mining against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from caseweave.llm import phrases

SCHEMA = "lang string, text string, n int, slot string"


def brute_counts(rows, max_words):
    found = Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, max_words + 1):
                found.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return found


def brute(rows, least=10, max_words=3, top=2000):
    found = brute_counts(rows, max_words)
    total = Counter()
    for (lang, p), n in found.items():
        total[lang] += n if " " not in p else 0
    kept = {}
    for (lang, p), a in found.items():
        w = p.split(" ")
        if len(w) > 1 and a >= least:
            cuts = []
            for k in range(1, len(w)):
                l, r = found[lang, " ".join(w[:k])], found[lang, " ".join(w[k:])]
                cuts.append((1000000 * a * a // (l * r), k, l, r))
            kept[lang, p] = (a, *min(cuts))
    out = {}
    for (lang, p), (a, score, _, l, r) in kept.items():
        around = [n for (m, q), (n, *_) in kept.items() if m == lang and q != p and f" {p} " in f" {q} "]
        if not any(100 * n >= 50 * a for n in around):
            out.setdefault(lang, []).append((-score, -a, p.encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def corpus(n=250, seed=1):
    draw = np.random.default_rng(seed)
    words = [*"alpha beta Gamma delta eps zeta eta theta iota été 日本 \x85x".split(" "), "rare", "a b"]
    chance = np.array([1 / (i + 1) for i in range(len(words))])
    texts = []
    for _ in range(n):
        t = ""
        for w in draw.choice(words, draw.integers(0, 40), p=chance / chance.sum()):
            t += w + draw.choice([" ", "  ", "\t", ", ", ".", "\n", " New York City "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        texts.append(t)
    rows = [(draw.choice(["en", "de", "und"]), t) for t in texts]
    return [(str(a), b) for a, b in rows] + [(None, "left over words " * 30), ("en", None), ("en", ""), (None, None), ("fr", " \t\n ")] + [("en", "same copy of a text here")] * 90


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shards, slot_bits, max_words", [(3, 24, 3), (1, 24, 3), (4, 3, 3), (2, 24, 4)])
def test_against_plain_counts(spark, shards, slot_bits, max_words):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = rows_of(phrases.collocations(df, max_words=max_words, shards=shards, slot_bits=slot_bits))
    assert got == brute(rows, max_words=max_words)


def test_counts_are_whole_whenever_a_phrase_starts(spark):
    """Words that reach the threshold in the last shard only, in small blocks and with a small numbering."""
    rows = [("en", f"w{i % 7} w{i % 5} w{i % 3}" * (1 + i // 40)) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).coalesce(1)
    old = phrases.BLOCK, phrases.WORDS, phrases.ROWS
    phrases.BLOCK, phrases.WORDS, phrases.ROWS = 50, 5, 3
    try:
        found, sizes = phrases.count_phrases(df, least=12, max_words=3, shards=4)
        got = {(r.lang, r.phrase): r.n for r in found.collect()}
    finally:
        phrases.BLOCK, phrases.WORDS, phrases.ROWS = old
    want = brute_counts(rows, 3)
    assert got == {k: n for k, n in want.items() if n >= 12}
    assert [tuple(r) for r in sizes.collect()] == [("en", sum(n for (_, p), n in want.items() if " " not in p))]


def test_a_phrase_is_not_counted_from_a_scan_before_its_own():
    """The pair's slot was taken after scan 0, its words came after scan 1: it starts at 2, and the three words with it."""
    table = np.full(1 << 24, phrases.NEVER, np.uint8)
    slots = [phrases.slot_of(f"! en\n{w}", 24) for w in ("one", "two", "six", "one two", "two six")]
    table[slots] = 1, 1, 1, 0, 0
    task = phrases.Task(table, 2, 2, 3)
    task.add("en", [b"one two six"])
    assert {r["key"] for b in task.count() for r in b.to_pylist()} == {"\"\"en\none two", "\"\"en\ntwo six", "#\"en\none two six"}


def test_languages_with_line_breaks(spark):
    rows = [(lang, f"{word} b. {word} b") for lang, word in (("a\nb", "one"), ("a b", "two"), ("a%0Ab", "six"), ("a%25", "ten")) for _ in range(8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert rows_of(phrases.collocations(df)) == brute(rows)


def test_activation_waits_for_both_parts():
    """A pair whose words became frequent after scans 0 and 2 is counted from scan 3 to the end of its cycle."""
    table = np.full(1 << 24, phrases.NEVER, np.uint8)
    table[[phrases.slot_of("! en\none", 24), phrases.slot_of("! en\ntwo", 24)]] = 0, 2
    for scan in range(9):
        task = phrases.Task(table, scan, 3, 2)
        task.add("en", [b"one two. one", b"two"])
        counted = {r["key"]: r["n"] for b in task.count() for r in b.to_pylist()}
        assert counted == ({"! en\none": 2, "! en\ntwo": 2} if scan < 3 else {'"#en\none two': 1} if scan < 6 else {})


def test_scores_beyond_64_bits(spark):
    rows = [("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12), ("en", "a b", 2, 3 * 10**12)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    assert phrases.scored(counts).first()["score"] == 10**6 * (3 * 10**12) ** 2 // (20 * 10**24)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(df).collect() == []


def test_a_word_is_looked_up_once_per_slice(monkeypatch):
    asked = []
    learn = phrases.Numbering.learn
    monkeypatch.setattr(phrases.Numbering, "learn", lambda self, words: (asked.append(list(words)), learn(self, words)))
    task = phrases.Task(np.full(16, phrases.NEVER, np.uint8), 0, 2, 3)
    task.add("en", [b"b a a, b a", b"", b"A\nc"])
    task.add("en", [b"c d"])
    assert all(len(words) == len(set(words)) for words in asked)
    found = {key: n for batch in task.count() for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    assert found == {f"! en\n{w}": n for w, n in {"a": 4, "b": 2, "c": 2, "d": 1}.items()}
