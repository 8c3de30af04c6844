"""Fingerprints, links and groups against brute force."""

import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from caseweave.llm import simhash


def plain_fingerprint(text, size=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, radius=2):
    root = {v: v for v in values}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(values), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def texts(n, seed=5):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6))) for _ in range(200)]
    made = [None, "", " \n\t", "one", "one two", "ÀB Éé  x\x0by", "One TWO three"]
    while len(made) < n:
        base = [draw.choice(words) for _ in range(draw.randint(5, 300))]
        made.append(" ".join(base))
        for _ in range(draw.randint(0, 4)):
            base[draw.randrange(len(base))] = draw.choice(words)
            made.append(" ".join(base))
    return made[:n]


def test_fingerprints():
    for text in [*texts(60), "word " * 40_000, "a b c " * 20_000]:
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_tree_finds_all():
    draw = random.Random(2)
    values = list({draw.getrandbits(10) for _ in range(500)})
    tree = simhash.BKTree(values)
    for q in values[:100]:
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)
    assert simhash.BKTree([]).within(3, 2) == []


def test_groups_with_dense_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 7)  # many shards for one bucket
    draw = random.Random(9)
    centre = draw.getrandbits(64)
    values = {centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 4))) for _ in range(150)}
    values |= {draw.getrandbits(64) for _ in range(100)} | {0, 3, (1 << 64) - 1, (1 << 63)}
    values = {v % (1 << 64) for v in values}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(v)) for k, v in enumerate(sorted(values))] + [(10_000, 0), (None, 0)]
    marked = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r["fingerprint"] % (1 << 64): r["component_id"] for r in simhash.near_groups(marked).collect()}
    ids = {v: k for k, v in enumerate(sorted(values))}
    roots = plain_groups(values)
    want = {v: min(ids[w] for w in values if roots[w] == roots[v]) for v in values}
    assert got == want


def test_documents(spark):
    made = texts(120)
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(made)] + [(5, made[5], "b"), (None, "lonely words stand here", "c")], "doc_id long, text string, component_id string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 122
    prints = {r["doc_id"]: r["fingerprint"] % (1 << 64) for r in rows if r["doc_id"] is not None}
    assert all(prints[k] == plain_fingerprint(t) for k, t in enumerate(made))
    roots = plain_groups(set(prints.values()))
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == min(k for k, v in prints.items() if roots[v] == roots[prints[r["doc_id"]]])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect())
    assert ids == sorted({r["component_id"] for r in rows if r["component_id"] is not None})
    assert kept.filter(F.col("doc_id").isNull()).count() == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_first(docs).count() == 0
