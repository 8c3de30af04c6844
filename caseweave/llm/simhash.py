"""Near duplicates by SimHash fingerprints, found with BK-trees over shards.

A fingerprint has a bit set where more than half of the hashes of a text's shingles have it. Texts are linked when their
fingerprints differ in at most ``radius`` bits, and a group is what links reach.

Equal fingerprints are one row of the search. Fingerprints within the radius share two of ``radius + 2`` bands, so each
goes to a bucket per pair of bands; buckets of more than ``SHARD`` members are cut into shards. A task gets one shard's
BK-tree (children keyed by their Hamming distance to the parent) and a shard of queries, walks only the edges within the
radius, and gives each linked member the smallest member it reaches there, so a dense bucket gives no list of pairs. The
links then become components in rounds of star contraction, each written to the shared folder.

Texts that are null, empty or blank have the fingerprint zero and are linked like any other. Rows without an id take no
part in naming a group: a group of only such rows has a null id. Repeated rows are equal fingerprints. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.batches import with_columns
from caseweave.session import stage

#: Members of a bucket that one tree holds.
SHARD = 1024
#: Shingle hashes counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a text: words between ASCII spaces, A-Z lowered, shingles hashed with XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashed = xxhash.xxh64_digest
    totals, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, BLOCK):
        upto = min(at + BLOCK, n)
        digests = b"".join([hashed(joined[a : b - 1], seed) for a, b in zip(starts[at:upto], ends[at + size - 1 : upto + size - 1])])
        totals += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint`` (long, two's complement) of the whole text; a column of that name is replaced."""
    return with_columns(docs, text, {"fingerprint": T.LongType()}, lambda texts: [[fingerprint(t, size) for t in texts]])


class BKTree:
    """Unsigned fingerprints; each node keeps its children by their distance to it."""

    def __init__(self, values: list[int]):
        self.root = None
        for value in values:
            self.add(value)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """All members at most ``radius`` bits from ``value``."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            member, children = open_nodes.pop()
            d = (member ^ value).bit_count()
            if d <= radius:
                found.append(member)
            if len(children) <= 2 * radius + 1:
                open_nodes += [c for e, c in children.items() if d - radius <= e <= d + radius]
            else:
                open_nodes += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found


def linked_in_unit(tree: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(member, smallest member it is linked with here) for the members of a shard's tree and a shard of queries."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    index = BKTree(tree)
    for q in queries:
        for member in index.within(q, radius):
            if member != q and (a := top(member)) != (b := top(q)):
                parent[max(a, b)] = min(a, b)
    return ((x, root) for x in list(parent) if (root := top(x)) != x)


def band_keys(fp, radius: int) -> list:
    """A key per pair of bands; fingerprints within the radius share at least one."""
    bands = radius + 2
    cuts = [round(64 * k / bands) for k in range(bands + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(bands)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.struct(F.lit(k).alias("bands"), fp.bitwiseAND(F.lit(signed(masks[a] | masks[b]))).alias("bits")) for k, (a, b) in enumerate(combinations(range(bands), 2))]


def search_units(distinct: DataFrame, radius: int) -> DataFrame:
    """(unit, side, fingerprint): every pair of shards of a bucket is a unit of tree members (side 0) and queries (side 1)."""
    keyed = distinct.select("fingerprint", F.explode(F.array(*band_keys(F.col("fingerprint"), radius))).alias("key")).select("fingerprint", "key.bands", "key.bits")
    sizes = keyed.groupBy("bands", "bits").count().filter("count > 1")
    shards = F.ceil(F.col("count") / SHARD).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("shards")).cast("int")
    placed = keyed.join(sizes, ["bands", "bits"]).withColumn("shards", shards).withColumn("own", own)
    as_tree = F.transform(F.sequence("own", F.col("shards") - 1), lambda j: F.struct(F.col("own").alias("tree"), j.alias("query"), F.lit(0).alias("side")))
    as_query = F.transform(F.sequence(F.lit(0), "own"), lambda i: F.struct(i.alias("tree"), F.col("own").alias("query"), F.lit(1).alias("side")))
    units = placed.select("bands", "bits", "fingerprint", F.explode(F.concat(as_tree, as_query)).alias("u"))
    return units.select("bands", "bits", "u.tree", "u.query", "u.side", "fingerprint")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst) with dst < src, spanning what the links within the radius connect in each unit."""
    unit = ["bands", "bits", "tree", "query"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), []
        mask = (1 << 64) - 1
        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def close() -> None:
            if sides[0] and sides[1]:
                out.extend(linked_in_unit(*sides, radius))

        def batch() -> pa.RecordBatch:
            pairs = [sorted((signed(a), signed(b))) for a, b in out]
            return pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[0] for p in pairs], pa.int64())], names=["src", "dst"])

        for part in batches:
            columns = [c.to_pylist() for c in part.columns]
            for *unit_key, side, fp in zip(*columns, strict=True):
                if unit_key != key:
                    close()
                    key, sides = unit_key, ([], [])
                sides[side].append(fp & mask)
            if out:
                yield batch()
                out.clear()
        close()
        if out:
            yield batch()

    sorted_units = search_units(distinct, radius).repartition(*unit).sortWithinPartitions(*unit, "side", "fingerprint")
    return sorted_units.mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node of ``edges`` (src, dst).

    Large-star and small-star contraction in turn until the edges stay the same; each round is written to the shared folder.
    """
    ordered = lambda df: df.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct()
    current, before = stage(ordered(edges)), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(current.select("dst", "dst")).distinct()
        before = state
        both = current.union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        lowest = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("low"))
        large = ordered(both.filter("dst > src").join(lowest, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")))
        lowest = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(lowest, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(lowest.select("src", "low"))
        current = stage(ordered(small))


def near_groups(marked: DataFrame, radius: int = 2, doc_id: str = "doc_id") -> DataFrame:
    """(fingerprint, root, component_id) for every fingerprint of ``marked``: the smallest fingerprint and id that links reach.

    ``marked`` is read several times; hand in a stored table.
    """
    distinct = stage(marked.groupBy("fingerprint").agg(F.min(doc_id).alias("first_id")))
    roots = stage(components(links(distinct.select("fingerprint"), radius)))
    grouped = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    names = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return grouped.join(names, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``; other columns are left out."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = stage(fingerprints(narrow).drop("text"))
    return marked.join(near_groups(marked, radius), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that of the smallest id, or any row of a group that has none.

    The rows are written once with a number each; groups are made of numbers, ids and fingerprints, and one join by
    number brings the kept rows back, so texts are not compared or sorted. All columns stay as they are, whatever
    they are called.
    """
    inner = [f"in{k}" for k in range(len(docs.columns))]
    own_id, own_text = (inner[docs.columns.index(c)] for c in (doc_id, text))
    rows = stage(fingerprints(docs.toDF(*inner), own_text).withColumn("row", F.monotonically_increasing_id()))
    marked = rows.select("row", F.col(own_id).alias("doc_id"), "fingerprint")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    per_print = marked.groupBy("fingerprint").agg(first)  # a group of copies is a row per task
    kept = per_print.join(near_groups(marked, radius), "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*inner).toDF(*docs.columns)
