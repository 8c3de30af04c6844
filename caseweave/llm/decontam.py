"""Benchmark decontamination by a BM25 index of the test items, searched with block-max WAND.

A test item is a question and an answer: the answer is its last line, or its last sentence where it has one line only.
The index holds for each term the items it occurs in, in blocks with their highest impact. A passage whose terms reach
the threshold in no block of items has no pivot and is done; the others are searched list by list. A training document is cut
into passages of ``2 * span`` words that begin every ``span`` words, span being the longest item's words and a quarter
more, so that any stretch of span words lies in one passage. Every passage is a query, and all items above the threshold
are retrieved.

The threshold is an item's own BM25 score less its largest term scores, as many as words may be missing when the share
``similarity`` of its shingles is present; so no passage that would pass the check is lost. Impacts are divided by it,
which makes it 1 for all items. A retrieved pair is checked: the share of the item's shingles (``size`` words, lower case)
that the passage holds must reach ``similarity``, and at least half of the question's and of the answer's must be there.
One changed word takes most shingles of a short part; so a part of which fewer are there counts by the share of its words
that stand in order where the item's other shingles place it, and half of these must be there.

Items are few beside the corpus but not bounded, so the index is built over blocks of items of at most
``INDEX_BYTES`` of text, sent one at a time; a block is a pass over the documents. Document frequencies are taken over
all items first.

Null and blank documents and items match nothing; an item of fewer words than ``size`` has one shingle, all of it.
Repeated rows give repeated results. Without items or documents the result is empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.batches import slices

INDEX_BYTES = 16 << 20
#: Items (and postings) of a block. Few, so that a block's highest impacts stay close to what one item can score.
BLOCK = 4
#: Passages times blocks of items that are bounded at once.
CELLS = 1 << 20
FOUND = "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double"
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    """The shingles of a sequence; a shorter one is its own only shingle."""
    if not words:
        return set()
    return set(zip(*(words[k:] for k in range(size)))) if len(words) > size else {tuple(words)}


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item."""
    lines = [x for x in text.split("\n") if _words(x)]
    if len(lines) > 1:
        return words_of("\n".join(lines[:-1])), words_of(lines[-1])
    parts = [x for x in re.split(r"(?<=[.?!])\s+", text) if _words(x)]
    return words_of(" ".join(parts[:-1])), words_of(parts[-1] if parts else "")


def spread_ranges(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) for every place of the ranges ``first[k]`` to ``first[k] + lengths[k]``."""
    of = np.repeat(np.arange(len(first)), lengths)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + first[of]


def in_order(part: list[str], stretch: list[str]) -> int:
    """How many words of ``part`` occur in ``stretch`` in this order (longest common subsequence)."""
    counts = [0] * (len(stretch) + 1)
    for word in part:
        before = 0
        for k, other in enumerate(stretch, 1):
            before, counts[k] = counts[k], before + 1 if word == other else max(counts[k], counts[k - 1])
    return counts[-1]


class Item(NamedTuple):
    item_id: int
    words: list[str]
    n_question: int
    question: set
    answer: set
    whole: set


class Index:
    """Impacts of terms in items, divided by each item's threshold, in blocks of postings."""

    def __init__(self, rows: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_words: float, similarity: float = 0.8, size: int = 5, k1: float = 1.2, b: float = 0.75):
        self.similarity, self.size, self.items, self.thresholds = similarity, size, [], []
        postings = defaultdict(list)
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            question, answer = question_answer(text)
            item = Item(item_id, words, len(question), shingles(question, size), shingles(answer, size), shingles(words, size))
            norm = k1 * (1 - b + b * len(words) / mean_words)
            impact = {}
            for term, tf in Counter(words).items():
                n = frequency.get(term, 1)
                impact[term] = math.log(1 + (n_items - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + norm)
            often = max(Counter(zip(*(words[k:] for k in range(size)))).values(), default=1)
            missing = often * math.floor(len(item.whole) * (1 - similarity) + 1e-9)
            threshold = max(sum(sorted(impact.values())[: max(0, len(impact) - missing)]), 1e-9)
            for term, value in impact.items():
                postings[term].append((len(self.items), value / threshold))
            self.items.append(item)
            self.thresholds.append(threshold)
        self.span = max((len(i.words) for i in self.items), default=1) * 5 // 4 + 1
        # per term: items, impacts, last item of each block, highest impact of each block, highest of all
        self.terms: dict[str, tuple] = {}
        for term, list_ in postings.items():
            blocks = [list_[k : k + BLOCK] for k in range(0, len(list_), BLOCK)]
            self.terms[term] = ([p[0] for p in list_], [p[1] for p in list_], [x[-1][0] for x in blocks], [max(p[1] for p in x) for x in blocks], max(p[1] for p in list_))
        self.number = {term: k for k, term in enumerate(self.terms)}
        # per term the blocks of items that it occurs in and its highest impact there, one after the other
        cells: dict[tuple[int, int], float] = {}
        for term, k in self.number.items():
            for item, value in zip(*self.terms[term][:2]):
                cells[k, item // BLOCK] = max(cells.get((k, item // BLOCK), 0.0), value)
        self.in_block = np.array([b for _, b in cells], np.int64)
        self.block_top = np.array(list(cells.values()))
        self.n_blocks = -(-len(self.items) // BLOCK)
        self.held = np.bincount([k for k, _ in cells], minlength=len(self.terms)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.held)])[:-1].astype(np.int64)

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """(item, score) of all items that score 1 or more for a set of terms, by block-max WAND."""
        lists = [[0, *self.terms[t]] for t in terms if t in self.terms]  # place, items, impacts, block ends, block tops, top
        found, least = [], 1 - 1e-9
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            upper, pivot = 0.0, -1
            for k, x in enumerate(lists):
                upper += x[5]
                if upper >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            blocks = [self._block(x, item) for x in ahead]
            if sum(x[4][b] for x, b in zip(ahead, blocks) if b < len(x[4])) >= least:
                total = 0.0
                for x in ahead:
                    self._advance(x, item)
                    if x[0] < len(x[1]) and x[1][x[0]] == item:
                        total += x[2][x[0]]
                        x[0] += 1
                if total >= least:
                    found.append((item, total))
            else:  # no item up to the nearest block end can reach it
                until = min([x[3][b] for x, b in zip(ahead, blocks) if b < len(x[3])], default=item) + 1
                if pivot + 1 < len(lists):
                    until = min(until, lists[pivot + 1][1][lists[pivot + 1][0]])
                for x in ahead:
                    self._advance(x, max(until, item + 1))
            lists = [x for x in lists if x[0] < len(x[1])]
        return found

    @staticmethod
    def _block(x: list, item: int) -> int:
        b = x[0] // BLOCK
        while b < len(x[3]) and x[3][b] < item:
            b += 1
        return b

    @staticmethod
    def _advance(x: list, item: int) -> None:
        b = Index._block(x, item)
        x[0] = max(x[0], b * BLOCK)
        while x[0] < len(x[1]) and x[1][x[0]] < item:
            x[0] += 1

    def verify(self, item: Item, present: tuple[set, list[str]]) -> tuple[float, float, float] | None:
        """(overlap, of the question, of the answer) if a passage with these shingles and words holds the item."""
        held, passage = present
        share = lambda part: len(part & held) / len(part) if part else 1.0
        overlap, question, answer = share(item.whole), share(item.question), share(item.answer)
        if overlap < self.similarity:
            return None
        if question < 0.5:
            question = max(question, self.aligned(item, passage, 0, item.n_question))
        if answer < 0.5:
            answer = max(answer, self.aligned(item, passage, item.n_question, len(item.words)))
        return (overlap, question, answer) if min(question, answer) >= 0.5 else None

    def aligned(self, item: Item, passage: list[str], start: int, end: int) -> float:
        """The share of the item's words from start to end that stand in order near where its shingles place them."""
        size = min(self.size, len(item.words))
        cut = lambda words: zip(*(words[k:] for k in range(size)))
        places = defaultdict(list)
        for k, s in enumerate(cut(passage)):
            if s in item.whole:
                places[s].append(k)
        offsets = {p - k for k, s in enumerate(cut(item.words)) for p in places.get(s, ())}
        slack = min(len(item.whole) - len(places), end - start)
        stretch = lambda at: passage[max(0, at + start - slack) : max(0, at + end + slack)]
        return max((in_order(item.words[start:end], stretch(at)) for at in offsets), default=0) / (end - start)

    def present(self, words: list[str], item: Item) -> tuple[set, list[str]]:
        """Shingles of a passage in all lengths that the item's parts have, and its words."""
        lengths = {len(s) for part in (item.whole, item.question, item.answer) for s in part}
        return {s for n in lengths for s in zip(*(words[k:] for k in range(n)))}, words

    def reachable(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The passages in which the highest impacts of their terms add up to a threshold in some block of items."""
        passage, at = spread_ranges(starts, ends - starts)
        known = codes[at] >= 0
        pairs = np.unique(passage[known] * len(self.terms) + codes[at][known])
        passage, term = np.divmod(pairs, len(self.terms))
        pair, cell = spread_ranges(self.first[term], self.held[term])
        sums = np.bincount(passage[pair] * self.n_blocks + self.in_block[cell], weights=self.block_top[cell], minlength=len(starts) * self.n_blocks)
        return np.flatnonzero(sums.reshape(len(starts), -1).max(axis=1) >= 1 - 1e-6)

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, score, overlap, question overlap, answer overlap) of the items that a document holds, the best passage of each."""
        words = words_of(text)
        if not words or not self.items:
            return []
        number = self.number.get
        codes = np.array([number(w, -1) for w in words])
        starts = np.arange(0, max(1, len(words) - self.span), self.span)
        ends = np.minimum(starts + 2 * self.span, len(words))
        best: dict[int, tuple] = {}
        step = max(1, CELLS // self.n_blocks)
        for at in range(0, len(starts), step):
            for k in at + self.reachable(codes, starts[at : at + step], ends[at : at + step]):
                passage = words[starts[k] : ends[k]]
                for place, score in self.search(set(passage)):
                    item = self.items[place]
                    if shares := self.verify(item, self.present(passage, item)):
                        row = (item.item_id, score * self.thresholds[place], *shares)
                        name = ("row", place) if item.item_id is None else item.item_id
                        if name not in best or row[2:] > best[name][2:]:
                            best[name] = row
        return list(best.values())


def frequencies(items: DataFrame) -> tuple[dict[str, int], int, float]:
    """(items per term, number of items, mean words) over all items."""
    words = F.filter(F.split(F.lower("text"), r"(?U)\W+"), lambda w: w != "")
    rows = items.select(words.alias("w"))
    n, mean = rows.filter(F.size("w") > 0).agg(F.count("*"), F.avg(F.size("w"))).first()
    counted = rows.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").count()
    return {r["t"]: r["count"] for r in counted.filter("count > 1").toLocalIterator()}, n, mean or 1.0


def item_blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], tuple]]:
    """Blocks of items of at most about INDEX_BYTES of text, with the statistics of all items."""
    named = items.select("item_id", "text").filter("text is not null")
    size, = named.agg(F.sum(F.octet_length("text"))).first()
    stats, n_blocks = frequencies(named), math.ceil((size or 0) / INDEX_BYTES)
    for k in range(n_blocks):
        block = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), stats


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, bm25, overlap, question_overlap, answer_overlap): the documents that hold an item. Nothing is shuffled."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    result = docs.sparkSession.createDataFrame([], FOUND)
    for rows, (frequency, n_items, mean_words) in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(Index(rows, frequency, n_items, mean_words, similarity, size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.float64()) for c in ("bm25", "overlap", "question_overlap", "answer_overlap")]])
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [(d, *m) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for m in sent.value.matches(t)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        result = result.union(narrow.mapInArrow(run, FOUND))
    return result


def without_items(docs: DataFrame, items: DataFrame, similarity: float = 0.8, size: int = 5, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay, whatever they are called."""
    clean = docs
    for rows, (frequency, n_items, mean_words) in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(Index(rows, frequency, n_items, mean_words, similarity, size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    yield part.filter(pa.array([not sent.value.matches(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()], pa.bool_()))

        clean = clean.mapInArrow(run, clean.schema)
    return clean
