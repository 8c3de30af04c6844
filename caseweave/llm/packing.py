"""Packing of tokenised documents into sequences of a fixed length: exact complements first, best fit for the rest.

A document's ids and an end id are cut into pieces of ``size`` only if they are longer; the first piece takes the odd
rest. Which pieces share a sequence depends on their lengths alone, so the plan is made from the number of pieces of
every length, at most ``size`` numbers whatever the corpus holds. From the longest length down, the gap it leaves is
looked up in an index of the sums of one, two and three lengths; a combination that fills it exactly is used as often as
the counts allow. Where none does, the longest length that fits is added and the smaller gap looked up again. Each use
leaves some length of it short, so a plan has some thousand patterns at most.

Tasks number their pieces within each length while they tokenise. The counts per (task, length) give every task its
offset, so a piece's number in its length needs no sort, and the plan's runs of numbers tell its sequence and place. A
length or a document that holds most pieces is spread over the tasks that made it.

Null and empty texts are the end id alone. Repeated rows and ids, and null ids, are packed each by itself. An empty
table gives an empty result. Columns other than the id and the text are left out. Texts are tokenised in parts that end
before a space, so a very long text needs little memory; an id run of a document stays in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseweave.llm.batches import slices, worker_model
from caseweave.llm.tokencount import byte_symbols
from caseweave.session import stage

#: Characters of a part that are kept in the memo of a worker, and bytes of ids and keys after which the memo starts again.
PART_CHARS, MEMO_BYTES = 48, 192 << 20
#: Parts that one call of the merger gets.
JOINED = 20_000
# No byte-level token spans the place before a space that a visible character follows; these ranges are visible in every version.
_ranges = [(0x21, 0x7E), (0xA1, 0x167F), (0x1681, 0x180D), (0x180F, 0x1FFF), (0x2C00, 0x2FFF), (0x3001, 0xD7FF)]
VISIBLE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges) + "]"
_before_word = re.compile(f"(?= {VISIBLE})")
_control = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]").search
_odd_space = re.compile(f" (?!{VISIBLE})")


class Encoder(dict):
    """Ids of texts by a byte-level vocabulary file of the tokenizers library, as little-endian 32-bit numbers.

    Texts are cut before spaces. Parts of ASCII letters and signs, on which both libraries agree, are merged by tiktoken with
    the ranks of the same file, and all others by tokenizers. Short parts that occur again are looked up.
    """

    def __init__(self, vocabulary_file: str):
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(vocabulary_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.held, self.plain = 0, None
        with open(vocabulary_file, encoding="utf-8") as f:
            parts = json.load(f)
        model, before = parts["model"], parts["pre_tokenizer"]
        byte = {s: b for b, s in enumerate(byte_symbols())}
        special = [t["content"] for t in parts["added_tokens"]]
        ranks = {bytes(byte[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(ranks) - len(pairs)
        in_order = all(model["vocab"][a + b] == first + k for k, (a, b) in enumerate(pairs))
        usual = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and parts["normalizer"] is None
        if in_order and usual and all("<" in s for s in special):
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for word, i in ranks.items():
                self.sizes[i] = len(word)
            self.plain = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def parts(text: str) -> list[str]:
        """Cut before every space that a visible character follows; joined they are the text again."""
        if _odd_space.search(text) is None:
            first, *others = text.split(" ")
            return [first, *[" " + p for p in others]]
        return _before_word.split(text)

    def is_plain(self, part: str) -> bool:
        return self.plain is not None and part.isascii() and "<" not in part and not _control(part)

    def __missing__(self, part: str) -> bytes:
        ids = self.plain.encode_ordinary(part) if self.is_plain(part) else self.tokenizer.encode(part, add_special_tokens=False).ids
        found = array("I", ids).tobytes()
        self.keep(part, found)
        return found

    def keep(self, part: str, found: bytes) -> None:
        if len(part) <= PART_CHARS:
            self.held += 160 + 4 * len(part) + len(found)
            self[part] = found

    def learn(self, parts: list[str]) -> None:
        """Keep the ids of many plain parts that begin with a space, from one call on all of them in a row."""
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            ids = np.array(self.plain.encode_ordinary("".join(some)), "<u4")
            upto = 4 * (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p) for p in some])) + 1)
            data, start = ids.tobytes(), 0
            for part, end in zip(some, upto.tolist(), strict=True):
                self.keep(part, data[start:end])
                start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMO_BYTES:
            self.clear()
            self.update({"": b""})
            self.held = 0
        cut = [self.parts(t) for t in texts]
        if self.plain is not None:
            fresh = set(chain.from_iterable(cut)) - self.keys()
            self.learn([p for p in fresh if len(p) <= PART_CHARS and p[0] == " " and self.is_plain(p)])
        return [b"".join(map(self.__getitem__, parts)) for parts in cut]


def pieces(docs: DataFrame, vocabulary_file: str, size: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, number): every piece, numbered from 0 in its task and length.

    Task and number hold only for one run; hand the result to ``stage`` before it is used.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        encoder = worker_model(("ids", vocabulary_file), lambda: Encoder(vocabulary_file))
        for batch in batches:
            for part in slices(batch, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    at, upto = 0, n % size or size
                    while at < n:
                        row.append(k)
                        piece.append(0 if at == 0 else piece[-1] + 1)
                        start.append(at)
                        length.append(upto - at)
                        crc.append(zlib.crc32(ids[4 * at : 4 * upto]))
                        at, upto = upto, upto + size
                lengths = np.array(length, np.int64)
                order = np.argsort(lengths, kind="stable")  # number equal lengths in their order
                counts = np.bincount(lengths, minlength=size + 1)
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                number = np.empty(len(lengths), np.int64)
                number[order] = np.arange(len(lengths)) - first[lengths[order]] + seen[lengths[order]]
                seen += counts
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(number, pa.int64()),
                    ],
                    names=names,
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long")


class SumIndex:
    """Available lengths with their counts, and for every sum the pairs of lengths that make it, the larger first."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self.size = len(counts) - 1
        self.pairs: dict[int, tuple[int, int]] = {}
        self.order: dict[int, Iterator[tuple[int, int]]] = {}

    def largest(self, at_most: int) -> int:
        """The longest available length that fits, 0 if none does."""
        found = np.flatnonzero(self.counts[: max(at_most, 0) + 1])
        return int(found[-1]) if len(found) and found[-1] > 0 else 0

    def has(self, lengths: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in set(lengths))

    def one(self, total: int) -> tuple[int, ...] | None:
        return (total,) if 0 < total <= self.size and self.counts[total] else None

    def two(self, total: int) -> tuple[int, int] | None:
        """The most uneven available pair of a sum. Counts only fall between rebuilds, so the index moves past spent pairs for good."""
        if total not in self.order:
            larger = np.arange(min(total - 1, self.size), (total - 1) // 2, -1)
            larger = larger[(self.counts[larger] > 0) & (self.counts[total - larger] > 0)] if len(larger) else larger
            self.order[total] = ((int(a), total - int(a)) for a in larger)
            self.pairs[total] = next(self.order[total], None)
        while (pair := self.pairs[total]) is not None and not self.has(pair):
            self.pairs[total] = next(self.order[total], None)
        return pair

    def three(self, total: int) -> tuple[int, int, int] | None:
        """A triple of a sum, the largest first member that has a pair for its rest."""
        firsts = np.flatnonzero(self.counts[: max(total - 1, 0)])[::-1]
        for a in firsts:
            a = int(a)
            if a == 0 or 3 * a < total:
                break
            pair = self.two(total - a)
            if pair is not None and self.has((a, *pair)):
                return (a, *pair)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.one(gap) or self.two(gap) or self.three(gap)


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    times: int


def plan(counts: np.ndarray) -> list[Pattern]:
    """Patterns that use up ``counts`` (pieces by length, from 0 to the sequence length), each as often as the counts allow."""
    size, index, out = len(counts) - 1, SumIndex(counts), []
    while longest := index.largest(size):
        used = [longest]
        index.counts[longest] -= 1
        while gap := size - sum(used):
            filling = index.exact(gap)
            if filling is None:
                fitting = index.largest(gap)
                filling = (fitting,) if fitting else ()
            if not filling:
                break
            for x in filling:
                index.counts[x] -= 1
            used += filling
        lengths = tuple(used)
        more = min(index.counts[x] // lengths.count(x) for x in set(lengths))
        for x in lengths:
            index.counts[x] -= more
        out.append(Pattern(lengths, int(more) + 1))
    return out


def runs(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length the runs of its numbers: (first number, per sequence, offset, first sequence), in the order of numbers."""
    found: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in dict.fromkeys(lengths):
            each = lengths.count(x)
            found.setdefault(x, []).append((taken.get(x, 0), each, offset, sequence))
            taken[x] = taken.get(x, 0) + each * times
            offset += each * x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in found.items()}


def place(numbered: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(…, number) with each piece's number in its length → (…, sequence_id, offset)."""
    sent = numbered.sparkSession.sparkContext.broadcast(runs(patterns))
    fields = [f for f in numbered.columns if f != "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for x in np.unique(length):
                own = length == x
                first, each, start, base = table[int(x)]
                k = np.searchsorted(first, number[own], "right") - 1
                within = number[own] - first[k]
                sequence[own] = base[k] + within // each[k]
                offset[own] = start[k] + within % each[k] * x
            kept = [batch.column(batch.schema.get_field_index(f)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*fields, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name in fields)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary_file: str, size: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    cut = stage(pieces(docs, vocabulary_file, size, end_id, doc_id, text))
    per_task = stage(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = cut.join(offsets, ["task", "length"]).withColumn("number", F.col("number") + F.col("first")).drop("first", "task")
    return place(numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number"), plan(counts))
