"""Phrases of words that occur together more than their parts suggest, by dynamic itemset counting.

The documents are dealt to ``shards`` shards, which are scanned in turn, again and again. Words are counted in the first
cycle. A longer phrase becomes active after the scan in which the later of its two subphrases (without the last and without
the first word) has reached the threshold, is counted from the next scan on for one whole cycle, and so has its count over
all texts; lengths are counted side by side in one scan. The scans end when every active phrase has had its cycle.

What has reached the threshold, and after which scan, stands in a table of ``1 << slot_bits`` bytes that goes to all
tasks; it is the only thing that does, and it doesn't grow with the data. A phrase is looked up by a hash. Phrases that
share a slot may become active earlier than they must, which costs work and changes no count: a start is a fixed function
of the table, as a slot keeps the first scan written into it, and no phrase starts before its subphrases do, whatever
another phrase has left in their slots. Tasks count in numpy over blocks of words; counts of a
phrase meet in one aggregation, so a phrase or a language that holds most words is a few rows per task. Phrases that have
had their cycle take no part in later scans: they are written once, if they have reached the threshold, and what a scan
leaves is written before its shuffle is given up.

Null texts are empty and have no words; a null language is ``und``. Repeated rows count as often as they are there. A
document is cut into words in one task, and blocks of words bound the memory beside it. An empty table gives an empty
result. Columns other than the text and the language are left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.llm.batches import slices
from caseweave.session import fresh_path, release, stage

#: Words of a block that a task counts at once, and words and their bytes after which a task forgets its numbering.
BLOCK, WORDS, WORD_BYTES = 1 << 21, 1 << 19, 64 << 20
#: Rows of one Arrow batch that leaves a task.
ROWS = 1 << 18
#: Parts into which a language is dealt before its best phrases are ranked.
SALTS = 64
NEVER = 255
MASK = (1 << 64) - 1
#: The character of the number 0 in a key, and the characters of the first scans.
ZERO = 32
STARTS = np.array([bytes([ZERO + k]) for k in range(95)], object)
_letters = bytes(range(65, 91)), bytes(range(97, 123))
_prepare = bytes.maketrans(_letters[0] + b".,;:!?\x0b\x0c\r\t", _letters[1] + b"\n" * 9 + b" ")


class Numbering(dict):
    """Words of one language → numbers from 1, shared by all languages of a task; 0 ends a piece, -1 is no word."""

    def __init__(self, lang: str, task: Task):
        super().__init__({b"": -1, b"\n": 0})
        self.seed, self.lang, self.task = xxhash.xxh64_intdigest(lang, 42), lang, task

    def learn(self, words: list[bytes]) -> None:
        """Number the words that are new."""
        new = [w for w in words if w not in self]
        task, seed = self.task, self.seed
        self.update(zip(new, range(len(task.words), len(task.words) + len(new)), strict=True))
        task.words += new
        task.langs += [self.lang] * len(new)
        task.hashes.extend([xxhash.xxh64_intdigest(w, seed) for w in new])
        task.bytes += sum(map(len, new))


class Task:
    """Counts the active phrases of one scan in one task."""

    def __init__(self, table: np.ndarray, scan: int, shards: int, max_words: int):
        self.table, self.scan, self.shards, self.max_words = table, scan, shards, max_words
        self.shift = np.uint64(64 - (len(table) - 1).bit_length())
        self.sizes: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.words, self.langs, self.hashes, self.bytes = [b""], [""], array("Q", [0]), 0
        self.numbering: dict[str, Numbering] = {}
        self.blocks, self.held = [], 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        numbering = self.numbering.get(lang)
        if numbering is None:
            numbering = self.numbering[lang] = Numbering(lang, self)
        joined = b"\n".join(texts).translate(_prepare).replace(b"\n", b" \n ")
        tokens = pc.split_pattern(pa.array([joined], pa.large_binary()), " ").values.dictionary_encode()
        known = tokens.dictionary.to_numpy(zero_copy_only=False).tolist()  # each different word of these texts is looked up once
        numbering.learn(known)
        ids = np.fromiter(map(numbering.__getitem__, known), np.int64, len(known))[tokens.indices.to_numpy()]
        self.blocks += [ids[ids >= 0], np.zeros(1, np.int64)]
        self.held += len(ids)
        self.sizes[lang] = self.sizes.get(lang, 0) + int(np.count_nonzero(ids > 0))

    def full(self) -> bool:
        return self.held > BLOCK or len(self.words) > WORDS or self.bytes > WORD_BYTES

    def count(self) -> Iterator[pa.RecordBatch]:
        """The counts of what was added, as batches (key, n)."""
        if not self.blocks:
            return
        ids = np.concatenate(self.blocks)
        self.blocks, self.held = [], 0
        vocabulary, langs = pa.array(self.words, pa.binary()), pa.array([f"{x}\n".encode() for x in self.langs], pa.binary())
        first = np.frombuffer(self.hashes, np.uint64)[ids]
        at = np.flatnonzero(ids > 0)  # where the phrases of k words begin
        hashed, code, start = first[at], ids[at], np.zeros(len(at), np.int16)
        for k in range(1, self.max_words + 1):
            if k > 1:
                later = np.maximum(reached[at], reached[at + 1])
                both = np.flatnonzero(later < NEVER)
                at, hashed, code, start = at[both], hashed[both], code[both], later[both].astype(np.int16) + 1
                end = at + (k - 1)
                hashed = (hashed * np.uint64(0x9E3779B97F4A7C15) + first[end]) * np.uint64(0xD6E8FEB86659FD93)
                if len(self.words) ** k >= 1 << 62:
                    code = np.unique(code, return_inverse=True)[1]
                code = code * len(self.words) + ids[end]
            if k < self.max_words:
                slot = (hashed * np.uint64(0xFF51AFD7ED558CCD)) >> self.shift
                reached = np.full(len(ids) + 1, NEVER, np.uint8)
                # another phrase of the slot may be older than this one, which hasn't been counted before its start
                reached[at] = np.maximum(self.table[slot], start - 1)
            active = np.flatnonzero((start <= self.scan) & (self.scan < start + self.shards))
            place, found = pd.factorize(code[active])
            n = np.bincount(place, minlength=len(found))
            kept, started = np.empty(len(found), np.int64), np.empty(len(found), np.int16)
            kept[place[::-1]], started[place[::-1]] = at[active[::-1]], start[active[::-1]]  # where each was found first
            for a in range(0, len(kept), ROWS):
                rows, some = kept[a : a + ROWS], n[a : a + ROWS]
                parts = [vocabulary.take(pa.array(ids[rows + j])) for j in range(k)]
                marks = [pa.scalar(bytes([ZERO + k])).cast(pa.binary()), pa.array(STARTS[started[a : a + ROWS]], pa.binary()), langs.take(pa.array(ids[rows]))]
                phrase = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
                key = pc.binary_join_element_wise(*marks, phrase, b"")
                yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(some.astype(np.int64))], names=["key", "n"])
        if len(self.words) > WORDS or self.bytes > WORD_BYTES:
            self.forget()

    def totals(self) -> pa.RecordBatch:
        """The number of all words per language, as phrases of no words."""
        keys = [f"{chr(ZERO)}{chr(ZERO)}{lang}\n" for lang in self.sizes]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*self.sizes.values()], pa.int64())], names=["key", "n"])


def hashes(words: list[bytes], seed: int) -> Iterator[int]:
    """The hash of the first word, of the first two, and so on."""
    hashed = 0
    for k, word in enumerate(words):
        own = xxhash.xxh64_intdigest(word, seed)
        hashed = own if k == 0 else (hashed * 0x9E3779B97F4A7C15 + own) * 0xD6E8FEB86659FD93 & MASK
        yield hashed


def slot_of(key: str, slot_bits: int) -> int:
    lang, phrase = key[2:].split("\n", 1)
    *_, hashed = hashes(phrase.encode().split(b" "), xxhash.xxh64_intdigest(lang, 42))
    return (hashed * 0xFF51AFD7ED558CCD & MASK) >> 64 - slot_bits


def slots_of(keys: DataFrame, slot_bits: int) -> DataFrame:
    """(slot) of phrases by their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([slot_of(k, slot_bits) for k in batch.column(0).to_pylist()], pa.int32())], names=["slot"])

    return keys.select("key").mapInArrow(run, "slot int")


def count_scan(shard: DataFrame, table: np.ndarray, scan: int, shards: int, max_words: int) -> DataFrame:
    """(key, n): counts of the phrases that are active in this scan, one row per task block.

    A key is the number of words, the first scan, the language and the phrase; the first two are a character each. In the
    first cycle a phrase of no words holds the number of all words of its language.
    """
    sent = shard.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(sent.value, scan, shards, max_words)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, own in by_lang.items():
                    task.add(lang, own)
                if task.full():
                    yield from task.count()
        yield from task.count()
        if scan < shards:
            yield task.totals()

    return shard.select("lang", "text").mapInArrow(run, "key string, n long")


def marked(lang: F.Column) -> F.Column:
    """A language's name without line breaks, which end it in a key; ``unmarked`` gives it back."""
    return F.replace(F.replace(lang, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unmarked(lang: F.Column) -> F.Column:
    return F.replace(F.replace(lang, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def deal(docs: DataFrame, shards: int, text: str, lang: str) -> str:
    """Write (lang, text) of all rows with a text to a folder of shards."""
    path = fresh_path(docs.sparkSession, "shards")
    own = marked(F.coalesce(F.col(lang).cast("string"), F.lit("und"))).alias("lang")
    rows = docs.select(own, F.col(text).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    rows.where("text <> ''").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def part_of(key: str, which: str) -> F.Column:
    """The number of words or the first scan that a key holds."""
    return F.ascii(F.substring(key, 1 + ["words", "start"].index(which), 1)) - ZERO


def count_phrases(
    docs: DataFrame, least: int = 10, max_words: int = 3, shards: int = 2, slot_bits: int = 24, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases found at least ``least`` times, (lang, n) with all words of a language)."""
    if not (shards > 0 and max_words > 0 and shards * (max_words + 1) < len(STARTS)):
        raise ValueError(f"{shards} shards, {max_words} words")
    spark = docs.sparkSession
    path = deal(docs, shards, text, lang)
    schema = "lang string, text string, shard int"
    table = np.full(1 << slot_bits, NEVER, np.uint8)
    before, finished, sizes = None, [], None
    scan, last = 0, shards - 1
    name = unmarked(F.substring_index(F.substring("key", 3, 1 << 30), "\n", 1)).alias("lang")
    words = part_of("key", "words")
    while scan <= last:
        shard = spark.read.schema(schema).parquet(path).where(F.col("shard") == scan % shards)
        rows = count_scan(shard, table, scan, shards, max_words)
        if before is not None:  # what still had scans to come after the last one
            rows = rows.unionByName(before.where(part_of("key", "start") + shards > scan))
        over, often = part_of("key", "start") + shards <= scan + 1, (F.col("n") >= least) | (words == 0)
        summed = stage(rows.groupBy("key").agg(F.sum("n").alias("n")).where(~over | often))
        release(before)
        reached = stage(summed.where(often))
        fresh = slots_of(reached.where(words.between(1, max_words - 1)), slot_bits).distinct()
        slots = fresh.toArrow().column(0).to_numpy()  # at most one per entry of the table
        if (table[slots] > scan).any():
            table[slots] = np.minimum(table[slots], scan)
            last = max(last, scan + shards)
        ended = reached.where(over)
        finished.append(ended.where(words > 0).select(name, F.expr("substr(key, instr(key, '\n') + 1)").alias("phrase"), words.alias("words"), "n"))
        if scan == shards - 1:
            sizes = ended.where((words == 0) & (F.col("n") > 0)).select(name, "n")
        before, scan = summed, scan + 1
    release(before)
    found = finished[0]
    for more in finished[1:]:
        found = found.unionByName(more)
    return found, sizes


def subphrase(words: F.Column, start: F.Column, length: F.Column) -> F.Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): every phrase of two or more words with its lowest-scoring cut."""
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("found"))
    long = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = long.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cut.select(
        "lang", "phrase", "words", "a", "k",
        subphrase(F.col("w"), F.lit(1), F.col("k")).alias("left"), subphrase(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    left = known.select("lang", F.col("part").alias("left"), F.col("found").alias("l"))
    right = known.select("lang", F.col("part").alias("right"), F.col("found").alias("r"))
    both = parts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr("(cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) * 1000000BD) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longest_n): the greatest count of a longer phrase around each phrase of two or more words."""
    long = counts.where("words > 2").select("lang", "n", "words", F.split("phrase", " ").alias("w"))
    length = long.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    at = length.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("i"))
    return at.select("lang", "n", subphrase(F.col("w"), F.col("i"), F.col("k")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longest_n"))


def collocations(
    docs: DataFrame, least: int = 10, max_words: int = 3, top: int = 2000, within_percent: int = 50, shards: int = 2, slot_bits: int = 24,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of every language.

    A phrase goes if a longer one around it has at least ``within_percent`` of its count.
    """
    found, sizes = count_phrases(docs, least, max_words, shards, slot_bits, text, lang)
    around = covered(found)
    kept = scored(found).join(around, ["lang", "phrase"], "left").where(F.expr(f"longest_n IS NULL OR 100 * longest_n < {within_percent} * a"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
