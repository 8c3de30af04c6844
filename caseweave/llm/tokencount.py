"""Token counts of whole texts under a byte-pair vocabulary, without token ids.

The symbols of a word are a linked list and its mergeable neighbours a heap. The pair of the lowest rank, the leftmost
of equals, is merged again and again; the count is the number of symbols at the start less the merges. Words that occur
again are looked up in a bounded memo.

Null texts count as empty, and empty texts have no tokens. The strings of special tokens inside a text count as one token
each, as in the library's default.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseweave.llm.batches import TextMemo, with_columns, worker_model


# Lower-case forms in which the library differs from Python. A sigma has one form whatever follows it, and
# two capitals are newer than Python's tables.
LOWER = [("\u03a3", "\u03c3"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b")]


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PairCounter:
    """Counts tokens by a vocabulary file of the tokenizers library: NFC, lower case, a split pattern and byte-level BPE."""

    def __init__(self, vocabulary_file: str, memo_words: int = 500_000):
        with open(vocabulary_file, encoding="utf-8") as f:
            parts = json.load(f)
        model, before = parts["model"], parts["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in parts["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in before] != ["Split", "ByteLevel"] or before[0]["behavior"] != "Removed":
            raise ValueError("the vocabulary prepares texts in another way")
        number = {s: i for i, s in enumerate(model["vocab"])}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[number[a] << 32 | number[b]] = (rank, number[a + b])
        end = model["end_of_word_suffix"] or ""
        self.inner = [number[s] for s in byte_symbols()]
        self.final = [number[s + end] for s in byte_symbols()]
        self.words = regex.compile(before[0]["pattern"]["Regex"]).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in parts["added_tokens"]) or r"(?!)")
        self.memo = TextMemo(self._count_word, memo_words)

    def _count_word(self, word: str) -> int:
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        n, merges = len(symbols), self.merges
        following, leading = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := merges.get(symbols[i] << 32 | symbols[i + 1])) is not None:
                heap.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = following[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j], count = made, -1, count - 1
            following[i] = k = following[j]
            if k < n:
                leading[k] = i
                if (m := merges.get(made << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, (m[0], i, made, symbols[k], m[1]))
            if (h := leading[i]) >= 0 and (m := merges.get(symbols[h] << 32 | made)) is not None:
                heapq.heappush(heap, (m[0], h, symbols[h], made, m[1]))
        return count

    def _count_plain(self, text: str) -> int:
        memo = self.memo
        plain = unicodedata.normalize("NFC", text)
        if not plain.isascii():
            for capital, small in LOWER:
                plain = plain.replace(capital, small)
        return sum([memo[w] for w in self.words(plain.lower())])

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        if "<" not in text:
            return self._count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._count_plain(p) for p in parts)


def counter(vocabulary_file: str) -> PairCounter:
    """The counter of a file, made once per Python worker."""
    return worker_model(("pairs", vocabulary_file), lambda: PairCounter(vocabulary_file))


def count_tokens(docs: DataFrame, vocabulary_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (long); a column of that name is replaced. Nothing is shuffled.

    ``vocabulary_file`` is a path that every executor can open.
    """

    def compute(texts: list) -> list:
        c = counter(vocabulary_file)
        return [[c.count(t) if t else 0 for t in texts]]

    return with_columns(docs, text, {"n_tokens": T.LongType()}, compute)
