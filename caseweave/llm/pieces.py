"""SentencePiece encoding and decoding of whole texts.

A merge-type (BPE) encoding has one last token for every prefix of a text: the encoding of a prefix that ends with token
``t`` is the encoding of the prefix before ``t``, then ``t``. So a table of the last token per prefix holds the encoding.
An automaton over the vocabulary lists the tokens that end at a position, and the one whose pair with the last token
before it stays apart in an encoding of its own is the right one. The ids are read from the table from its end.
The work is linear in the text whatever it consists of.

Texts are cut where no token can lie: before a space mark that follows another character, around signs that no
piece holds beside another kind of character, and around control characters that no piece holds. Parts that occur again are
looked up in a bounded memo.

Null texts count as empty; empty texts have no ids and decode to the empty text. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseweave.llm.batches import Memo, TextMemo, with_columns, worker_model

SPACE = "▁"
NEVER = float("inf")


class PieceCodec:
    """Encoder over the pieces of a BPE model file with identity normalisation and byte fallback; decoding is the library's."""

    def __init__(self, model_file: str, memo_parts: int = 300_000, memo_pairs: int = 400_000):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = " a  b½ﬁ "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises texts; only identity normalisation with a leading space mark is supported")
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        if len(self.bytes) != 256 or any(c not in self.rank for p in self.rank for c in p):
            raise ValueError("the model needs byte pieces and a piece for every character of its pieces")
        self.size, self.steps, automaton = {}, {}, ahocorasick.Automaton()
        for i in plain:
            piece = sp.id_to_piece(i)
            steps, rest = self._merges(piece)
            if rest == 1:  # a piece that its own text doesn't lead to is in no encoding
                self.steps[i], self.size[i] = steps, len(piece)
                automaton.add_word(piece, i)
        automaton.make_automaton()
        self.matches = automaton.iter
        self.apart = Memo(self._stays_apart, memo_pairs)
        self.parts = TextMemo(self._encode_part, memo_parts)
        free = re.escape("".join(c for c in map(chr, range(32)) if c not in self.rank))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            self.cut = re.compile(f"[^{free}]+|[{free}]").findall
        else:
            beside = {pair for p in self.rank for pair in zip(p, p[1:]) if SPACE not in pair}
            signs, size = {c for p in self.rank for c in p if c != SPACE and not c.isalpha()}, -1
            while size != len(signs):  # signs that stand beside signs only
                size = len(signs)
                signs -= {c for a, b in beside if (a in signs) != (b in signs) for c in (a, b)}
            signs = re.escape("".join(sorted(c for c in signs if c < "\x7f" or any(c in pair for pair in beside))))
            self.cut = re.compile(f" *[^ {free}{signs}]+" + (f"| *[{signs}]+" if signs else "") + f"| +|[{free}]").findall

    def _merges(self, piece: str) -> tuple[list[tuple[float, str, str]], int]:
        """The merges of a piece on its own as (rank, first symbol, last symbol) after each, led by the start; symbols left."""
        symbols, steps = list(piece), [(0.0, piece[0], piece[-1])]
        while len(symbols) > 1:
            best, at = min((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == NEVER:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return steps, len(symbols)

    def _stays_apart(self, pair: int) -> bool:
        """Whether no merge crosses the border of two tokens while both are built, the lowest rank first, then the leftmost."""
        left, right = self.steps[pair >> 32], self.steps[pair & 0xFFFFFFFF]
        i = j = 0
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else NEVER
            next_right = right[j + 1][0] if j + 1 < len(right) else NEVER
            across = self.rank.get(left[i][2] + right[j][1], NEVER)
            if across < next_left and across <= next_right and across < NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _encode_part(self, part: str) -> tuple[int, ...]:
        part = part.replace(" ", SPACE)
        last, size, apart = [-1] * (len(part) + 1), self.size, self.apart
        for end, token in self.matches(part):
            if last[end + 1] < 0:
                before = last[end + 1 - size[token]]
                if before < 0 or apart[before << 32 | token]:
                    last[end + 1] = token
        ids, at = [], len(part)
        while at:
            token = last[at]
            if token < 0:  # a character without a piece: its bytes
                ids.extend(self.bytes[b] for b in reversed(part[at - 1].encode()))
                at -= 1
            else:
                ids.append(token)
                at -= size[token]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, as the library gives them without begin and end ids."""
        if not text:
            return []
        parts = self.parts
        return list(chain.from_iterable([parts[p] for p in self.cut(" " + text.replace(SPACE, " "))]))

    def decode(self, ids: list[int]) -> str:
        """The text that the library decodes the ids to."""
        return self.library.decode(ids)


def codec(model_file: str) -> PieceCodec:
    """The codec of a file, made once per Python worker."""
    return worker_model(("pieces", model_file), lambda: PieceCodec(model_file))


def encode_decode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (string); columns of these names are replaced.

    ``model_file`` is a path that every executor can open. Rows stay in their partitions; nothing is shuffled.
    """

    def compute(texts: list) -> list:
        c = codec(model_file)
        ids = [c.encode(t or "") for t in texts]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), [c.decode(x) if x else "" for x in ids]]

    return with_columns(docs, text, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, compute)
