"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word, lowered and set between marks, gives its subwords of 2 to 4 characters and itself, each hashed to one of
``BUCKETS`` embeddings. A text is the mean of its subwords' embeddings, and a linear softmax over it gives a probability
per language. Both layers are trained by stochastic gradient descent in numpy on lines of a bounded sample of labelled
documents (``per_language`` documents of every language, or all where there are fewer, drawn by a hash of id and text; fewer
where all languages would exceed ``sample`` documents, and of a long text as many characters as keep the whole sample below
``sample_chars``). No language is left out: where the sample can't hold a document of each, it is an error. A part of the
sample is held back: on it a temperature is chosen that gives the most likely scores, and the score below which a
prediction is rejected (``reject_share`` of the held-back lines fall below it).

As the layers are linear, the product of both matrices holds the scores of every subword, and words that occur again are
looked up in a bounded memo. Whole texts are read. Null texts and texts without letters are ``und`` with score 0 and are
rejected. Without labelled rows all texts are ``und``. Ties go to the language that sorts first. Repeated rows are
predicted each by itself. Input columns of the names made here are replaced; others stay.
"""

from __future__ import annotations

import re
import uuid
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.batches import Memo, with_columns, worker_model

BUCKETS, WIDTH = 1 << 15, 16
#: Scores that a worker's table of words holds, but 70,000 words at least.
CELLS = 20 << 20
UNDETERMINED = "und"
_words = re.compile(r"[^\W\d_]+").findall


class Model(NamedTuple):
    name: str
    languages: list[str]
    scores: np.ndarray  # of every bucket, per language
    temperature: float
    least: float


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def buckets(word: str) -> list[int]:
    """The embeddings of a word's subwords and of itself."""
    marked = f"<{word}>"
    n = len(marked)
    parts = [marked[i : i + k] for k in (2, 3, 4) for i in range(n - k + 1)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in [*parts, f"={word}"]]


def bag(words: list[str], known: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share) of the subwords of all words; ``known`` holds the buckets of a word."""
    found, n = np.unique(np.concatenate([known[w] for w in words]), return_counts=True)
    return found, (n / n.sum()).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = 5, rate: float = 0.5, held_share: int = 5, reject_share: float = 0.0005, seed: int = 7) -> Model | None:
    """Train on (text, language) rows; None without any."""
    lines = [(words_of(line), lang) for text, lang in rows for line in [text, *text.split("\n")]]
    lines = [(w, lang) for w, lang in lines if w]
    if not lines:
        return None
    languages = sorted({lang for _, lang in lines})
    number = {lang: k for k, lang in enumerate(languages)}
    known = Memo(lambda word: np.array(buckets(word), np.uint16), 100_000)  # goes with this call: the driver keeps no words
    bags = [(*bag(w, known), number[lang]) for w, lang in lines]
    del lines, known
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(bags))
    held = [bags[k] for k in order[: len(bags) // held_share]]
    used = [bags[k] for k in order[len(held) :]]
    embedding = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    linear = np.zeros((len(languages), WIDTH), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in draw.permutation(len(used)):
            found, share, truth = used[k]
            mean = share @ embedding[found]
            wrong = softmax(linear @ mean)
            wrong[truth] -= 1
            back = wrong @ linear
            linear -= step * np.outer(wrong, mean)
            embedding[found] -= step * share[:, None] * back * len(found) ** 0.5
    scores = embedding @ linear.T
    checked = held or used
    z = np.array([share @ scores[found] for found, share, _ in checked])
    truth = np.array([t for *_, t in checked])
    losses = {t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    temperature = float(min(losses, key=losses.get))
    least = float(np.quantile(softmax(z / temperature).max(axis=1), reject_share))
    return Model(uuid.uuid4().hex, languages, scores, temperature, min(least, 0.5))


def learn(
    labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = 150, sample: int = 9600, sample_chars: int = 64 << 20,
) -> Model | None:
    """Fit on a bounded sample of ``labelled`` with every language that has a text with letters."""
    h = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text), F.lit("langid"))
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h")).filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    languages = rows.select("lang").distinct().limit(sample + 1).count()
    if languages == 0:
        return None
    if languages > sample:
        raise ValueError(f"more than {sample} languages: raise ``sample``")
    each = min(per_language, sample // languages)
    chars = max(1, sample_chars // (languages * each))
    letter = F.greatest(F.lit(1), F.regexp_instr("text", F.lit(r"\p{L}")) - 1)  # a long text is cut from its first letter on
    cut = F.when(F.length("text") > chars, F.substring(F.col("text"), letter, F.lit(chars))).otherwise(F.col("text"))
    drawn = rows.select("lang", "h", cut.alias("text"))
    drawn = drawn.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).filter(F.col("place") <= each)
    return fit(sorted((r["text"], r["lang"]) for r in drawn.select("text", "lang").toLocalIterator()))


class Predictor:
    """The model in a worker: a table of scores per word that grows to ``limit`` rows and starts again."""

    def __init__(self, model: Model, limit: int | None = None):
        limit = limit or max(70_000, min(300_000, CELLS // (len(model.languages) + 1)))
        self.model, self.limit = model, limit
        self.table = np.zeros((limit + 1, len(model.languages) + 1), np.float32)
        self.rows = Memo(self._add, limit)

    def _add(self, word: str) -> int:
        row, found = len(self.rows), buckets(word)
        self.table[row, :-1] = self.model.scores[found].sum(axis=0)
        self.table[row, -1] = len(found)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated score)."""
        words = words_of(text)
        if not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        total = np.zeros(self.table.shape[1], np.float64)
        for at in range(0, len(words), 1 << 16):
            block, rows = words[at : at + (1 << 16)], self.rows
            if len(rows) + len(block) > self.limit:  # no start again within a block
                rows.clear()
            total += self.table[[rows[w] for w in block]].sum(axis=0, dtype=np.float64)
        p = softmax(total[:-1] / total[-1] / self.model.temperature)
        best = int(p.argmax())
        return self.model.languages[best], float(p[best])


def worker_predictor(model: Model) -> Predictor:
    """The predictor of a model, made once per Python worker."""
    return worker_model(("languages", model.name), lambda: Predictor(model))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (string), ``score`` (double, 0 to 1) and ``rejected`` (boolean)."""
    fields = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list) -> list:
        if sent.value is None:
            return [[UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)]
        predictor = worker_predictor(sent.value)
        found = [predictor.predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found], [f[0] == UNDETERMINED or f[1] < sent.value.least for f in found]]

    return with_columns(docs, text, fields, compute)
