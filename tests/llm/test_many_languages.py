"""Languages beyond the number that the sample holds at full size."""

import gc
import random
import tracemalloc

import pytest

from caseweave.llm import langid


def corpus(n, docs=3, seed=3):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        parts = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        rows += [(" ".join("".join(draw.choices(parts, k=2)) for _ in range(40)), f"l{k:03d}") for _ in range(docs)]
    return [(i, *r) for i, r in enumerate(rows)]


def test_every_language_is_learnt(spark):
    rows = [*corpus(80), (998, "123 !", "digits"), (999, None, "nothing")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:03d}" for k in range(80)]


def test_a_language_of_one_very_long_text(spark):
    rows = [*corpus(20), (998, " 1 2 " + "lorem ipsum dolor " * 70_000, "long"), (999, "short words here", "short")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_chars=100_000)
    assert {"long", "short"} < set(model.languages) and len(model.languages) == 22


def test_equal_ids_are_drawn_apart(spark):
    rows = [(None, f"some words number{i} of this one", "x") for i in range(400)] + [(1, "andere sprache hier", "y")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5)
    assert model.languages == ["x", "y"]


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.learn(docs, sample=3)


def test_fit_keeps_no_words_in_the_driver():
    rng = random.Random(3)
    rows = [(" ".join("".join(rng.choices("abcdefghijklm", k=9)) for _ in range(500)), f"l{k % 2}") for k in range(40)]
    tracemalloc.start()
    model = langid.fit(rows)
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < model.scores.nbytes + (2 << 20)
