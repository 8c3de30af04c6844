"""One-word edits of test items at every position against brute force."""

import pytest

from caseweave.llm import decontam


def plain_overlap(item, passage, size=5):
    cut = lambda w: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return len(cut(item) & cut(passage)) / len(cut(item))


@pytest.mark.parametrize("n_answer", range(2, 13))
@pytest.mark.parametrize("edit", ["change", "drop", "add"])
def test_one_word_edits(n_answer, edit):
    question, answer = [f"q{k}" for k in range(36)], [f"a{k}" for k in range(n_answer)]
    item = question + answer
    index = decontam.Index([(1, " ".join(question) + "\n" + " ".join(answer))], {}, 50, 40.0)
    for at in range(len(item)):
        changed = [*item[:at], *([] if edit == "drop" else ["other"]), *item[at + (edit != "add") :]]
        text = " ".join(["before"] * 7 + changed + ["after"] * 7)
        assert bool(index.matches(text)) == (plain_overlap(item, changed) >= 0.8), at


def test_question_with_another_answer():
    question = [f"q{k}" for k in range(40)]
    index = decontam.Index([(1, " ".join(question) + "\nthe right answer")], {}, 50, 40.0)
    assert index.matches(" ".join([*question, "the", "right", "reply", "is"]))
    for other in ("quite another thing", "another thing that the reader says", "", "answer right the"):
        assert not index.matches(" ".join([*question, *other.split()]))


def test_items_without_an_id_are_found(spark):
    text = "What is the colour of the old house on the hill by the sea? It is a faded shade of green with white windows."
    items = spark.createDataFrame([(None, text), (None, "Which of these rivers is the longest one in the north of the land? The grey river."), (4, "Other words entirely are in this question, aren't they? Yes.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "nothing of that kind is in here"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()] == [(1, None)]
    assert sorted(r["doc_id"] for r in decontam.without_items(docs, items).collect()) == [2, 3]
