"""Quality model, language identification, decontamination, rules and the pipeline, against brute force or held-out rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseweave.llm import decontam, langid, quality, queries, rules

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["the cat sat on the mat.\nA dog, too", "Über die Straße geht's", "", None, "ab", "the the the", "1 + 1 = 2 #$%", "été à l'école", "x" * 500]


def units(gram):
    """The four code units of a packed 4-gram."""
    return tuple((int(gram) >> k) & 0xFFFF for k in (48, 32, 16, 0))


def grams_of(text):
    return [units(g) for part in quality.grams(text) for g in part]


def plain_model(texts):
    """p(gram) of the interpolated model, straight from its definition."""
    counts = [None, *({} for _ in range(4))]
    counts[4] = Counter(g for t in texts if t for g in grams_of(t))
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    off = [None]
    for order in range(1, 5):
        n = [sum(v == k for v in counts[order].values()) for k in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        off.append([0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), float(k)) if n[k] else 0.5 * k for k in (1, 2, 3)])
    after = [None, *(defaultdict(dict) for _ in range(4))]
    for order in range(1, 5):
        for g, c in counts[order].items():
            after[order][g[:-1]][g[-1]] = c

    def p(gram):
        if not gram:
            return 1 / 65536
        seen, lower = after[len(gram)].get(gram[:-1]), p(gram[1:])
        if not seen:
            return lower
        d = off[len(gram)]
        total, c = sum(seen.values()), seen.get(gram[-1], 0)
        back = sum(d[min(x, 3)] for x in seen.values()) / total
        return (c - d[min(c, 3)]) / total + back * lower

    return p


def test_grams(monkeypatch):
    text = "aé\U0001F600\ud800z" * 5
    codes = [0, 0, 0, *np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist(), 0]
    want = [tuple(codes[k : k + 4]) for k in range(len(codes) - 3)]
    assert grams_of(text) == want
    monkeypatch.setattr(quality, "CHUNK", 7)  # a long text in parts
    assert grams_of(text) == want and len(list(quality.grams(text))) > 3


def test_model_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 60)  # several blocks
    trusted = [t for t in TEXTS if t] * 2 + ["the end", "Слово и дело", "漢字かな交じり文", "\U0001F600 smile"]
    docs = spark.createDataFrame([(t,) for t in [*trusted, None, ""]], "text string").repartition(3)
    model, p = quality.train(docs), plain_model(trusted)
    draw, seen = random.Random(1), [g for t in trusted for g in grams_of(t)]
    wanted = {*seen, *[g[:3] + (draw.choice(seen)[3],) for g in seen], *[tuple(draw.randrange(65536) for _ in range(4)) for _ in range(200)]}
    packed = [((a << 48 | b << 32 | c << 16 | d) ^ (1 << 63)) - (1 << 63) for a, b, c, d in wanted]
    got = {units(r["gram"]): r["p"] for r in quality.probabilities(spark.createDataFrame([(g,) for g in packed], "gram long"), model).collect()}
    assert got.keys() == wanted and all(math.isclose(got[g], p(g), rel_tol=1e-9) for g in wanted)
    letters = {g[3] for g in seen}
    for context in [(0, 0, 0), seen[5][:3], seen[-3][:3], (1, 2, 3)]:  # the shares of all units are one
        unseen = next(k for k in range(40000, 65536) if k not in letters)
        assert math.isclose(sum(p((*context, k)) for k in letters) + (65536 - len(letters)) * p((*context, unseen)), 1, rel_tol=1e-9)
    texts = [*TEXTS, "Слово", "漢字", "x" * 500, "\U0001F600", "unseen ☃ words"]
    rows = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "k int, text string, nll string").repartition(2)
    scored = {r["k"]: r for r in quality.score(rows, model).collect()}
    assert len(scored) == len(texts)
    for k, t in enumerate(texts):
        want = -sum(math.log(p(g)) for g in grams_of(t)) if t else 0
        assert math.isclose(scored[k]["nll"], want, rel_tol=1e-5, abs_tol=1e-6) and scored[k]["n_predicted"] == (len(grams_of(t)) if t else 0) and scored[k]["text"] == t
    assert quality.score(rows.limit(0), model).count() == 0
    same = quality.score(spark.createDataFrame([(texts[0],)] * 40, "text string").repartition(2), model)  # equal blocks
    assert same.count() == 40 and same.select(F.round("nll", 6)).distinct().count() == 1


def test_model_grows_with_the_text(spark):
    """Each script has letters of its own, and more text of new words is a larger model."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("абвгдежзиклмнопрст") for _ in range(7))
    texts = [(" ".join(word() for _ in range(300)),) for _ in range(8)]
    few, many = (quality.train(spark.createDataFrame(texts[:k], "text string")) for k in (1, 8))
    assert many[3][0].count() > 5 * few[3][0].count()


def test_repeated_words_are_rejected(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    odd = [(-1, "en", "the " * 600), (-2, "de", "der " * 600), (-3, "fr", "de " * 600), (-4, "es", "que " * 600), (-5, "en", "Абвг где жзик. " * 40)]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality.classify(docs.union(spark.createDataFrame(odd, docs.schema)), labels).select("doc_id", "kept")
    good = quality.trusted_rows(got, labels, "doc_id")
    assert got.filter("doc_id < 0 and kept").count() == 0 and good.filter("not kept").count() == 0


def test_classifier(spark, monkeypatch):
    draw = random.Random(3)
    words = ["the", "of", "and", "thing", "other", "inner", "reed", "stone"]
    good = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(k, good(draw.randint(2, 80)), ["en", "de", None][k % 3], 0.5) for k in range(300)]
    rows += [(k, "$$#!% ZXQ <<||>> %%%%%% QQQ #### ZZZZ" * 3, "en", 0.5) for k in range(300, 330)] + [(400, None, None, 0.5), (401, "", "fr", 0.5), (None, good(30), "fr", 0.5), (7, rows[7][1], "de", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept double").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 300, 2)] + [(k, 0, 0) for k in range(300, 310)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "perplexity", "kept"])
    kept = {(r["doc_id"], r["text"]): r["kept"] for r in got.collect()}
    assert sum(not kept[r[0], r[1]] for r in rows[:300]) <= 6 and not any(kept[r[0], r[1]] for r in rows[300:332]) and kept[None, rows[332][1]]
    monkeypatch.setattr(quality, "SENT_IDS", 0)  # documents and labels by a shuffle
    assert {(r["doc_id"], r["text"]): r["kept"] for r in quality.classify(docs, labels).collect()} == kept
    assert {r["doc_id"] for r in quality.classify(docs, labels.limit(0)).filter("not kept").collect()} == {400, 401}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert queries.op9(spark, FOLDER).filter("held_out").join(docs, "doc_id").filter("lang_pred = lang").count() >= 0.95 * docs.filter(queries.held_out()).count()
    rows = [("the thing of other reason", "en"), ("der die und ist nicht", "de")] * 30 + [("words without a language", None)]
    model = langid.learn(spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 !? \n ½ ²"), (4, "die und der nicht"), (4, "die und der nicht"), (5, "The Thing " * 70_000)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(*o, "x") for o in odd], "doc_id long, text string, score string"), model).collect()}
    assert all(tuple(got[k])[2:] == ("und", 0.0, True) for k in (1, 2, 3)) and got[4]["lang_pred"] == "de" and got[5]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.learn(docs.limit(0)) is None
    assert langid.identify(docs.limit(3), None).filter("lang_pred <> 'und' or not rejected").count() == 0
    small = langid.Predictor(model, limit=70_000)
    many = " ".join("w" + "abcdefghij"[k % 10] * (k % 7) + "abcdefghij"[k // 10 % 10] + "xyzuv"[k // 100 % 5] * (k // 500) for k in range(1, 3000))
    assert small.predict(many) == langid.Predictor(model).predict(many)


def items_and_passages(seed=4):
    draw = random.Random(seed)
    words = ["the", "of", "a"] * 20 + [f"w{k}" for k in range(400)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(3, 40))) + draw.choice(["", "\nanswer w1 w2 w3", ". The last one."])) for k in range(120)]
    docs = [None, "", "  ", "the of a " * 500]
    for _ in range(150):
        parts = [draw.choice(words) for _ in range(draw.randint(0, 300))]
        for _ in range(draw.randint(0, 2)):
            leak = draw.choice(items)[1].split()
            for _ in range(draw.randint(0, 3)):
                leak[draw.randrange(len(leak))] = draw.choice(words)
            at = draw.randint(0, len(parts))
            parts[at:at] = leak
        docs.append(" ".join(parts))
    return [*items, (900, None), (901, ""), (902, items[0][1])], docs


def test_search_equals_brute_force():
    items, docs = items_and_passages()
    frequency = Counter(t for _, text in items for t in set(decontam.words_of(text)))
    index = decontam.Index([i for i in items if i[1]], frequency, 121, 20.0)
    draw = random.Random(8)
    for _ in range(200):
        terms = set(draw.sample(sorted(index.terms), draw.randint(1, 60))) | set(draw.choice(index.items).words) | {"unknown"}
        want = {}
        for t in terms & set(index.terms):
            for item, impact in zip(index.terms[t][0], index.terms[t][1]):
                want[item] = want.get(item, 0) + impact
        want = {k: v for k, v in want.items() if v >= 1 - 1e-9}
        got = dict(index.search(terms))
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    found = 0
    for doc in docs:  # all passages against all items, without the index
        words, want = decontam.words_of(doc), set()
        for start in range(0, max(1, len(words) - index.span), index.span):
            passage = words[start : start + 2 * index.span]
            want |= {i.item_id for i in index.items if passage and index.verify(i, index.present(passage, i))}
        assert {m[0] for m in index.matches(doc)} == want
        found += len(want)
    assert found > 30


def test_decontamination(spark, monkeypatch):
    items, texts = items_and_passages()
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(None, items[3][1], 1)], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert (None, 3) in whole and not any(i in (900, 901) for _, i in whole) and all((d, 902) in whole for d, i in whole if i == 0)
    clean = decontam.without_items(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in whole}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 4000)  # several blocks of items
    blocks = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert {d for d, _ in blocks} == {d for d, _ in whole}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.without_items(docs, bench.limit(0)).count() == docs.count()


RULE_TEXTS = [
    None, "", " \n ", "one two", "a b c d e " * 40, "line of words\n" * 12, "## $$ %% && ** || << >> a b", "WORDS IN CAPITALS ONLY ARE SHOUTED AT READERS ALL DAY",
    "plain words that nobody could ever mind in any way at all", "x" * 5000, "i " * 30, "é\x0bü\x0cß\r\n" * 20, "same line here\nother line\nsame line here",
]


def test_rules(spark):
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(RULE_TEXTS)] + [(3, "one two", "z")], "doc_id long, text string, FAILED string")
    entered = rules.ledger(rules.measure(docs))
    rows = {r["doc_id"]: r for r in entered.collect()}
    for k, text in enumerate(RULE_TEXTS):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))
        assert tuple(rows[k][c] for c in rules.MEASURES[:5]) == want
    judged = {r["doc_id"]: r for r in rules.judge(entered).collect()}
    assert [k for k, r in judged.items() if r["kept"]] == [8, *[k for k in judged if k > 8 and judged[k]["failed"] == 0]]
    assert {k for k, r in judged.items() if r["base_failed"]} == {k for k, r in judged.items() if r["failed"] & 3}
    bits = [r["failed"] for r in entered.collect()]
    for r in rules.ablations(entered).collect():
        bit = rules.mask([r["rule"]])
        assert r["failing"] == sum(b & bit > 0 for b in bits) and r["alone"] == sum(b == bit for b in bits)
    assert rules.judge(rules.ledger(rules.measure(docs.limit(0)))).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_dedup", "decontamination", "encode"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, before, FOLDER)
        kept, given = after.collect(), before.collect()
        assert after.columns == docs.columns and not Counter(kept) - Counter(given)
        before = spark.createDataFrame(kept, docs.schema)
    rows = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in before.collect())
    marked = before.count()
    assert rows.count() == marked > 100 and rows.filter("sha2(text, 256) <> decoded_sha256").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_other_columns(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    function = corpus_pipeline.STAGES[stage][1]
    assert function(spark, docs, FOLDER).count() == 0
    odd = spark.createDataFrame([(None, None, None, "a"), (1, "", None, "b"), (1, "", None, "b")], "doc_id long, text string, lang string, trusted_id string")
    assert function(spark, odd, FOLDER).count() <= 3


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_of_any_name(spark, stage):
    """Columns that have the names of the stages' own are neither lost nor overwritten."""
    names = "nll n_predicted perplexity kept score lang_pred rejected fingerprint component_id row root first ids decoded n_tokens trusted_id in0 in1".split()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    odd = docs.selectExpr("*", *[f"concat('{n} ', doc_id) AS {n}" for n in names])
    after = corpus_pipeline.STAGES[stage][1](spark, odd, FOLDER)
    assert after.columns[: len(odd.columns)] == odd.columns
    rows = after.collect()
    assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)
