import re
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

from caseweave.operators import clusters, kernels, lowrank, models, search, terms
from caseweave.session import stage


def unit_weights(spark, rows):
    return spark.createDataFrame(
        [(d, t, w / sum(x * x for x in row.values()) ** 0.5) for d, row in rows.items() for t, w in row.items()],
        "doc_id LONG, term STRING, w DOUBLE",
    )


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_document_pairs_match_brute_force(spark, threshold):
    rng = Random(5)
    rows = {d: {f"t{min(int(rng.expovariate(0.15)), 30)}": rng.uniform(0.1, 2) for _ in range(6)} for d in range(60)}
    for d in range(60, 80):  # a quarter of the rows are copies of one row
        rows[d] = rows[0]
    got = {(r.doc_a, r.doc_b): r.similarity for r in search.pairwise_doc_similarity(unit_weights(spark, rows), threshold).collect()}
    length = lambda r: sum(x * x for x in r.values()) ** 0.5
    expected = {(0, d): 1.0 for d in range(60, 80)}
    for a, b in combinations(range(60), 2):
        s = sum(w * rows[b].get(t, 0) for t, w in rows[a].items()) / length(rows[a]) / length(rows[b])
        if s >= threshold:
            expected[a, b] = s
    assert got == pytest.approx(expected)


def tagged(spark, n=40, dims=4):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=dims)], sorted(set(rng.choice(list("abcd"), rng.integers(1, 4)).tolist()))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id LONG, vector ARRAY<DOUBLE>, tags ARRAY<STRING>")


def brute_tag_score(rows, weights=None):
    scale = np.ones(len(rows[0][1])) if weights is None else np.array(weights)
    total = 0.0
    for a, b in combinations(rows, 2):
        x, y = np.array(a[1]) * scale, np.array(b[1]) * scale
        s = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
        total += s if set(a[2]) & set(b[2]) else -s
    return total / (len(rows) * (len(rows) - 1) / 2)


def test_tag_score_and_weight_search(spark):
    rows, df = tagged(spark)
    assert clusters.inter_tag_score(df).first()[0] == pytest.approx(brute_tag_score(rows))
    weights = [1.0, 0.5, -2.0, 3.0]
    column = F.array(*[F.lit(w) for w in weights])
    assert clusters.inter_tag_score(df, column).first()[0] == pytest.approx(brute_tag_score(rows, weights))
    best = clusters.tune_similarity_weights(df, 4, iters=5).first()
    assert best.score == pytest.approx(brute_tag_score(rows, best.weights))


def test_tag_score_with_many_tags(spark):
    rng = np.random.default_rng(3)
    names = [f"t{i}" for i in range(15)]
    rows = [(i, [float(x) for x in rng.normal(size=4)], names if i == 0 else list(rng.choice(names, 3))) for i in range(60)]
    df = spark.createDataFrame([(i, v, [str(x) for x in t]) for i, v, t in rows], "id LONG, vector ARRAY<DOUBLE>, tags ARRAY<STRING>")
    assert clusters.inter_tag_score(df).first()[0] == pytest.approx(brute_tag_score(rows))


def test_group_score(spark):
    rows, df = tagged(spark)
    rows = [(i, v, [t[0]]) for i, v, t in rows]
    df = df.withColumn("g", F.col("tags")[0])
    assert clusters.inter_group_score(df, "g").first()[0] == pytest.approx(brute_tag_score(rows))


def test_word_means_count_unknown_words_and_mask_digits(spark):
    tf = spark.createDataFrame([(1, "ab", 2, 4), (1, "x9", 1, 4), (1, "zz", 1, 4)], "doc_id INT, term STRING, tf LONG, doc_len LONG")
    embedding = spark.createDataFrame([("ab", [1.0, 0.0]), ("x#", [0.0, 2.0])], "word STRING, vector ARRAY<DOUBLE>")
    assert search.embed_by_word_mean(tf, embedding).first().vector == [0.5, 0.5]


def test_a_large_word_table_moves_no_vectors_with_terms(spark):
    """Words in several blocks: every join is by a block that goes to all tasks, and a document is one sum."""
    rows = [(d, f"w{(7 * d + j) % 40}", 1 + j, 30) for d in range(9) for j in range(12)]
    words = {f"w{i}": [i / 8, 1.0 - i] for i in range(0, 40, 2)}
    tf = spark.createDataFrame(rows, "doc_id INT, term STRING, tf LONG, doc_len LONG")
    embedding = spark.createDataFrame([*words.items()], "word STRING, vector ARRAY<DOUBLE>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        means = search.embed_by_word_mean(tf, embedding, send_bytes=400)
        plan = means._jdf.queryExecution().sparkPlan().toString()
        got = {r.doc_id: r.vector for r in means.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") > 1 and "SortMergeJoin" not in plan
    for d in range(9):
        want = sum(n * np.array(words[w]) for k, w, n, _ in rows if k == d and w in words) / 30
        assert np.allclose(got[d], want)


def test_blocks_of_a_word_table_are_sent_a_few_at_a_time(spark):
    """The driver holds what it sends: a table of many blocks is many jobs of at most AT_ONCE."""
    rows = [(d, f"w{(7 * d + j) % 40}", 1 + j, 30) for d in range(9) for j in range(12)]
    words = {f"w{i}": [i / 8, 1.0 - i] for i in range(0, 40, 2)}
    tf = spark.createDataFrame(rows, "doc_id INT, term STRING, tf LONG, doc_len LONG")
    embedding = spark.createDataFrame([*words.items()], "word STRING, vector ARRAY<DOUBLE>")
    means = search.embed_by_word_mean(tf, embedding, send_bytes=200)
    assert 0 < means._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= search.AT_ONCE < 20 * 80 // 200
    got = {r.doc_id: r.vector for r in means.collect()}
    for d in range(9):
        want = sum(n * np.array(words[w]) for k, w, n, _ in rows if k == d and w in words) / 30
        assert np.allclose(got[d], want)


def test_word_vectors_with_gaps_are_an_error(spark):
    tf = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 2)], "doc_id INT, term STRING, tf LONG, doc_len LONG")
    for other in ([None, 1.0], [1.0]):
        embedding = spark.createDataFrame([("a", [1.0, 0.0]), ("b", other)], "word STRING, vector ARRAY<DOUBLE>")
        with pytest.raises(ValueError):
            search.embed_by_word_mean(tf, embedding)


def test_targets_go_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(1500)], "id LONG, vector ARRAY<DOUBLE>")
    assert len(search.target_blocks(df, 10_000)) == 6 and len(search.target_blocks(df)) == 1
    assert sum(b.count() for b in search.target_blocks(df, 10_000)) == 1500
    few = df.where("id < 3")
    scores = search.cross_scores(few, df, lambda a, b: a[0] + b[0])
    assert scores.count() == 4500 and scores.where("score <> id + target").isEmpty()


def test_terms_are_counted_some_documents_at_a_time(monkeypatch):
    """An Arrow batch of many tokens is counted in runs of documents, a long one alone."""
    lists = pa.array([["a"] * n for n in (3, 4, 0, 2, 50, 1, 9, 1)] + [None, ["b" * 100, None], [], []])
    monkeypatch.setattr(terms, "COUNTED", 10)
    runs = [*terms.token_slices(lists)]
    assert runs[0][0] == 0 and runs[-1][1] == len(lists) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert all(b - a == 1 or sum(len(x or ()) for x in lists[a:b].to_pylist()) <= 10 for a, b in runs) and (4, 5) in runs
    monkeypatch.setattr(terms, "COUNTED_BYTES", 20)
    assert (9, 10) in terms.token_slices(lists) and [*terms.token_slices(lists[:0])] == []


def test_terms_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(7, ["b", "a", "b"]), (8, []), (9, None), (10, ["a", None])], "doc_id INT, tokens ARRAY<STRING>")
    tf = terms.term_freq(docs)
    assert sorted(tuple(r) for r in tf.collect()) == [(7, "a", 1, 3), (7, "b", 2, 3), (10, "a", 1, 2)]
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()


def test_clusters_of_many_features(spark):
    weights = spark.range(70_000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("t"), "id").alias("term"), F.lit(1.0).alias("w"))
    vectors = models.sparse_vectors(weights, models.numbered_terms(weights.select("term")))
    assert models.kmeans_docs(vectors, 3, max_iter=2).count() == 20


def test_kernel_takes_strips(monkeypatch):
    from caseweave.operators import kernels

    a, b = "the quick brown fox " * 6, "a quack brawn box of the " * 5
    whole = kernels.subsequence_kernel(a, b)
    monkeypatch.setattr(kernels, "CELLS", 300)
    assert kernels.subsequence_kernel(a, b) == pytest.approx(whole)


def naive_kernel(a, b, lam, p):
    """Sum over all index tuples that spell the same string."""
    weights = lambda s: [("".join(s[i] for i in ix), lam ** (ix[-1] - ix[0] + 1)) for ix in combinations(range(len(s)), p)]
    return sum(x * y for u, x in weights(a) for v, y in weights(b) if u == v)


@pytest.mark.parametrize("a,b,p", [("cat", "cart", 2), ("abcab", "bcaba", 3), ("gatta", "cata", 2), ("banana", "bandana", 4), ("ab", "abc", 3)])
def test_string_kernel(a, b, p):
    assert kernels.subsequence_kernel(a, b, 0.5, p) == pytest.approx(naive_kernel(a, b, 0.5, p))


def test_string_kernel_long_texts_cross_blocks():
    a, b = "ab" * 70, "ba" * 75
    k = np.zeros((len(a) + 1, len(b) + 1))
    total = 0.0
    for i, x in enumerate(a):  # length 2 by its recursion
        for j, y in enumerate(b):
            if x == y:
                total += 0.25 * k[i, j]
            k[i + 1, j + 1] = (0.25 if x == y else 0.0) + 0.5 * k[i, j + 1] + 0.5 * k[i + 1, j] - 0.25 * k[i, j]
    assert kernels.subsequence_kernel(a, b, 0.5, 2) == pytest.approx(total)


def test_string_kernels_side_by_side():
    rng = Random(4)
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 30))) for _ in range(60)] + ["ab" * 600, "ba" * 700]
    pairs = [*zip(texts, texts[::-1], strict=True)]
    assert kernels.subsequence_kernels(pairs, 0.5, 3) == pytest.approx([kernels.subsequence_kernel(a, b, 0.5, 3) for a, b in pairs])


def test_kernel_candidates_come_once_and_both_ways(spark):
    rng = Random(8)
    texts = [" ".join(rng.choices("abcde", k=6)) for _ in range(80)] + ["x", " "]
    df = spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "id STRING, text STRING")
    once = {(r.id_a, r.id_b): (r.text_a, r.text_b) for r in kernels.shingle_candidates(df, 2, 0.6, both_ways=False).collect()}
    both = [(r.id_a, r.id_b) for r in kernels.shingle_candidates(df, 2, 0.6).collect()]
    assert once and all(a < b for a, b in once) and sorted(both) == sorted([*once, *[(b, a) for a, b in once]])
    grams = lambda t: {tuple(w[i : i + 2]) for w in [t.split()] for i in range(len(w) - 1)}
    assert all(len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > 0.4 for a, b in once.values())
    pairs = spark.createDataFrame([(1, 2, "cat", "cart")], "id_a INT, id_b INT, text_a STRING, text_b STRING")
    assert {(r.id_a, r.id_b) for r in kernels.string_kernel_pairs(pairs, p=2, mirrored=True).collect()} == {(1, 2), (2, 1)}


def test_kernel_pairs_are_scaled_per_item(spark):
    pairs = spark.createDataFrame([(1, 1, "cat", "cart"), (1, 2, "cat", "cat"), (2, 1, "xy", "cat")], "id_a INT, id_b INT, text_a STRING, text_b STRING")
    rows = kernels.string_kernel_pairs(pairs, p=2).collect()
    assert sum(r.similarity**2 for r in rows if r.id_a == 1) == pytest.approx(1.0)
    assert [r.similarity for r in rows if r.id_a == 2] == [None]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    a = rng.random((30, 8)) * (rng.random((30, 8)) < 0.6) + np.eye(30, 8)
    rows = [(d, f"t{j}", float(a[d, j])) for d in range(30) for j in range(8) if a[d, j]]
    return a, spark.createDataFrame(rows, "doc_id LONG, term STRING, w DOUBLE")


def test_lsa_properties(matrix):
    a, weights = matrix
    model = models.Lsa(weights, 4)
    sigma = [r.sigma for r in model.sigma.orderBy("concept").collect()]
    assert sigma == pytest.approx(np.linalg.svd(a, compute_uv=False)[:4].tolist(), rel=1e-6) and sigma == sorted(sigma, reverse=True)
    v = np.array([r.vector for r in model.v.orderBy("term").collect()])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    us = np.array([r.vector for r in model.us.orderBy("doc_id").collect()])
    assert np.allclose(us, a[model_rows(a)] @ v, atol=1e-8)
    assert (v[abs(v).argmax(axis=0), range(4)] > 0).all()
    related = models.related_terms(model, "t3", 3).collect()
    assert related[0].term == "t3" and related[0].score == pytest.approx(1.0)
    shares = [r.explained for r in models.explained_variance_sweep(model, weights, 40, (1, 2, 4)).orderBy("k").collect()]
    assert shares == sorted(shares) and 0 < shares[0] and shares[-1] <= 1


def model_rows(a):
    return [i for i in range(len(a)) if a[i].any()]


def test_kmeans_is_repeatable_and_keeps_empty_documents(spark, matrix):
    weights = matrix[1]
    terms = models.numbered_terms(weights.select("term").distinct())
    vectors = models.sparse_vectors(weights, terms, docs=spark.range(40).withColumnRenamed("id", "doc_id"))
    assert vectors.count() == 40
    runs = [{r.doc_id: r.cluster for r in models.kmeans_docs(vectors, 3).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 40
    both = models.two_level_clusters(vectors, vectors, 3, 2).collect()
    assert len(both) == 40 and len({r.doc_id for r in both}) == 40


def test_forest_proximity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(loc=(i % 2) * 8, size=3)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id LONG, vector ARRAY<DOUBLE>, group INT")
    leaves = models.rf_leaves(df.select("id", "vector"), trees=10).persist()
    assert leaves.count() == 600
    to_first = {r.id: r.proximity for r in models.rf_proximity_to(leaves, 0, 10).collect()}
    assert to_first[0] == 1.0 and all(0 < p <= 1 for p in to_first.values())
    own = {r.id: r.proximity for r in models.rf_group_proximity(leaves, df.select("id", "group"), 10).collect()}
    expected = sum(p for i, p in to_first.items() if i and i % 2 == 0) / 29
    assert own[0] == pytest.approx(expected)


def test_shingle_candidates(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [("a", base), ("b", base + " eleven"), ("c", base), ("d", "quite another text of other words"), ("e", ""), ("f", None), ("g", "short")]
    got = kernels.shingle_candidates(spark.createDataFrame(rows, "id STRING, text STRING")).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [("a", "b"), ("b", "a")]


def test_pairs_with_cut_postings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(d, f"t{t}", float(rng.random())) for d in range(40) for t in rng.choice(12, 5, replace=False)]
    weights = terms.l2_normalize(spark.createDataFrame(rows, "doc_id LONG, term STRING, w DOUBLE"))
    whole = sorted((r.doc_a, r.doc_b) for r in search.pairwise_doc_similarity(weights, 0.6).collect())
    monkeypatch.setattr(search, "POSTINGS", 3)
    assert sorted((r.doc_a, r.doc_b) for r in search.pairwise_doc_similarity(weights, 0.6).collect()) == whole and whole


def brute_products(weights, least):
    """Pairs of ids by the product of their summed weights per term."""
    rows = {}
    for d, t, w in weights:
        rows.setdefault(d, {}).setdefault(t, 0.0)
        rows[d][t] += w
    dots = {(a, b): sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items()) for a, b in combinations(sorted(rows), 2)}
    return {k: s for k, s in dots.items() if s >= least}


def test_copies_are_in_every_pair(spark, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 7)
    monkeypatch.setattr(search, "COPIES", 3)
    rng = np.random.default_rng(9)
    rows = {d: {f"t{t}": float(rng.random()) for t in rng.choice(9, 4, replace=False)} for d in range(20)}
    rows |= {d: rows[d % 3] for d in range(20, 34)}
    df = unit_weights(spark, rows)
    got = search.pairwise_doc_similarity(df, 0.6, every_pair=True).collect()
    want = brute_products([tuple(r) for r in df.collect()], 0.6)
    assert {(r.doc_a, r.doc_b): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)
    assert (20, 23) in want and any(a < 20 <= b and rows[a] is not rows[b] for a, b in want)


def test_repeated_ids_lose_no_pair(spark, monkeypatch):
    """Weights of repeated ids have norm 1 as a list and a larger one when equal terms are added up."""
    monkeypatch.setattr(search, "POSTINGS", 9)
    for seed in range(6):
        rng = np.random.default_rng(seed)
        rows = [(d, f"t{t}", float(rng.random())) for d in range(24) for _ in range(1 + d % 3) for t in rng.choice(14, 5, replace=False)]
        weights = terms.l2_normalize(spark.createDataFrame(rows, "doc_id LONG, term STRING, w DOUBLE"))
        got = {(r.doc_a, r.doc_b): r.similarity for r in search.pairwise_doc_similarity(weights, 0.7, every_pair=True).collect()}
        assert got == pytest.approx(brute_products([tuple(r) for r in weights.collect()], 0.7)) and got


@pytest.mark.parametrize("most", [1 << 19, 7])
def test_unit_weights_of_whole_documents_are_not_shuffled(spark, monkeypatch, most):
    """Documents are weighed where they lie, however they are cut into batches; a vocabulary too large for a task is joined."""
    monkeypatch.setattr(terms, "WEIGHTED", most)
    docs = [(d, [f"t{(d * k) % 17}" for k in range(1 + d % 9)] + [None] * (d % 2)) for d in range(60)]
    df = spark.createDataFrame([*docs, (60, []), (61, None), (None, ["t1", "t2"])], "doc_id LONG, tokens ARRAY<STRING>").coalesce(2)
    tf = terms.term_freq(df)
    vocabulary = terms.bound_vocabulary(tf, 62.0, 3, 0.5)
    old = terms.tfidf(tf, 62.0, "smooth", by_length=False, l2=True, vocabulary=vocabulary)
    new = terms.tfidf(tf, 62.0, "smooth", by_length=False, l2=True, vocabulary=vocabulary, together=True)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan
    want = {(r.doc_id, r.term): r.w for r in old.collect()}
    assert {(r.doc_id, r.term): r.w for r in new.collect()} == pytest.approx(want) and len(want) > 100
    monkeypatch.setattr(terms, "VOCABULARY", 10)
    joined = terms.tfidf(tf, 62.0, "smooth", by_length=False, l2=True, vocabulary=vocabulary, together=True)
    assert {(r.doc_id, r.term): r.w for r in joined.collect()} == pytest.approx(want)


def test_similar_documents_are_scored_where_they_lie(spark, monkeypatch):
    """Sums of a query and a document are not shuffled; a task has a bounded number of products."""
    rng = np.random.default_rng(8)
    rows = {d: {f"t{t}": float(rng.random()) for t in rng.choice(12, 5, replace=False)} for d in range(50)}
    weights = unit_weights(spark, rows)
    idf = spark.createDataFrame([(f"t{t}", 1.0 + t / 9) for t in range(11)], "term STRING, idf DOUBLE")
    asked = {q: {f"t{t}": 1 + (q + t) % 3 for t in range(q, q + 4)} for q in range(6)}
    query_tf = spark.createDataFrame([(q, t, n) for q, row in asked.items() for t, n in row.items()], "query_id LONG, term STRING, tf LONG")
    monkeypatch.setattr(search, "SCORED", 20)
    df = search.similar_docs(query_tf, idf, weights, 4, 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\w+, doc_id", plan) and "REPARTITION_BY_NUM" in plan
    unit = {r.doc_id: {} for r in weights.collect()}
    for r in weights.collect():
        unit[r.doc_id][r.term] = r.w
    want = set()
    for q, row in asked.items():
        w = {t: n * (1.0 + int(t[1:]) / 9) for t, n in row.items() if int(t[1:]) < 11}
        length = sum(x * x for x in w.values()) ** 0.5
        scores = sorted((-round(sum(x * u.get(t, 0.0) for t, x in w.items()) / length, 9), d) for d, u in unit.items() if set(u) & set(w))
        want |= {(q, d, i + 1) for i, (_, d) in enumerate(scores[:5]) if i}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in df.collect()} == want


def test_search_is_dealt_by_document(spark, monkeypatch):
    """A task scores a bounded number of term pairs, whatever the number of documents."""
    rng = np.random.default_rng(4)
    rows = [(d, f"t{t}", int(rng.integers(1, 5)), 9) for d in range(60) for t in rng.choice(8, 4, replace=False)]
    tf = spark.createDataFrame(rows, "doc_id LONG, term STRING, tf LONG, doc_len LONG")
    asked = spark.createDataFrame([(q, f"t{t}", 1, 3) for q in range(4) for t in range(q, q + 3)], "query_id LONG, term STRING, tf LONG, doc_len LONG")
    whole = [tuple(r) for r in search.search_posts(asked, tf, 10).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search, "SCORED", 20)
    cut = search.search_posts(asked, tf, 10)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)[1]) == sum((d[1] in {f"t{t}" for t in range(q, q + 3)}) for d in rows for q in range(4)) // 20 + 1
    found = [tuple(r) for r in cut.orderBy("query_id", "rank").collect()]
    assert [r[:2] for r in found] == [r[:2] for r in whole] and [r[2] for r in found] == pytest.approx([r[2] for r in whole])


def test_pairs_join_no_postings(spark, monkeypatch):
    """Blocks of rows are compared in their tasks: no candidate pair is joined, shuffled or written."""
    monkeypatch.setattr(search, "POSTINGS", 7)
    rng = np.random.default_rng(3)
    rows = {d: {f"t{t}": float(rng.random()) for t in rng.choice(9, 4, replace=False)} for d in range(30)}
    df = search.pairwise_doc_similarity(unit_weights(spark, rows), 0.5)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    length = lambda r: sum(x * x for x in r.values()) ** 0.5
    scores = {(a, b): sum(w * rows[b].get(t, 0) for t, w in rows[a].items()) / length(rows[a]) / length(rows[b]) for a, b in combinations(rows, 2)}
    assert {(r.doc_a, r.doc_b): r.similarity for r in df.collect()} == pytest.approx({k: s for k, s in scores.items() if s >= 0.5})


@pytest.mark.parametrize("held", [20_000, 7])
def test_pivots_give_the_exact_neighbours_of_fewer_distances(spark, held):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 20, (12, 5))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 1, 5)]) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(50)] + [(900, None)]  # copies tie, a row without a vector is no neighbour
    df = spark.createDataFrame(rows, "id LONG, vector ARRAY<DOUBLE>")
    asked = df.where("id IN (0, 5, 17, 333)")
    index = search.PivotIndex(df, 24, held)
    got = sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in index.nearest(asked, 4).collect())
    want = sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in search.nearest_vectors(df.where("vector IS NOT NULL"), asked, 4).collect())
    assert got == want
    assert index.candidates(asked, 4).count() * 3 < 650 * 4
    few = search.PivotIndex(df.where("id < 3"), 24).nearest(asked.where("id = 0"), 10).collect()
    assert sorted(r.id for r in few) == [0, 1, 2]


def test_class_pairs_are_compared_in_blocks(spark):
    """No candidate pair is shuffled or joined, and the pairs are those of brute force."""
    rng = np.random.default_rng(3)
    profiles = rng.integers(0, 3, (40, 10))
    profiles[7] = profiles[3]
    rows = [(i, t, float(profiles[i, t])) for i in range(40) for t in range(10)]
    leaves = spark.createDataFrame(rows, "id LONG, tree INT, leaf DOUBLE")
    pairs, members = models.rf_proximity_list(leaves, 10, 0.5, held=9)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    kept = [i for i in range(40) if i != 7]
    want = {(i, j): (profiles[i] == profiles[j]).sum() / 10 for i in kept for j in kept if i < j and (profiles[i] == profiles[j]).sum() >= 5}
    assert {(r.id_a, r.id_b): r.proximity for r in pairs.collect()} == want and want
    assert dict(members.collect())[7] == 3


def test_class_pairs_of_repeated_keys(spark):
    """Keys that repeat have more leaves than there are trees; their pairs also share one of the rarest leaves."""
    rng = np.random.default_rng(6)
    profiles = [sorted((t, float(x)) for _ in range(2 if i % 3 == 0 else 1) for t, x in enumerate(rng.integers(0, 3, 6))) for i in range(30)]
    rows = [(i, t, x) for i, profile in enumerate(profiles) for t, x in profile]
    found = models.rf_proximity_list(spark.createDataFrame(rows, "id LONG, tree INT, leaf DOUBLE"), 6, 0.5, held=8)[0].collect()
    lists = [[x for _, x in profile] for profile in profiles]
    classes = [i for i in range(30) if lists.index(lists[i]) == i]
    sizes = {(t, x): sum(lists[i][t : t + 1] == [x] for i in classes) for t in range(12) for x in range(3)}
    rare = {i: set(sorted((sizes[t, x], t, x) for t, x in enumerate(lists[i]))[: 6 - 3 + 1]) for i in classes}
    same = lambda i, j: sum(x == y for x, y in zip(lists[i], lists[j]))
    want = {(i, j): same(i, j) / 6 for i in classes for j in classes if i < j and same(i, j) >= 3 and rare[i] & rare[j]}
    assert {(r.id_a, r.id_b): r.proximity for r in found} == want and want


def test_every_pair_of_rows_that_is_near_is_listed(spark):
    """Rows of one class pair with one another and with all that their class is near to; keys that repeat lose no pair."""
    rng = np.random.default_rng(6)
    profiles = [[float(x) for x in rng.integers(0, 3, 12 if i % 4 == 0 else 6)] for i in range(30)]
    for i, j in ((9, 3), (17, 3), (22, 4), (5, 7)):
        profiles[i] = profiles[j]
    rows = [(i, t % 6, x) for i, profile in enumerate(profiles) for t, x in enumerate(profile)]
    found = models.rf_proximity_list(spark.createDataFrame(rows, "id LONG, tree INT, leaf DOUBLE"), 6, 0.5, held=8, every_row=True)[0].collect()
    lists = [[x for _, x in sorted((t % 6, x) for t, x in enumerate(profile))] for profile in profiles]
    same = lambda i, j: sum(x == y for x, y in zip(lists[i], lists[j]))
    want = {(i, j): same(i, j) / 6 for i in range(30) for j in range(i + 1, 30) if same(i, j) >= 3}
    assert {(r.id_a, r.id_b): r.proximity for r in found} == want and len(found) == len(want)
    assert want[3, 9] == want[3, 17] == want[9, 17] == want[5, 7] == 1


def test_word_vector_partitions_do_not_grow_with_the_tokens(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "Word2Vec", lambda **k: asked.append(k["numPartitions"]) or Word2Vec(**k))
    docs = spark.createDataFrame([(["one", "two", "three"] * 10,)] * 4, "tokens ARRAY<STRING>")
    assert models.train_word_vectors(docs, size=4, partition_tokens=2).count() == 3
    assert models.train_word_vectors(docs, size=4, partition_tokens=40).count() == 3
    assert asked == [12, 3]


def test_lsa_rounds_shuffle_no_documents(spark, matrix):
    """The documents are read where they lie; only sums per block of terms are shuffled."""
    numbered = models.numbered_terms(matrix[1].select("term").distinct())
    rows = lowrank.document_rows(matrix[1], numbered)
    table = stage(lowrank.random_table(spark, 8, 3, 1))
    y = lowrank.meet(rows, table, 3, None, back=False)
    assert "Exchange" not in y._jdf.queryExecution().executedPlan().toString()
    omega = np.random.default_rng([1, 0]).standard_normal((8, 3))
    got = {r.doc_id: r.vector for r in y.collect()}
    assert len(got) == len(model_rows(matrix[0])) and all(np.allclose(got[d], matrix[0][d] @ omega) for d in got)
    z = lowrank.meet(rows, table, 3, None, back=True).collect()
    assert np.allclose(lowrank.matrix(z[0]["data"], 3), matrix[0].T @ matrix[0] @ omega)


def test_rows_of_documents_go_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(lowrank, "HELD", 4)
    lengths = [2, 2, 1, 9, 1]
    lists = pa.array([list(range(n)) for n in lengths])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), lists, lists.cast(pa.list_(pa.float64()))], names=["doc_id", "index", "w"])
    assert [p.column(0).to_pylist() for p in lowrank.held_rows(batch)] == [[0, 1], [2], [3], [4]]
