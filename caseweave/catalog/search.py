"""Queries of search, similarity, clusters and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.adapters import posts, vectors
from caseweave.catalog.registry import query
from caseweave.catalog.text import BOUND_SQL, STOP, STOP_SQL, TOKENS_SQL, ids_are_single, n_docs, sent, staged_tf, tf_of, tokens_of, vocabulary_of
from caseweave.functions import text as tx
from caseweave.functions import vectors as vec
from caseweave.operators import clusters, postings, relational, search, terms
from caseweave.session import fresh_path, release, stage

QUERY_SQL = r""",
qtf AS (SELECT item_id AS query_id, term, count(*) AS tf, any_value(len) AS doc_len FROM (
  SELECT item_id, len(t) AS len, unnest(t) AS term FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM benchmark)) GROUP BY 1, 2)"""

QUNIT_SQL = QUERY_SQL + """,
q0 AS (SELECT query_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM qtf JOIN vocab USING (term)),
q AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM q0)"""

BM25_SQL = TOKENS_SQL + QUERY_SQL + """,
len AS (SELECT doc_id, any_value(doc_len) AS doc_len FROM tf GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS nd, avg(doc_len)::DOUBLE AS al FROM len),
bm AS (SELECT query_id, doc_id, sum(q.tf * ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
         * (d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.doc_len / al)))) AS score
       FROM qtf q JOIN tf d USING (term) JOIN df USING (term), st GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
hits AS (SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM top WHERE rank <= 100)"""

EMB_SQL = """,
words AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS vec_id FROM df),
lookup AS (SELECT term, embedding::DOUBLE[] AS v FROM words JOIN embeddings USING (vec_id)),
known AS (SELECT term, v FROM lookup UNION ALL
  SELECT d.term, v FROM df d JOIN lookup l ON regexp_replace(d.term, '[0-9]', '#', 'g') = l.term
  WHERE d.term NOT IN (SELECT term FROM lookup)),
cells AS (SELECT doc_id, i, sum(tf * v[i]) / any_value(doc_len) AS x
  FROM (SELECT doc_id, tf, doc_len, v, unnest(range(1, 65)) AS i FROM tf JOIN known USING (term)) GROUP BY 1, 2),
dv AS (SELECT doc_id, list(x ORDER BY i) AS v FROM cells GROUP BY 1)"""


def query_tf(t):
    queries = t.benchmark.select(F.col("item_id").alias("doc_id"), tx.tokenize(F.col("text")).alias("tokens"))
    return terms.term_freq(queries).withColumnRenamed("doc_id", "query_id")


def unit_table(t, max_features=None):
    """(term, idf) and staged unit weights of the documents; where ids are single the term table is made twice and not kept."""
    single = ids_are_single(t.documents)
    tf = tf_of(t) if single else staged_tf(t)
    vocabulary = stage(terms.idf(vocabulary_of(t, tf, max_features), n_docs(t), "smooth"))
    weights = stage(terms.tfidf(tf, n_docs(t), "smooth", by_length=False, l2=True, vocabulary=vocabulary, together=single))
    release(*[] if single else [tf])
    return vocabulary, weights


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "similar_docs",
    f"""WITH {BOUND_SQL}{QUNIT_SQL}, s AS (
      SELECT query_id, doc_id, sum(q.w * u.w) AS score FROM q JOIN unit u USING (term) GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
    WHERE rank BETWEEN 2 AND 10""",
)
def _(t):
    vocabulary, weights = unit_table(t)
    return rounded(search.similar_docs(query_tf(t), vocabulary, weights), "score")


GRAM_SQL = r"""
q0 AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: NOT list_contains(""" + STOP_SQL + r""", x)) AS k FROM benchmark),
d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: NOT list_contains(""" + STOP_SQL + r""", x)) AS k FROM documents),
t0 AS (SELECT true AS doc, doc_id AS id, k FROM d0 UNION ALL SELECT false, item_id, k FROM q0),
g AS (SELECT doc, id, unnest(list_concat(k, list_concat(
  list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]),
  list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])))) AS term FROM t0),
f AS (SELECT doc, id, term, count(*) AS tf FROM g GROUP BY 1, 2, 3),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
vocab AS (SELECT term, count(*) AS df FROM f WHERE doc GROUP BY 1 HAVING count(*) BETWEEN 2 AND 300),
w0 AS (SELECT doc, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN vocab USING (term), n),
w AS (SELECT doc, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc, id)) AS w FROM w0),
s AS (SELECT a.id AS query_id, b.id AS doc_id, sum(a.w * b.w) AS score FROM w a JOIN w b USING (term) WHERE NOT a.doc AND b.doc GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s)"""


@query(
    "similar_docs_ngrams",
    f"WITH {GRAM_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top WHERE rank BETWEEN 2 AND 10",
)
def _(t):
    """Search over one to three words without stop words, terms in 2 to 300 documents."""

    def grams(df, tokens):
        kept = df.select("doc_id", tx.remove_words(tokens, STOP).alias("kept"))  # a column of its own, or each n-gram makes it again
        return kept.select("doc_id", tx.ngrams(F.col("kept"), 1, 3).alias("tokens"))

    tf = stage(terms.term_freq(grams(tokens_of(t), F.col("tokens"))))
    asked = grams(t.benchmark.withColumnRenamed("item_id", "doc_id"), tx.tokenize(F.col("text")))
    vocabulary = stage(terms.idf(terms.bound_vocabulary(tf, n_docs(t), 2, 300), n_docs(t), "smooth"))
    weights = terms.tfidf(tf, n_docs(t), "smooth", by_length=False, l2=True, vocabulary=vocabulary)
    return rounded(search.similar_docs(terms.term_freq(asked).withColumnRenamed("doc_id", "query_id"), vocabulary, weights), "score")


@query(
    "identical_docs",
    f"""WITH {TOKENS_SQL}, sig AS (SELECT doc_id, list(term || ':' || tf ORDER BY term) AS s FROM tf GROUP BY 1)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS first_id FROM sig""",
)
def _(t):
    """The copy map that goes with the pairs of different documents."""
    return search.identical_rows(tf_of(t).select("doc_id", "term", F.col("tf").cast("double").alias("w")))


@query(
    "similar_to_doc",
    f"""WITH {BOUND_SQL} SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.w * b.w), 6) AS score
    FROM unit a JOIN unit b USING (term) WHERE a.doc_id = 1 GROUP BY 1, 2""",
)
def _(t):
    return rounded(search.similar_to_doc(unit_table(t)[1], 1), "score")


@query(
    "similarity_histogram",
    f"""WITH {BOUND_SQL}, s AS (SELECT sum(a.w * b.w) AS score FROM unit a JOIN unit b USING (term)
      WHERE a.doc_id = 1 AND b.doc_id <> 1 GROUP BY b.doc_id),
    e AS (SELECT min(score) AS lo, (max(score) - min(score)) / 10 AS w FROM s),
    c AS (SELECT least(floor((score - lo) / w), 9)::BIGINT AS bin, count(*) AS n FROM s, e GROUP BY 1)
    SELECT b.bin, round(lo + b.bin * w, 6) AS lower, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN c USING (bin) CROSS JOIN e""",
)
def _(t):
    scores = search.similar_to_doc(unit_table(t)[1], 1).where("doc_id <> query_id")
    return rounded(relational.histogram(stage(scores), "score", 10), "lower")


@query(
    "pairwise_doc_similarity",
    f"""WITH {TOKENS_SQL},
    raw AS (SELECT doc_id, term, tf * log2(n / df) AS w0 FROM tf JOIN df USING (term), n WHERE df < n),
    unit AS (SELECT doc_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM raw)
    SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum(a.w * b.w), 6) AS similarity
    FROM unit a JOIN unit b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.7""",
)
def _(t):
    tf = staged_tf(t)
    vocabulary = sent(stage(terms.doc_freq(tf)))
    weights = terms.tfidf(tf, n_docs(t), "log2", by_length=False, l2=True, vocabulary=vocabulary).where("w > 0")
    return rounded(search.pairwise_doc_similarity(weights, 0.7, every_pair=True), "similarity")


@query("search_posts", f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM hits")
def _(t):
    return rounded(search.search_posts(query_tf(t), staged_tf(t)), "score", digits=5)


def store_of(t):
    """An index of the documents, added in two batches."""
    tf, store = staged_tf(t), postings.PostingStore(t.spark, fresh_path(t.spark, "postings"), buckets=16)
    store.add(tf.where("doc_id % 2 = 0"), "even")
    store.add(tf.where("doc_id % 2 <> 0"), "odd")
    return store


@query("search_store", f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM hits")
def _(t):
    """The same search from a stored index."""
    return rounded(store_of(t).search(query_tf(t), 100), "score", digits=5)


SHORT_SQL = BM25_SQL.replace(
    "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM benchmark",
    "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')[1:3] AS t FROM benchmark",
).replace("rank <= 100", "rank <= 10")


@query("search_store_short", f"WITH {SHORT_SQL} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM hits")
def _(t):
    """The ten best documents for three words of each text, where most blocks needn't be read."""
    first = t.benchmark.select(F.col("item_id").alias("doc_id"), F.slice(tx.tokenize(F.col("text")), 1, 3).alias("tokens"))
    return rounded(store_of(t).search(terms.term_freq(first).withColumnRenamed("doc_id", "query_id"), 10), "score", digits=5)


def word_embedding(t, tf):
    """A word table from the embedding rows: the most frequent terms take them in order."""
    from caseweave.operators.ordering import positions

    size = t.embeddings.count()
    top = terms.top_terms_by_df(tf, size)
    ranked = positions(top.select("term", "df"), [], [F.desc("df"), F.col("term")], "rank")
    return stage(
        ranked.join(vectors(t.embeddings), F.col("id") == F.col("rank") - 1).select(F.col("term").alias("word"), "vector")
    )


@query(
    "embed_by_word_mean",
    f"WITH {TOKENS_SQL}{EMB_SQL} SELECT doc_id, i::INTEGER - 1 AS i, round(x, 6) + 0.0::DOUBLE AS x FROM cells",
)
def _(t):
    tf = staged_tf(t)
    means = search.embed_by_word_mean(tf, word_embedding(t, tf))
    return means.select("doc_id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(
    "embed_concat",
    f"""WITH {TOKENS_SQL}{EMB_SQL} SELECT doc_id, 128 AS n, round(list_sum(v) * 3, 5) + 0.0::DOUBLE AS total FROM dv""",
)
def _(t):
    tf = staged_tf(t)
    embedding = word_embedding(t, tf)
    twice = embedding.select("word", F.transform("vector", lambda x: x * 2).alias("vector"))
    both = search.embed_concat([search.embed_by_word_mean(tf, embedding), search.embed_by_word_mean(tf, twice)])
    return both.select("doc_id", F.size("vector").alias("n"), (F.round(vec.total(F.col("vector")), 5) + F.lit(0.0)).alias("total"))


@query(
    "semantic_rerank",
    f"""WITH {BM25_SQL}{EMB_SQL},
    qc AS (SELECT query_id, i, sum(tf * v[i]) / any_value(doc_len) AS x
      FROM (SELECT query_id, tf, doc_len, v, unnest(range(1, 65)) AS i FROM qtf JOIN (
        SELECT term, v FROM lookup UNION ALL
        SELECT d.term, v FROM (SELECT DISTINCT term FROM qtf) d JOIN lookup l ON regexp_replace(d.term, '[0-9]', '#', 'g') = l.term
        WHERE d.term NOT IN (SELECT term FROM lookup)) USING (term)) GROUP BY 1, 2),
    qv AS (SELECT query_id, list(x ORDER BY i) AS v FROM qc GROUP BY 1),
    s AS (SELECT query_id, doc_id, list_cosine_similarity(qv.v, dv.v) AS score FROM hits JOIN dv USING (doc_id) JOIN qv USING (query_id))
    SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3""",
)
def _(t):
    tf, qtf = staged_tf(t), query_tf(t)
    embedding = word_embedding(t, tf)
    query_vectors = search.embed_by_word_mean(qtf.withColumnRenamed("query_id", "doc_id"), embedding)
    reranked = search.semantic_rerank(
        search.search_posts(qtf, tf), query_vectors.withColumnRenamed("doc_id", "query_id"), search.embed_by_word_mean(tf, embedding)
    )
    return rounded(reranked, "score")


NEXT_SQL = """FROM (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS b FROM embeddings)
WHERE b IS NOT NULL"""


def neighbours(t):
    v = vectors(t.embeddings)
    following = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b"))
    return v.select("id", F.col("vector").alias("a")).join(following, "id")


@query("cosine_similarity", f"SELECT vec_id AS id, round(list_cosine_similarity(a, b), 9) AS score {NEXT_SQL}")
def _(t):
    return neighbours(t).select("id", F.round(vec.cosine_similarity(F.col("a"), F.col("b")), 9).alias("score"))


@query("euclidean_similarity", f"SELECT vec_id AS id, round(-list_distance(a, b), 9) AS score {NEXT_SQL}")
def _(t):
    return neighbours(t).select("id", F.round(vec.euclidean_similarity(F.col("a"), F.col("b")), 9).alias("score"))


@query(
    "weighted_cosine_similarity",
    f"""SELECT vec_id AS id, round(list_cosine_similarity(list_transform(a, lambda x, i: x * i), list_transform(b, lambda x, i: x * i)), 9)
    AS score {NEXT_SQL}""",
)
def _(t):
    w = F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: i.cast("double"))
    return neighbours(t).select("id", F.round(vec.weighted_cosine_similarity(F.col("a"), F.col("b"), w), 9).alias("score"))


CENTRE_SQL = """c AS (SELECT label AS id, list(x ORDER BY i) AS v FROM (
  SELECT label, i, avg(e[i]) AS x FROM (SELECT label, embedding::DOUBLE[] AS e, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2)
  GROUP BY 1)"""


def centres(t):
    return stage(clusters.centroids(vectors(t.embeddings), "label"))


@query(
    "cross_distances",
    f"""WITH {CENTRE_SQL} SELECT vec_id AS id, c.id AS target, round(list_distance(embedding::DOUBLE[], v), 6) AS distance
    FROM embeddings, c""",
)
def _(t):
    return rounded(search.cross_distances(vectors(t.embeddings), centres(t)), "distance")


@query(
    "cross_similarities",
    f"""WITH {CENTRE_SQL} SELECT vec_id AS id, c.id AS target, round(1 - list_distance(embedding::DOUBLE[], v), 6) AS similarity
    FROM embeddings, c""",
)
def _(t):
    return rounded(search.cross_similarities(vectors(t.embeddings), centres(t)), "similarity")


@query(
    "cross_pairs",
    f"""WITH {CENTRE_SQL} SELECT a.id AS id, b.id AS target, round(list_cosine_similarity(a.v, b.v), 6) AS score
    FROM c a JOIN c b ON a.id < b.id""",
)
def _(t):
    groups = centres(t)
    return rounded(search.cross_scores(groups, groups, vec.cosine_similarity).where("id < target"), "score")


NEAREST_SQL = """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
    d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(v, embedding::DOUBLE[]) AS distance FROM q, embeddings e)
    SELECT query_id, id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d) WHERE rank <= 3"""


def first_of_labels(v):
    return v.join(v.groupBy("label").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")


@query("nearest_vectors", NEAREST_SQL)
def _(t):
    v = vectors(t.embeddings)
    return rounded(search.nearest_vectors(v, first_of_labels(v), 3), "distance")


@query("nearest_vectors_pivots", NEAREST_SQL)
def _(t):
    """The same neighbours from cells around pivots, where what is too far by the triangle inequality isn't measured."""
    v = vectors(t.embeddings)
    return rounded(search.PivotIndex(v).nearest(first_of_labels(v), 3), "distance")


@query(
    "nearest_words",
    f"""WITH {TOKENS_SQL}{EMB_SQL} SELECT term AS word, round(-list_distance(v, (SELECT v FROM lookup WHERE term = 'the')), 6) AS score
    FROM lookup ORDER BY round(-list_distance(v, (SELECT v FROM lookup WHERE term = 'the')), 9) DESC, term LIMIT 10""",
)
def _(t):
    return rounded(search.nearest_to(word_embedding(t, tf_of(t)), "word", "the", 10), "score")


@query(
    "nearest_vectors_own_score",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
    s AS (SELECT vec_id AS id, -list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - v[i]))) AS score FROM embeddings, q)
    SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, id LIMIT 20""",
)
def _(t):
    """The rows nearest to the first one by a similarity of the caller's own: the negative sum of differences."""
    v = vectors(t.embeddings)
    city_blocks = lambda a, b: -vec.total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return rounded(search.nearest_to(v, "id", v.agg(F.min("id")).scalar(), 20, city_blocks), "score")


@query(
    "cluster_terms",
    f"""WITH {BOUND_SQL}, m AS (SELECT source AS cluster, term, sum(w) AS total FROM unit JOIN documents USING (doc_id) GROUP BY 1, 2),
    z AS (SELECT source AS cluster, count(*) AS size FROM documents GROUP BY 1)
    SELECT cluster, term, round(weight, 6) AS weight, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, term) AS rank
      FROM (SELECT cluster, term, total / size AS weight FROM m JOIN z USING (cluster))) WHERE rank <= 10""",
)
def _(t):
    assignment = t.documents.select("doc_id", F.col("source").alias("cluster"))
    return rounded(clusters.cluster_terms(unit_table(t)[1], assignment), "weight")


@query(
    "inter_group_score",
    """SELECT round(sum(CASE WHEN a.label = b.label THEN s ELSE -s END) / count(*), 6) AS score FROM (
      SELECT a.label, b.label AS label_1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) x, LATERAL (SELECT x.label) a(label), LATERAL (SELECT x.label_1) b(label)""",
)
def _(t):
    return rounded(clusters.inter_group_score(vectors(t.embeddings), "label"), "score")


def tagged_vectors(t):
    tags = posts(t.documents, t.labels).where(F.size("tags") > 0).select(F.col("doc_id").alias("id"), "tags")
    return vectors(t.embeddings).join(tags, "id")


TAGGED_SQL = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e,
  list_distinct(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, lang], lambda x: x IS NOT NULL)) AS tags
  FROM embeddings JOIN documents ON doc_id = vec_id JOIN labels USING (doc_id))"""


@query(
    "inter_tag_score",
    f"""WITH {TAGGED_SQL} SELECT round(sum(CASE WHEN list_has_any(a.tags, b.tags) THEN 1 ELSE -1 END
      * list_cosine_similarity(a.e, b.e)) / count(*), 6) AS score FROM v a JOIN v b ON a.id < b.id""",
)
def _(t):
    return rounded(clusters.inter_tag_score(tagged_vectors(t)), "score")


def draws_sql(dims: int, iters: int = 100) -> str:
    rows = clusters.weight_draws(dims, iters)
    return ", ".join(f"({i}, [{', '.join(repr(x) for x in w)}]::DOUBLE[])" for i, w in enumerate(rows))


@query(
    "tune_similarity_weights",
    f"""WITH {TAGGED_SQL}, d(iter, w) AS (VALUES {draws_sql(64)}),
    u0 AS (SELECT iter, id, tags, list_transform(e, lambda x, i: x * w[i]) AS e FROM v, d),
    u AS (SELECT iter, id, tags, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u0),
    s AS (SELECT a.iter AS iter, sum(CASE WHEN list_has_any(a.tags, b.tags) THEN 1 ELSE -1 END * list_dot_product(a.e, b.e)) / count(*) AS score
      FROM u a JOIN u b ON a.iter = b.iter AND a.id < b.id GROUP BY 1)
    SELECT iter, round(score, 6) AS score FROM s ORDER BY s.score DESC, iter LIMIT 1""",
)
def _(t):
    best = clusters.tune_similarity_weights(tagged_vectors(t), 64)
    return rounded(best.select("iter", "score"), "score")
