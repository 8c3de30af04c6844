"""Queries of models. Their rows have no SQL form; the tests check their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.adapters import vectors
from caseweave.catalog.registry import query
from caseweave.catalog.search import unit_table
from caseweave.catalog.text import TOKENS_SQL, n_docs, sent, sentiment_of, tokens_of
from caseweave.functions import text as tx
from caseweave.operators import kernels, models, ordering, terms, ward
from caseweave.session import release, spread, stage


_stored: dict = {}


def lsa_of(t, k=100):
    """(model, vocabulary, weights) of the 50,000 most frequent terms; a session stores one model per folder and reads it from then on."""
    key = (t.spark.sparkContext.applicationId, t.folder, k)
    if key not in _stored:
        vocabulary, weights = unit_table(t, 50_000)
        _stored[key] = models.Lsa(weights, k).path, vocabulary, weights
    path, vocabulary, weights = _stored[key]
    return models.Lsa.load(t.spark, path), vocabulary, weights


def doc_vectors(t):
    weights = unit_table(t)[1]
    numbered = models.numbered_terms(weights.select("term").distinct())
    rows = models.sparse_vectors(weights, numbered, docs=t.documents)
    release(weights, numbered)  # the vectors are stored
    return rows


def frequent(vocabulary, k):
    return [r["term"] for r in vocabulary.orderBy(F.desc("total"), "term").limit(k).collect()]


@query("lsa")
def _(t):
    model, _, _ = lsa_of(t)
    return model.us.select("doc_id", F.posexplode("vector").alias("concept", "x"))


@query("explained_variance_sweep")
def _(t):
    model, _, weights = lsa_of(t, 200)
    return models.explained_variance_sweep(model, weights, n_docs(t))


@query("concept_terms")
def _(t):
    return models.concept_terms(lsa_of(t)[0])


@query("concept_docs")
def _(t):
    return models.concept_docs(lsa_of(t)[0])


@query("related_terms")
def _(t):
    model, vocabulary, _ = lsa_of(t)
    return models.related_terms(model, frequent(vocabulary, 1)[0])


@query("related_docs")
def _(t):
    return models.related_docs(lsa_of(t)[0], 1)


@query("docs_for_term")
def _(t):
    model, vocabulary, _ = lsa_of(t)
    return models.docs_for_term(model, frequent(vocabulary, 1)[0])


@query("docs_for_query")
def _(t):
    model, vocabulary, _ = lsa_of(t)
    return models.docs_for_query(model, vocabulary, frequent(vocabulary, 3))


def power_sql(matrix: str, name: str, rounds: int = 1500) -> str:
    """CTE with the first eigenvector ``v`` of the matrix in CTE ``matrix`` (rows), by power iteration."""
    return f"""
{name}i AS (SELECT 0 AS k, list_transform(range(64), lambda i: 1.0::DOUBLE / (1 + i)) AS v
  UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT k, list_transform(rows, lambda r: list_dot_product(r, v)) AS w FROM {name}i, {matrix} WHERE k < {rounds})),
{name} AS (SELECT v FROM {name}i WHERE k = {rounds})"""


PCA_SQL = f"""
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
mean AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS x FROM e, range(1, 65) t(i) GROUP BY i)),
c AS (SELECT list_transform(v, lambda x, i: x - m[i]) AS v FROM e, mean),
cov AS (SELECT list(r ORDER BY i) AS rows FROM (SELECT i, list(s ORDER BY j) AS r FROM (
  SELECT i, j, sum(v[i] * v[j]) / (count(*) - 1) AS s FROM c, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j) GROUP BY i)),
{power_sql("cov", "p1")},
l1 AS (SELECT v, list_dot_product(v, list_transform(rows, lambda r: list_dot_product(r, v))) AS lambda1 FROM p1, cov),
rest AS (SELECT list_transform(rows, lambda r, i: list_transform(r, lambda x, j: x - lambda1 * v[i] * v[j])) AS rows FROM cov, l1),
{power_sql("rest", "p2")}"""


@query(
    "pca_project",
    f"""WITH RECURSIVE {PCA_SQL} SELECT id, round(abs(list_dot_product(e.v, p1.v)), 3) AS x, round(abs(list_dot_product(e.v, p2.v)), 3) AS y
    FROM e, p1, p2""",
)
def _(t):
    """Coordinates without their sign, which is free."""
    coordinates = models.pca_project(models.dense_vectors(vectors(t.embeddings)), 2)
    at = lambda k: F.round(F.abs(F.col("vector")[k]), 3)
    return coordinates.select("id", at(0).alias("x"), at(1).alias("y"))


@query("kmeans_nearest_centre", "SELECT doc_id, true AS nearest FROM documents")
def _(t):
    """Whether each document is nearest to the mean of its own cluster, as it must be when k-means has settled."""
    weights = unit_table(t)[1]
    numbered = models.numbered_terms(weights.select("term").distinct())
    rows = models.sparse_vectors(weights, numbered, docs=t.documents)
    release(numbered)
    assignment = stage(models.kmeans_docs(rows, 5, n_init=3))
    sizes = assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = weights.join(assignment, "doc_id").groupBy("cluster", "term").agg(F.sum("w").alias("s"))
    centres = stage(sums.join(sizes, "cluster").select("cluster", "term", (F.col("s") / F.col("size")).alias("c")))
    norms = sizes.join(centres.groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("norm")), "cluster", "left").fillna(0.0, ["norm"])
    wide = sent(stage(centres.groupBy("term").agg(*[F.max(F.when(F.col("cluster") == k, F.col("c"))).alias(f"c{k}") for k in range(5)])))
    sums = weights.join(wide, "term").groupBy("doc_id").agg(*[F.sum(F.col("w") * F.col(f"c{k}")).alias(f"d{k}") for k in range(5)])
    dots = sums.select("doc_id", F.posexplode(F.array(*[f"d{k}" for k in range(5)])).alias("cluster", "dot"))
    each = assignment.select("doc_id", F.col("cluster").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("cluster"))
    far = each.join(norms, "cluster").join(dots, ["doc_id", "cluster"], "left").select(
        "doc_id", "own", "cluster", (F.col("norm") - 2 * F.coalesce("dot", F.lit(0.0))).alias("d")
    )
    own, least = F.min(F.when(F.col("own") == F.col("cluster"), F.col("d"))), F.min("d")
    return far.groupBy("doc_id").agg((own <= least + 0.001).alias("nearest"))


@query("word_vector_cover", f"WITH {TOKENS_SQL} SELECT term AS word, 100 AS n FROM df WHERE total >= 5")
def _(t):
    """Every term of five or more occurrences has one vector of 100 numbers."""
    return models.train_word_vectors(tokens_of(t)).select("word", F.size("vector").alias("n"))


@query("rf_proximity_range", "SELECT label AS \"group\", count(*) AS n, true AS inside FROM embeddings GROUP BY 1 HAVING count(*) > 1")
def _(t):
    """Rows per group and whether every mean proximity lies between 0 and 1."""
    v = vectors(t.embeddings)
    rows = models.rf_group_proximity(stage(models.rf_leaves(v)), v.select("id", F.col("label").alias("group")), 50)
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("proximity").between(0, 1)).alias("inside"))


@query("lsa_orthogonality", "SELECT a.i AS a, b.i AS b, 0.0::DOUBLE AS dot FROM range(10) a(i) JOIN range(10) b(i) ON a.i < b.i")
def _(t):
    """Dot products between the first ten columns of U·S over all documents."""
    us = lsa_of(t)[0].us
    sums = us.agg(*[F.sum(F.col("vector")[i] * F.col("vector")[j]).alias(f"d{i}_{j}") for i in range(10) for j in range(i + 1, 10)])
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("a"), F.lit(j).cast("long").alias("b"), F.col(f"d{i}_{j}").alias("dot")) for i in range(10) for j in range(i + 1, 10)])
    return sums.select(F.explode(cells).alias("c")).select("c.a", "c.b", (F.round("c.dot", 5) + F.lit(0.0)).alias("dot"))


@query("kmeans_docs")
def _(t):
    return models.kmeans_docs(doc_vectors(t), 5, n_init=3)


@query("two_level_clusters")
def _(t):
    weights = unit_table(t)[1]
    first = tx.split_sentences(F.col("text"))[0]
    heads = t.documents.select("doc_id", tx.tokenize(first).alias("tokens"))
    head_weights = weights.join(terms.term_freq(heads).select("doc_id", "term"), ["doc_id", "term"], "left_semi")
    numbered = models.numbered_terms(weights.select("term").distinct())
    by_head, by_text = models.sparse_vectors(head_weights, numbered, docs=t.documents), models.sparse_vectors(weights, numbered, docs=t.documents)
    release(weights, numbered)  # the vectors are stored
    found = models.two_level_clusters(by_head, by_text)
    return found.join(sentiment_of(t).withColumnRenamed("score", "sentiment"), "doc_id")


@query("term_clusters")
def _(t):
    tf = terms.prune_sparse_terms(stage(terms.term_freq(tokens_of(t))), t.documents.agg(F.count(F.lit(1))).scalar(), 0.8)
    weights = terms.l2_normalize(tf.select("doc_id", "term", F.col("tf").cast("double").alias("w")))
    return models.term_clusters(stage(weights), 4)


@query("hierarchical_clusters")
def _(t):
    return models.hierarchical_clusters(models.dense_vectors(vectors(t.embeddings)), 4)


@query("ward_merges")
def _(t):
    return ward.merge_tree(ward.leaves(vectors(t.embeddings)))


@query("ward_clusters")
def _(t):
    return ward.ward_clusters(vectors(t.embeddings), 4)


@query(
    "ward_inertia",
    """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT i, e.v[i] AS x FROM e, range(1, 65) r(i))
SELECT (SELECT count(*) FROM e) AS n, round(sum(ss), 3) AS inertia FROM (SELECT i, var_pop(x) * count(*) AS ss FROM x GROUP BY i)""",
)
def _(t):
    found = ward.leaves(vectors(t.embeddings))
    own = found.agg(F.sum("n").alias("n"), F.sum("sse").alias("own"))
    return own.join(ward.merge_tree(found).agg(F.sum(F.col("height") ** 2 / 2).alias("merged"))).select(
        "n", F.round(F.coalesce("own", F.lit(0.0)) + F.coalesce("merged", F.lit(0.0)), 3).alias("inertia")
    )


@query("rf_group_proximity")
def _(t):
    leaves = stage(models.rf_leaves(vectors(t.embeddings)))
    return models.rf_group_proximity(leaves, vectors(t.embeddings).select("id", F.col("label").alias("group")), 50)


@query("rf_proximity_pairs")
def _(t):
    """All pairs of rows that share at least three in ten of their leaves in the forest."""
    leaves = stage(models.rf_leaves(vectors(t.embeddings)))
    return models.rf_proximity_list(leaves, 50, 0.3, every_row=True)[0]


STUMPS_SQL = """leaf AS (SELECT vec_id AS id, i AS tree, (CASE WHEN e[i + 1] > 0 THEN 4 ELSE 0 END) + (CASE WHEN e[(i + 7) % 64 + 1] > 0 THEN 2 ELSE 0 END)
    + (CASE WHEN e[(i * 5 + 3) % 64 + 1] > 0 THEN 1 ELSE 0 END) AS leaf
  FROM (SELECT vec_id, embedding AS e, unnest(range(40)) AS i FROM embeddings))"""


def stump_leaves(t):
    """Leaves of 40 fixed trees that ask for the sign of three entries each: a leaf table that SQL can make as well."""
    sign = lambda at, value: F.when(F.col("vector")[at] > 0, value).otherwise(0)
    cells = F.array(*[sign(i, 4) + sign((i + 7) % 64, 2) + sign((i * 5 + 3) % 64, 1) for i in range(40)])
    return vectors(t.embeddings).select("id", F.posexplode(cells).alias("tree", "leaf"))


@query(
    "rf_proximity_pairs_fixed_trees",
    f"""WITH {STUMPS_SQL}, profile AS (SELECT id, list(leaf ORDER BY tree) AS l FROM leaf GROUP BY id),
    class AS (SELECT min(id) AS id, l FROM profile GROUP BY l), c AS (SELECT id, unnest(range(40)) AS tree, unnest(l) AS leaf FROM class)
    SELECT a.id AS id_a, b.id AS id_b, round(count(*) / 40, 6) AS proximity FROM c a JOIN c b ON a.tree = b.tree AND a.leaf = b.leaf AND a.id < b.id
    GROUP BY 1, 2 HAVING count(*) >= 16""",
)
def _(t):
    return models.rf_proximity_list(stage(stump_leaves(t)), 40, 0.4)[0].withColumn("proximity", F.round("proximity", 6))


@query(
    "rf_leaf_classes",
    f"""WITH {STUMPS_SQL}, profile AS (SELECT id, list(leaf ORDER BY tree) AS l FROM leaf GROUP BY id)
    SELECT id, min(id) OVER (PARTITION BY l) AS class_id FROM profile""",
)
def _(t):
    """Who shares every leaf: the membership that goes with the pairs of classes."""
    return models.leaf_classes(stage(stump_leaves(t)))[0]


@query("train_word_vectors")
def _(t):
    words = models.train_word_vectors(tokens_of(t))
    return words.select("word", F.posexplode("vector").alias("i", "x"))


@query("string_kernel_pairs")
def _(t):
    """The most similar other sentence of every sentence of the documents that has candidates."""
    sentences = spread(t.documents).select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("i", "text"))
    named = F.concat_ws(":", F.format_string("%010d", "doc_id"), F.format_string("%06d", "i"))
    pairs = kernels.shingle_candidates(sentences.select(named.alias("id"), "text"), size=2, max_distance=0.6, both_ways=False)
    scored = kernels.string_kernel_pairs(pairs, mirrored=True)
    return ordering.top_k_per_group(scored, ["id_a"], [F.round("kernel", 9).desc(), F.col("id_b")], 1)
