"""Factorisation, clustering, embedding and forest models on Spark MLlib."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions import vectors as vec
from caseweave.operators import lowrank
from caseweave.operators.ordering import positions, top_k_per_group
from caseweave.operators.search import vector_sum
from caseweave.operators.terms import squares_about_mean
from caseweave.session import fresh_path, spread, stage

MAX_FEATURES = 65_535

#: Rows of a block that are compared with another block at once.
COMPARED = 256


def numbered_terms(vocabulary: DataFrame) -> DataFrame:
    """(term, index) with indexes from 1 in term order."""
    return stage(positions(vocabulary.select("term"), [], [F.col("term")], "index"))


def sparse_vectors(weights: DataFrame, terms: DataFrame, key: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """Long weights → (key, features) with sparse vectors; with ``docs`` those without terms are zero vectors.

    The rows pass through libsvm lines in the shared folder: Spark writes and reads them without
    Python, and model training can scan them as often as it needs. ``key`` must be an integer.
    """
    n = terms.agg(F.max("index")).first()[0]
    if n is None:
        raise ValueError("no features")
    entries = F.array_sort(F.collect_list(F.struct("index", "w")))
    line = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["index"].cast("string"), e["w"].cast("string"))), " ")
    rows = weights.where("w <> 0").join(terms, "term").groupBy(key).agg(entries.alias("entries"))
    if docs is not None:
        rows = docs.select(key).join(rows, key, "left")
    path = fresh_path(weights.sparkSession, "libsvm")
    rows.select(F.concat_ws(" ", F.col(key).cast("string"), F.coalesce(line, F.lit(""))).alias("value")).write.text(path)
    read = weights.sparkSession.read.format("libsvm").option("numFeatures", str(n)).load(path)
    return spread(read).select(F.col("label").cast("long").alias(key), "features")


def dense_vectors(vectors: DataFrame, key: str = "id") -> DataFrame:
    return vectors.select(key, array_to_vector("vector").alias("features"))


# --- latent semantic analysis -------------------------------------------------------------------


class Lsa:
    """Truncated SVD of term weights as stored tables, written once and read by every query on it.

    ``sigma`` (concept, sigma); ``v`` (term, vector); ``us`` (doc_id, vector) and ``vs`` (term, vector)
    hold rows of U·S and V·S; ``us_unit`` and ``vs_unit`` the same with norm 1, zero rows dropped.
    The tables lie in the folder ``path``; ``Lsa.load`` opens one that was stored before.
    """

    def __init__(self, weights: DataFrame, k: int = 100, path: str | None = None):
        spark = weights.sparkSession
        path = path or fresh_path(spark, "lsa")
        sigma, v, us = lowrank.truncated_svd(weights, numbered_terms(weights.select("term").distinct()), k)
        spark.createDataFrame(list(enumerate(sigma)), "concept INT, sigma DOUBLE").write.parquet(f"{path}/sigma")
        v.write.parquet(f"{path}/v")
        us.write.parquet(f"{path}/us")
        self._open(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lsa:
        model = cls.__new__(cls)
        model._open(spark, path)
        return model

    def _open(self, spark: SparkSession, path: str) -> None:
        self.path = path
        self.sigma, self.v, self.us = (spark.read.parquet(f"{path}/{part}") for part in ("sigma", "v", "us"))
        sigma = [r["sigma"] for r in self.sigma.orderBy("concept").collect()]  # k rows
        self.k = len(sigma)
        scale = F.array(*[F.lit(s) for s in sigma])
        self.vs = self.v.select("term", F.zip_with("vector", scale, lambda x, s: x * s).alias("vector"))
        self.us_unit = self.us.select("doc_id", vec.unit(F.col("vector")).alias("vector")).where("vector IS NOT NULL")
        self.vs_unit = self.vs.select("term", vec.unit(F.col("vector")).alias("vector")).where("vector IS NOT NULL")


def _best(rows: DataFrame, key: str, target, k: int) -> DataFrame:
    scored = rows.withColumn("_target", target).select(key, vec.dot(F.col("vector"), F.col("_target")).alias("score"))
    return scored.where("score IS NOT NULL").orderBy(F.round("score", 9).desc(), key).limit(k)


def related_terms(model: Lsa, term: str, k: int = 10) -> DataFrame:
    """Terms closest to a term in concept space."""
    return _best(model.vs_unit, "term", model.vs_unit.where(F.col("term") == term).select("vector").scalar(), k)


def related_docs(model: Lsa, doc_id: int, k: int = 10) -> DataFrame:
    return _best(model.us_unit, "doc_id", model.us_unit.where(F.col("doc_id") == doc_id).select("vector").scalar(), k)


def docs_for_term(model: Lsa, term: str, k: int = 10) -> DataFrame:
    return _best(model.us, "doc_id", model.v.where(F.col("term") == term).select("vector").scalar(), k)


def docs_for_query(model: Lsa, idf: DataFrame, terms: Sequence[str], k: int = 10) -> DataFrame:
    """Documents for several terms: idf-weighted sum of their rows of V, times U·S."""
    query = model.v.where(F.col("term").isin(list(terms))).join(idf.select("term", "idf"), "term")
    return _best(model.us, "doc_id", query.agg(vector_sum("vector", F.col("idf")).alias("q")).scalar(), k)


def _concepts(rows: DataFrame, key: str, k: int) -> DataFrame:
    entries = rows.select(key, F.posexplode("vector").alias("concept", "weight"))
    return top_k_per_group(entries, ["concept"], [F.round("weight", 9).desc(), F.col(key)], k)


def concept_terms(model: Lsa, k: int = 10) -> DataFrame:
    return _concepts(model.v, "term", k)


def concept_docs(model: Lsa, k: int = 10) -> DataFrame:
    return _concepts(model.us, "doc_id", k)


def explained_variance_sweep(model: Lsa, weights: DataFrame, n_docs: Column | int, ks: Sequence[int] = (10, 20, 50, 100, 200)) -> DataFrame:
    """Per k the variance over all documents that the first k concepts hold, and its share of the variance of the weights.

    Documents without terms are rows of zeros in both.
    """
    n = F.lit(n_docs)
    entries = model.us.select(F.posexplode("vector").alias("concept", "x"))
    per_concept = entries.groupBy("concept").agg((squares_about_mean("x", n) / n).alias("var"))
    whole = weights.groupBy("term").agg((squares_about_mean("w", n) / n).alias("var")).agg(F.sum("var")).scalar()
    wanted = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return (
        per_concept.select("concept", "var", wanted).where("concept < k").groupBy("k")
        .agg(F.sum("var").alias("variance"), (F.sum("var") / whole).alias("explained"))
    )


def pca_project(vectors: DataFrame, k: int = 2, key: str = "id") -> DataFrame:
    """Coordinates on the first k principal components; ``vectors`` has a ``features`` column.

    The solver holds a columns × columns matrix, so bound the vocabulary to a few thousand terms first.
    """
    n = len(vectors.select(vector_to_array("features").alias("v")).first()["v"])
    if n > MAX_FEATURES:
        raise ValueError(f"{n} features; the covariance holds at most {MAX_FEATURES}")
    model = PCA(k=k, inputCol="features", outputCol="projected").fit(vectors)
    return model.transform(vectors).select(key, vector_to_array("projected").alias("vector"))


# --- clustering ---------------------------------------------------------------------------------


def kmeans_docs(vectors: DataFrame, k: int = 5, max_iter: int = 100, seed: int = 11, n_init: int = 1, key: str = "doc_id") -> DataFrame:
    """k-means cluster of each row; the best of ``n_init`` seeds by training cost."""
    vectors.persist()
    models = [KMeans(k=k, maxIter=max_iter, seed=seed + i, initMode="k-means||").fit(vectors) for i in range(n_init)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    vectors.unpersist()
    return best.transform(vectors).select(key, F.col("prediction").alias("cluster"))


def two_level_clusters(level1: DataFrame, level2: DataFrame, k1: int = 10, k2: int = 5, max_iter: int = 10, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """Cluster by one vector (headline), then inside each cluster by another (description).

    There are k1 inner models, each trained on its cluster only; clusters of fewer than k2 different
    rows keep one inner cluster.
    """
    outer = stage(kmeans_docs(level1, k1, max_iter, seed, key=key))
    inner_rows = stage(level2.join(outer, key))
    parts = None
    for c in [r[0] for r in outer.select("cluster").distinct().collect()]:  # at most k1 values
        group = inner_rows.where(F.col("cluster") == c).select(key, "features")
        if group.select("features").distinct().limit(k2).count() < k2:
            part = group.select(key, F.lit(0).alias("cluster"))
        else:
            part = kmeans_docs(group, k2, max_iter, seed, key=key)
        part = stage(part.select(key, F.lit(c).alias("cluster1"), F.col("cluster").alias("cluster2")))  # lets go of the model
        parts = part if parts is None else parts.unionByName(part)
    return parts


def hierarchical_clusters(vectors: DataFrame, k: int = 4, seed: int = 11, key: str = "id") -> DataFrame:
    """k clusters of a top-down tree of bisections."""
    vectors.persist()
    model = BisectingKMeans(k=k, seed=seed).fit(vectors)
    vectors.unpersist()
    return model.transform(vectors).select(key, F.col("prediction").alias("cluster"))


def term_clusters(weights: DataFrame, k: int = 4, seed: int = 11, max_iter: int = 100) -> DataFrame:
    """Cluster terms by their documents' concept space: the transposed table, reduced by the SVD."""
    model = Lsa(weights, min(100, weights.select("term").distinct().count() - 1))
    rows = model.vs.select("term", array_to_vector("vector").alias("features"))
    return kmeans_docs(rows, k, max_iter, seed, key="term")


# --- forest proximity ---------------------------------------------------------------------------


def rf_leaves(vectors: DataFrame, trees: int = 50, seed: int = 11, max_depth: int = 8, key: str = "id") -> DataFrame:
    """(key, tree, leaf): the leaf of each row in every tree of an unsupervised forest.

    The forest tells the rows from made-up ones, in which each column is rotated by an amount of its
    own; that keeps every column's values and breaks their connection.
    """
    rows = stage(positions(vectors.select(key, "vector"), [], [F.col(key)], "row"))
    n = rows.agg(F.max("row")).scalar()
    cells = rows.select("row", F.posexplode("vector").alias("column", "x"))
    moved = cells.withColumn("row", F.pmod(F.col("row") + F.pmod(F.xxhash64(F.lit(seed), "column"), n), n))
    shuffled = moved.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "x"))).alias("cells"))
    fake = shuffled.select(F.transform("cells", lambda c: c["x"]).alias("vector"), F.lit(0.0).alias("label"))
    train = rows.select("vector", F.lit(1.0).alias("label")).unionByName(fake)
    train = train.select("label", array_to_vector("vector").alias("features")).persist()
    path = fresh_path(vectors.sparkSession, "forest")
    RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=seed, leafCol="leaf").fit(train).write().save(path)
    train.unpersist()
    forest = RandomForestClassificationModel.load(path)  # without the training summary, which tasks can't be sent
    placed = forest.transform(rows.select(key, array_to_vector("vector").alias("features")))
    return placed.select(key, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))


def rf_proximity_to(leaves: DataFrame, probe, trees: int, key: str = "id") -> DataFrame:
    """Share of trees in which each row is in the same leaf as one probe row; zeros are left out."""
    own = leaves.where(F.col(key) == probe).select("tree", "leaf")
    return leaves.join(own, ["tree", "leaf"]).groupBy(key).agg((F.count(F.lit(1)) / F.lit(trees)).alias("proximity"))


def rf_group_proximity(leaves: DataFrame, groups: DataFrame, trees: int, key: str = "id") -> DataFrame:
    """Mean proximity of each row to the other rows of its group.

    Counts per (tree, leaf, group) stand for the pairs, so a leaf with very many rows costs one count.
    """
    tagged = leaves.join(groups, key)
    together = tagged.groupBy("tree", "leaf", "group").agg((F.count(F.lit(1)) - 1).alias("others"))
    sizes = groups.groupBy("group").agg((F.count(F.lit(1)) - 1).alias("size"))
    sums = tagged.join(together, ["tree", "leaf", "group"]).groupBy(key, "group").agg(F.sum("others").alias("hits"))
    return sums.join(sizes, "group").where("size > 0").select(key, "group", (F.col("hits") / F.lit(trees) / F.col("size")).alias("proximity"))


def leaf_classes(leaves: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """((key, class_id), (class_id, size, leaves)): rows that share every leaf are one class, named by its smallest key.

    ``leaves`` of the second frame is the array of leaves in the order of the trees.
    """
    profile = F.transform(F.array_sort(F.collect_list(F.struct("tree", "leaf"))), lambda x: x["leaf"].cast("int"))
    rows = stage(leaves.groupBy(key).agg(profile.alias("leaves")))  # one leaf per tree and row
    classes = stage(rows.groupBy("leaves").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("size")))
    members = rows.join(classes.select("leaves", "class_id").hint("merge"), "leaves").select(key, "class_id")
    return members, classes.select("class_id", "size", "leaves")


def rf_proximity_list(
    leaves: DataFrame, trees: int, least: float, key: str = "id", held: int = 1000, every_row: bool = False
) -> tuple[DataFrame, DataFrame]:
    """((id_a, id_b, proximity), (key, class_id)): all pairs of classes with a proximity of at least ``least``, and who is in a class.

    Rows that share every leaf are one class, so a leaf full of equal rows gives no list of pairs. Classes are dealt to blocks of
    about ``held``, and every pair of blocks is compared by itself, tree by tree: work is the square of the classes, but a class
    is shuffled once per block and only the pairs that are near enough leave a task. Of keys that repeat, whose leaves are more than
    the trees, pairs count that also share one of the rarest leaves.

    ``every_row`` leaves out none: the pairs are those of rows, also of two rows of one class, and are asked for nothing but ``least``.
    """
    members, classes = leaf_classes(leaves, key)
    share = max(1, int(np.ceil(least * trees - 1e-9)))
    rows = classes.where("class_id IS NOT NULL").select("class_id", "leaves")
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("leaves"))).first()
    blocks, repeated = max(1, -(-n // held)), (longest or 0) > trees and not every_row
    if repeated:
        rows = rows.join(rarest_trees(rows, trees - share + 1), "class_id", "left")
        rows = rows.withColumn("rare", F.coalesce("rare", F.array().cast("array<int>")))
    kind = rows.schema["class_id"].dataType.simpleString()

    def compare(cell: pa.Table) -> pa.Table:
        own, other, found = cell["block"].to_numpy(), cell["other"].to_numpy(), [np.empty((3, 0), dtype=np.int64)]
        left, right = np.flatnonzero(own <= other), np.flatnonzero(own >= other)  # the same rows where a block meets itself
        a, b = leaf_matrix(cell["leaves"].take(pa.array(left)), -1), leaf_matrix(cell["leaves"].take(pa.array(right)), -2).T.copy()
        if repeated:
            marked = cell["rare"].combine_chunks()
            rare = np.zeros((len(own), max(a.shape[1], len(b))), dtype=bool)
            rare[np.repeat(np.arange(len(own)), marked.value_lengths().to_numpy()), marked.flatten().to_numpy()] = True
        for start in range(0, len(left), COMPARED):
            part = a[start : start + COMPARED]
            same = np.zeros((len(part), len(right)), dtype=np.uint16)
            near = np.zeros(same.shape, dtype=bool) if repeated else None
            for tree in range(min(part.shape[1], len(b))):
                equal = part[:, tree, None] == b[tree]
                same += equal
                if repeated:
                    near |= equal & rare[left[start : start + COMPARED], tree, None] & rare[right, tree]
            i, j = np.nonzero((same >= share) & near if repeated else same >= share)
            pairs = np.stack([left[start + i], right[j], same[i, j]])
            found.append(pairs[:, pairs[0] < pairs[1]] if own[0] == other[0] else pairs)
        i, j, same = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([cell["class_id"].take(pa.array(i)), cell["class_id"].take(pa.array(j)), pa.array(same)], names=["one", "two", "same"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "other", *rows.columns)
    spark = leaves.sparkSession  # few bytes but much work per row: keep adaptive execution from merging the partitions
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.repartition(parts, "low", "high").groupBy("low", "high").applyInArrow(compare, f"one {kind}, two {kind}, same long")
    pairs = met.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b"), (F.col("same") / F.lit(trees)).alias("proximity"))
    return (pairs_of_members(pairs, members, classes, trees, share, key) if every_row else pairs), members


def pairs_of_members(pairs: DataFrame, members: DataFrame, classes: DataFrame, trees: int, share: int, key: str) -> DataFrame:
    """Pairs of classes → pairs of their rows, with those of two rows of one class, which share every leaf that is not null."""
    named = members.where(F.col(key).isNotNull())
    one, two = (named.select(F.col("class_id").alias(f"class_{side}"), F.col(key).alias(side)) for side in ("one", "two"))
    met = pairs.select(F.col("id_a").alias("class_one"), F.col("id_b").alias("class_two"), "proximity").join(one, "class_one").join(two, "class_two")
    met = met.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b"), "proximity")
    same = F.size(F.filter("leaves", lambda x: x.isNotNull()))
    shared = classes.where("size > 1").select(F.col("class_id").alias("class_one"), same.alias("same")).where(F.col("same") >= share)
    inside = shared.join(one, "class_one").join(two, (F.col("class_one") == F.col("class_two")) & (F.col("one") < F.col("two")))
    return met.unionByName(inside.select(F.col("one").alias("id_a"), F.col("two").alias("id_b"), (F.col("same") / F.lit(trees)).alias("proximity")))


def rarest_trees(classes: DataFrame, k: int) -> DataFrame:
    """(class_id, rare): the trees in which a class has its k rarest leaves."""
    cells = classes.select("class_id", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = cells.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("rows"))
    rare = F.slice(F.array_sort(F.collect_list(F.struct("rows", "tree", "leaf"))), 1, k)
    return cells.join(sizes, ["tree", "leaf"]).groupBy("class_id").agg(F.transform(rare, lambda r: r["tree"]).alias("rare"))


def leaf_matrix(column: pa.ChunkedArray, missing: int) -> np.ndarray:
    """Lists of leaves as rows of a matrix; ``missing`` stands for a null leaf and behind a shorter list."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    out = np.full((len(lists), lengths.max(initial=0)), missing, dtype=np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().fill_null(missing).to_numpy()
    return out


# --- word vectors -------------------------------------------------------------------------------


def train_word_vectors(
    docs: DataFrame, size: int = 100, window: int = 5, min_count: int = 5, seed: int = 11, partition_tokens: int = 1_000_000, max_iter: int = 1,
    most_partitions: int = 12,
) -> DataFrame:
    """(word, vector) learned from a ``tokens`` column, in one partition per ``partition_tokens`` tokens, but at most ``most_partitions``.

    Partitions are trained side by side and their vectors averaged after each pass, so raise ``max_iter`` with their number. Each
    partition shuffles the vectors of all words it has met, so their number must not grow with the tokens; a longer one takes its
    tokens one by one and holds no more.
    """
    rows = stage(docs.select("tokens"))
    tokens = rows.agg(F.sum(F.size("tokens"))).first()[0] or 0
    model = Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, seed=seed, numPartitions=max(1, min(most_partitions, -(-tokens // partition_tokens))), maxIter=max_iter,
        inputCol="tokens", outputCol="mean",
    ).fit(rows)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
