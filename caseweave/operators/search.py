"""Search and similarity over term weights and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.functions import vectors as vec
from caseweave.operators.ordering import top_k_per_group
from caseweave.session import fresh_path, release, stage

#: Rows of a block that is compared with another block at once, and their entries.
POSTINGS, BLOCK_ENTRIES = 2048, 600_000
#: Copies in a slice of a group whose pairs are listed.
COPIES = 2048
#: Products of two weights and cells of a pair table that are held at once.
PRODUCTS, CELLS = 1_000_000, 1_000_000
#: Products of a query's and a document's term in a task of a search, and bytes of query terms that go to all tasks.
SCORED, SENT = 1_000_000, 32 << 20
#: Blocks of a word table that go to all tasks in one job.
AT_ONCE = 2


# --- sparse term weights ------------------------------------------------------------------------


def query_weights(query_tf: DataFrame, idf: DataFrame) -> DataFrame:
    """Unit weights of query texts under a fitted (term, idf) vocabulary."""
    raw = query_tf.join(idf.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("query_id")))
    return raw.withColumn("length", length).select("query_id", "term", (F.col("w") / F.col("length")).alias("w"))


def sparse_scores(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """Dot product of each query with each document that shares a term with it."""
    return (
        queries.select("query_id", "term", F.col("w").alias("wq"))
        .join(weights, "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("wq") * F.col("w")).alias("score"))
    )


def best_docs(scores: DataFrame, k: int, skip: int = 0) -> DataFrame:
    ranked = top_k_per_group(scores, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")], k + skip)
    return ranked.where(F.col("rank") > skip)


def similar_docs(query_tf: DataFrame, idf: DataFrame, weights: DataFrame, k: int = 9, skip: int = 1) -> DataFrame:
    """New texts → unit TF-IDF → the k best documents after the ``skip`` best.

    Weights of the queries' terms are dealt by document and scored where they lie, as in ``search_posts``.
    """
    queries = stage(query_weights(query_tf, idf).select("query_id", "term", "w"))
    size = queries.agg(F.sum(F.octet_length("term") + 48)).first()[0]
    sent = F.broadcast if (size or 0) <= SENT else lambda df: df
    postings = stage(weights.select("doc_id", "term", "w").join(sent(queries.select("term").distinct()), "term", "left_semi"))
    asked = queries.groupBy("term").agg(F.count(F.lit(1)).alias("queries"))
    products = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(asked, "term").agg(F.sum(F.col("df") * F.col("queries"))).first()[0] or 0
    parts = max(weights.sparkSession.sparkContext.defaultParallelism, -(-products // SCORED))
    return best_docs(sparse_scores(sent(queries), postings.repartition(parts, "doc_id")), k, skip)


def similar_to_doc(weights: DataFrame, doc_id, k: int | None = None) -> DataFrame:
    """All documents that share a term with one document, by cosine (``weights`` have norm 1)."""
    own = weights.where(F.col("doc_id") == doc_id).select(F.col("doc_id").alias("query_id"), "term", "w")
    scores = sparse_scores(own, weights).orderBy(F.round("score", 9).desc(), "doc_id")
    return scores if k is None else scores.limit(k)


def copy_marks() -> list[Column]:
    """Aggregates of a document's (term, w): two 64-bit folds, one of them a sum kept in halves, and their number."""
    h = F.xxhash64("term", F.round("w", 10))
    return [F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 32)).alias("s"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("r"), F.count(F.lit(1)).alias("n")]


def first_copies(marks: DataFrame) -> DataFrame:
    """(doc_id, first_id) of rows (doc_id, *copy_marks): those with the same marks share the smallest of their ids."""
    first = marks.groupBy("x", "s", "r", "n").agg(F.min("doc_id").alias("first_id"))
    return marks.join(first, ["x", "s", "r", "n"]).select("doc_id", "first_id")


def identical_rows(weights: DataFrame) -> DataFrame:
    """(doc_id, first_id): documents with the same weights share the smallest of their ids.

    Rows are compared by two 64-bit folds and their number, without collecting them.
    """
    return first_copies(weights.groupBy("doc_id").agg(*copy_marks()))


def pairwise_doc_similarity(weights: DataFrame, min_sim: float, every_pair: bool = False) -> DataFrame:
    """Document pairs (a < b) with cosine of at least ``min_sim``; ``weights`` have norm 1 and are read once.

    Copies are taken out first and come back as one pair (first copy, copy) each, so a group of copies gives a row per copy, not
    per pair; with ``every_pair`` they come back in all pairs, of two copies and of a copy with what its first is near to. The
    different rows are staged whole, in files of at most POSTINGS rows, and every pair of
    blocks of files is compared by itself (``near_rows``): work is the square of the blocks, but no candidate pair is shuffled
    or written. Tasks read their two blocks from the shared folder, which must be one that Arrow can open. Ids may repeat; their
    norm may then be over 1, and they lose no pair by it.
    """
    spark = weights.sparkSession
    listed = F.collect_list(F.when(F.col("term").isNotNull() & F.col("w").isNotNull(), F.struct("term", "w")))
    grouped = weights.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*copy_marks(), listed.alias("entries"))
    path = fresh_path(spark, "stage")
    grouped.write.option("maxRecordsPerFile", POSTINGS).option("compression", "zstd").parquet(path)
    rows = spark.read.schema(grouped.schema).parquet(path)
    copies = stage(first_copies(rows.drop("entries")).where("doc_id <> first_id"))
    sizes = rows.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("entries")).alias("size"))
    files = blocks_of_files([(r["file"], r["n"], r["size"]) for r in sizes.orderBy("file").collect()])  # a row per POSTINGS documents or task
    dropped, kind = copies.inputFiles(), rows.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = left = at = None
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if gone is None:
                    gone = read_columns(dropped, ["doc_id"])["doc_id"]
                if at != i:
                    left, at = block_rows(files[i], gone), i
                right = left if i == j else block_rows(files[j], gone)
                a, b, score = near_rows(left["entries"], right["entries"], min_sim, i == j)
                for start in range(0, len(score), 1 << 16):
                    part = slice(start, start + (1 << 16))
                    ids = [side["doc_id"].take(pa.array(x[part])).combine_chunks() for side, x in ((left, a), (right, b))]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(score[part])], names=["one", "two", "similarity"])

    n = len(files)
    pairs = spark.range(n * n).select(F.expr(f"id DIV {max(1, n)}").alias("i"), (F.col("id") % max(1, n)).alias("j")).where("i <= j")
    # few bytes but much work per row: keep adaptive execution from merging the partitions
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = pairs.repartition(parts).sortWithinPartitions("i", "j").mapInArrow(compare, f"one {kind}, two {kind}, similarity double")
    near = met.select(F.least("one", "two").alias("doc_a"), F.greatest("one", "two").alias("doc_b"), "similarity")
    if every_pair:
        return pairs_with_copies(near, copies)
    return near.unionByName(copies.select(F.col("first_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("similarity")))


def pairs_with_copies(near: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs of different documents → pairs of all: ``copies`` (doc_id, first_id) names each copy's first, which stands for it in ``near``.

    A large group is cut into slices of COPIES rows, each of which meets the whole group, so its pairs are many tasks.
    """
    sizes = copies.groupBy("first_id").agg(F.ceil((F.count(F.lit(1)) + 1) / COPIES).cast("int").alias("slices"))
    group = copies.unionByName(sizes.select(F.col("first_id").alias("doc_id"), "first_id"))
    for side in ("doc_a", "doc_b"):
        near = near.join(group.select(F.col("first_id").alias(side), F.col("doc_id").alias("copy")), side, "left")
        near = near.withColumn(side, F.coalesce("copy", side)).drop("copy")
    met = near.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "similarity")
    sliced = group.join(sizes, "first_id")
    one = sliced.select("first_id", F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice"), F.col("doc_id").alias("doc_a"))
    two = sliced.select("first_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("doc_id").alias("doc_b"))
    inside = one.join(two, ["first_id", "slice"]).where("doc_a < doc_b")
    return met.unionByName(inside.select("doc_a", "doc_b", F.lit(1.0).alias("similarity")))


def blocks_of_files(sizes: list[tuple[str, int, int]]) -> list[list[str]]:
    """Files (name, rows, entries) in blocks of at most POSTINGS rows and BLOCK_ENTRIES entries; a larger file is a block alone."""
    blocks, rows, entries = [], 0, 0
    for name, n, size in sizes:
        if not blocks or rows + n > POSTINGS or entries + size > BLOCK_ENTRIES:
            blocks, rows, entries = [*blocks, []], 0, 0
        blocks[-1].append(name)
        rows, entries = rows + n, entries + size
    return blocks


def read_columns(files: list[str], columns: list[str]) -> pa.Table:
    parts = []
    for name in files:
        system, path = fs.FileSystem.from_uri(name)
        with system.open_input_file(path) as source:
            parts.append(pq.read_table(source, columns=columns))
    return pa.concat_tables(parts)


def block_rows(files: list[str], gone: pa.ChunkedArray) -> pa.Table:
    """(doc_id, entries) of the files, without the ids that are gone and without empty rows."""
    rows = read_columns(files, ["doc_id", "entries"])
    kept = pc.and_(pc.invert(pc.is_in(rows["doc_id"], value_set=gone)), pc.greater(pc.list_value_length(rows["entries"]), 0))
    return rows.filter(kept)


def flat_entries(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(start of each row and the end of the last, terms, weights) of lists of (term, w)."""
    lists = column.combine_chunks()
    starts, cells = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64), lists.flatten()
    return starts, cells.field(0), cells.field(1).to_numpy()


def sorted_entries(starts: np.ndarray, code: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, row, code, weight) of the entries by row and code; weights of a code that comes twice in a row are added up."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(row * (int(code.max(initial=0)) + 1) + code)  # one number for row and code
    row, code, w = row[order], code[order], w[order]
    new = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)]
    if not new.all():
        row, code, w = row[new], code[new], np.add.reduceat(w, np.flatnonzero(new))
    return np.searchsorted(row, np.arange(len(starts))), row, code, w


def squares(w: np.ndarray) -> np.ndarray:
    """Running sums of the squares in units of 2**-40, rounded up, so that they are exact."""
    return np.concatenate([[0], np.cumsum(np.ceil(w**2 * 2.0**40).astype(np.int64))])


def prefixes(starts: np.ndarray, row: np.ndarray, before: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(entries, cut): a row's entries in their order, as far as the norm of the rest is ``bound`` or more; and the norm of what is left over."""
    rest = np.sqrt((before[starts[row + 1]] - before[:-1]) / 2.0**40)  # from this term on
    kept = rest >= bound
    cut = np.zeros(len(starts) - 1)
    np.maximum.at(cut, row[~kept], rest[~kept])
    return np.flatnonzero(kept), cut


def near_rows(left: pa.ChunkedArray, right: pa.ChunkedArray, min_sim: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, dot) of rows of (term, w) lists with a dot product of at least ``min_sim``; ``same``: the sides are one block, i < j.

    It is exact prefix filtering: terms are ordered from rare to frequent (among these rows) and a row's prefix ends where the norm
    of the rest falls below a bound under ``min_sim``. Then for any two rows, the score over shared prefix terms plus the larger
    of the two rest norms, times the largest norm of a row if that is over 1, is at least their product. Only pairs that can still reach ``min_sim`` get the full dot product.
    """
    found = [np.empty((0, 2), dtype=np.int64)], [np.empty(0)]
    if not len(left) or not len(right):
        return found[0][0][:, 0], found[0][0][:, 1], found[1][0]
    (sa, ta, wa), (sb, tb, wb) = flat_entries(left), flat_entries(right)
    terms = pa.chunked_array([ta] if same else [ta, tb]).dictionary_encode().combine_chunks()
    code = terms.indices.to_numpy()
    rank = np.empty(len(terms.dictionary), dtype=np.int32)
    rank[np.argsort(np.bincount(code, minlength=len(rank)), kind="stable")] = np.arange(len(rank))
    size = len(rank)
    sa, row_a, ca, wa = sorted_entries(sa, rank[code[: len(ta)]], wa)
    sb, row_b, cb, wb = (sa, row_a, ca, wa) if same else sorted_entries(sb, rank[code[len(ta) :]], wb)
    before_a, before_b = squares(wa), squares(wb)
    longest = max(1.0, *(np.sqrt(np.diff(x[y]).max(initial=0) / 2.0**40) for x, y in ((before_a, sa), (before_b, sb))))
    pa_, cut_a = prefixes(sa, row_a, before_a, 0.85 * min_sim / longest)
    pb, cut_b = (pa_, cut_a) if same else prefixes(sb, row_b, before_b, 0.85 * min_sim / longest)
    cut_a, cut_b = longest * cut_a, longest * cut_b
    pb = pb[np.argsort(cb[pb], kind="stable")]  # the postings of the right side
    count = np.bincount(cb[pb], minlength=size)
    first = np.cumsum(count) - count
    products = np.bincount(row_a[pa_], weights=count[ca[pa_]], minlength=len(left))
    ends, at, up, nb, dense = np.searchsorted(row_a[pa_], np.arange(len(left) + 1)), 0, np.cumsum(products), len(right), np.zeros(size)
    while at < len(left):
        most = np.searchsorted(up, (up[at - 1] if at else 0) + PRODUCTS, "right")
        upto = min(len(left), at + max(1, CELLS // nb), max(at + 1, int(most)))
        own = pa_[ends[at] : ends[upto]]
        n = count[ca[own]]
        b = pb[np.repeat(first[ca[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        cell = (np.repeat(row_a[own], n) - at) * nb + row_b[b]
        shared = np.bincount(cell, weights=np.repeat(wa[own], n) * wb[b], minlength=(upto - at) * nb).reshape(-1, nb)
        i, j = np.nonzero((shared > 0) & (shared + np.maximum(cut_a[at:upto, None], cut_b) >= min_sim - 1e-9))
        i += at
        i, j = (i[i < j], j[i < j]) if same else (i, j)
        of, starts = np.unique(i, return_index=True)
        for r, start, end in zip(of, starts, np.append(starts, len(i))[1:], strict=True):
            own, to = slice(sa[r], sa[r + 1]), j[start:end]
            np.add.at(dense, ca[own], wa[own])
            n = sb[to + 1] - sb[to]
            e = np.repeat(sb[to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            dots = np.add.reduceat(dense[cb[e]] * wb[e], np.cumsum(n) - n)
            dense[ca[own]] = 0
            near = dots >= min_sim
            found[0].append(np.stack([np.full(near.sum(), r), to[near]], axis=1))
            found[1].append(dots[near])
        at = upto
    pairs = np.concatenate(found[0])
    return pairs[:, 0], pairs[:, 1], np.concatenate(found[1])


def search_posts(query_tf: DataFrame, tf: DataFrame, size: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``size`` best documents of each query text by BM25 over the term table.

    Postings are dealt by document to as many tasks as there are SCORED products of a query's and a document's term, and scored
    where they lie, so what a task holds does not grow with the documents. Only query texts of over ``SENT`` bytes are joined by a shuffle.
    """
    lengths = tf.groupBy("doc_id").agg(F.first("doc_len").alias("doc_len"))
    stats = lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("doc_len").alias("avg_len"))
    n, avg_len = stats.select("n").scalar(), stats.select("avg_len").scalar()
    wanted = query_tf.select("query_id", "term", F.col("tf").alias("qtf"))
    asked = stage(wanted.groupBy("term").agg(F.count(F.lit(1)).alias("queries")))
    bytes_sent = wanted.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
    sent = F.broadcast if bytes_sent <= SENT else lambda df: df
    postings = tf.join(sent(asked.select("term")), "term", "left_semi")
    df = stage(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    products = df.join(asked, "term").agg(F.sum(F.col("df") * F.col("queries"))).first()[0] or 0
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / avg_len))
    parts = max(tf.sparkSession.sparkContext.defaultParallelism, -(-products // SCORED))
    dealt = postings.select("doc_id", "term", gain.alias("gain")).repartition(parts, "doc_id")
    scores = (
        dealt.join(sent(wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("wq"))), "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("wq") * F.col("gain")).alias("score"))
    )
    return best_docs(scores, size)


# --- dense vectors ------------------------------------------------------------------------------


def vector_sum(column: str = "vector", weight: Column | None = None) -> Column:
    """Aggregate: the (weighted) sum of array vectors, with partial sums in the map tasks."""
    v = array_to_vector(F.col(column))
    return vector_to_array(Summarizer.sum(v) if weight is None else Summarizer.sum(v, weight))


def word_lookup(words: DataFrame, embedding: DataFrame) -> DataFrame:
    """(term, vector) of the known words; unknown ones are tried again with digits as ``#``."""
    known = embedding.select(F.col("word").alias("key"), "vector")
    distinct = words.select("term").distinct()
    direct = distinct.join(known, distinct["term"] == known["key"], "left")
    masked = direct.where("vector IS NULL").select("term", F.regexp_replace("term", "[0-9]", "#").alias("key"))
    return direct.where("vector IS NOT NULL").select("term", "vector").unionByName(masked.join(known, "key").select("term", "vector"))


def embed_by_word_mean(tf: DataFrame, embedding: DataFrame, send_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, vector): sum of the known word vectors over the number of all tokens.

    The word table goes to all tasks in blocks of at most about ``send_bytes``, with a pass over the terms each, so no vector
    is shuffled with a term: a document's terms are summed where they lie, into one number per entry, and a document is
    shuffled as one sum per task and block. At most AT_ONCE blocks are sent in one job, as the driver holds them all: with
    more, the sums so far are stored and go into the next job as rows of their own.
    """
    known = stage(word_lookup(tf, embedding))
    length = F.size("vector")
    size, least, width, holes = known.agg(F.sum(length * 8 + 64), F.min(length), F.max(length), F.max(F.exists("vector", lambda x: x.isNull()))).first()
    if holes or least != width:
        raise ValueError("word vectors with null entries or of different lengths")
    blocks, held = max(1, -(-(size or 0) // send_bytes)), None
    for first in range(0, blocks, AT_ONCE):
        hits = held
        for block in range(first, min(blocks, first + AT_ONCE)):
            words = known if blocks == 1 else known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
            part = tf.select("doc_id", "term", "tf", "doc_len").join(F.broadcast(words), "term").drop("term")
            hits = part if hits is None else hits.unionByName(part)
        sums = hits.groupBy("doc_id").agg(
            F.max("doc_len").alias("n"), *[F.sum(F.col("vector")[i] * F.col("tf").cast("double")).alias(f"s{i}") for i in range(width or 0)]
        )
        if first + AT_ONCE < blocks:
            done = stage(sums.select("doc_id", F.lit(1).alias("tf"), F.col("n").alias("doc_len"), F.array(*[f"s{i}" for i in range(width)]).alias("vector")))
            release(held)
            held = done
    return sums.select("doc_id", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(width or 0)]).cast("array<double>").alias("vector"))


def embed_concat(parts: list[DataFrame]) -> DataFrame:
    """Vectors of several embeddings side by side."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part.withColumnRenamed("vector", "more"), "doc_id").select("doc_id", F.concat("vector", "more").alias("vector"))
    return out


def nearest_to(vectors: DataFrame, key: str, value, k: int = 10, score: Callable[[Column, Column], Column] = vec.euclidean_similarity) -> DataFrame:
    """The k rows nearest to one row (itself included), best first."""
    target = vectors.where(F.col(key) == value).select("vector").scalar()
    scored = vectors.withColumn("_target", target).select(key, score(F.col("vector"), F.col("_target")).alias("score"))
    return scored.where("score IS NOT NULL").orderBy(F.round("score", 9).desc(), key).limit(k)


def target_blocks(targets: DataFrame, max_bytes: int = 8 << 20) -> list[DataFrame]:
    """Target vectors in blocks of at most about ``max_bytes``, by measured size."""
    size = targets.agg(F.sum(F.size("vector") * 8 + 32)).scalar()
    n = max(1, -(-int(targets.sparkSession.range(1).select(size).first()[0] or 0) // max_bytes))
    return [targets if n == 1 else targets.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def cross_scores(vectors: DataFrame, targets: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Score of every vector with each target vector (id, vector): a pass over the vectors per block of targets."""
    out = None
    for block in target_blocks(targets.select("id", "vector")):
        items = block.agg(F.collect_list(F.struct("id", "vector"))).scalar()
        pairs = F.transform("_items", lambda t: F.struct(t["id"].alias("target"), score(F.col("vector"), t["vector"]).alias("score")))
        part = vectors.withColumn("_items", items).select("id", F.explode(pairs).alias("p")).select("id", "p.target", "p.score")
        out = part if out is None else out.unionByName(part)
    return out


def cross_distances(vectors: DataFrame, targets: DataFrame) -> DataFrame:
    return cross_scores(vectors, targets, vec.euclidean_distance).withColumnRenamed("score", "distance")


def cross_similarities(vectors: DataFrame, targets: DataFrame) -> DataFrame:
    """1 − distance."""
    return cross_distances(vectors, targets).select("id", "target", (1 - F.col("distance")).alias("similarity"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest vectors of each query vector, by Euclidean distance."""
    scores = cross_distances(vectors, queries).select(F.col("target").alias("query_id"), "id", "distance")
    return top_k_per_group(scores, ["query_id"], [F.round("distance", 9), F.col("id")], k)


class PivotIndex:
    """Vectors (id, vector) in cells around pivots, stored with their distance to the pivot, for exact searches that skip cells and rows.

    By the triangle inequality a row v of the cell of pivot p is no nearer to a query q than d(q, p) - d(v, p) in size, and
    no row of the cell is nearer than d(q, p) less the cell's radius. A cell of more than ``held`` rows is cut into parts.
    """

    def __init__(self, vectors: DataFrame, pivots: int = 64, held: int = 20_000):
        spread_out = vectors.select("id", "vector").where("vector IS NOT NULL").orderBy(F.xxhash64("id", "vector"), "id").limit(pivots)
        items = stage(spread_out).agg(F.collect_list("vector")).scalar()  # ``pivots`` vectors
        distances = F.transform("_pivots", lambda p, i: F.struct(vec.euclidean_distance(F.col("vector"), p).alias("d"), i.alias("cell")))
        self.distances = lambda df: df.withColumn("_pivots", items).withColumn("_d", distances).drop("_pivots")
        near = self.distances(vectors.select("id", "vector").where("vector IS NOT NULL")).withColumn("_n", F.array_min("_d"))
        placed = stage(near.select("id", "vector", F.col("_n.cell").alias("cell"), F.col("_n.d").alias("to_pivot")))
        cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("to_pivot").alias("radius"), F.min("to_pivot").alias("inner"))
        self.cells = stage(cells.withColumn("parts", F.ceil(F.col("size") / held).cast("int")))
        parted = placed.join(self.cells.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        self.rows = stage(parted.select("cell", "part", "id", "vector", "to_pivot"))

    def _meet(self, pairs: DataFrame) -> DataFrame:
        """(query_id, id, distance) of pairs (query_id, q, cell, parts, d, least) for the rows that can be within ``least``."""
        wide = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        close = self.rows.join(wide, ["cell", "part"]).where(F.abs(F.col("d") - F.col("to_pivot")) <= F.col("least") + 1e-9)
        return close.select("query_id", "id", vec.euclidean_distance(F.col("vector"), F.col("q")).alias("distance"))

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance) of every row that can be among the k nearest of a query (id, vector), and few others.

        The nearest cells that hold k rows together give a first bound, their rows the k-th distance; only cells and rows
        that can come below it are measured then.
        """
        asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
        named = self.distances(asked.withColumnRenamed("q", "vector")).select("query_id", F.col("vector").alias("q"), F.explode("_d").alias("c"))
        pairs = stage(named.select("query_id", "q", "c.cell", "c.d").join(self.cells, "cell"))
        by_distance = W.partitionBy("query_id").orderBy("d", "cell").rowsBetween(W.unboundedPreceding, -1)
        nearest = pairs.withColumn("before", F.coalesce(F.sum("size").over(by_distance), F.lit(0))).where(F.col("before") < k)
        bound = nearest.groupBy("query_id").agg(F.max(F.col("d") + F.col("radius")).alias("least"))
        first = self._meet(nearest.join(bound, "query_id"))
        found = top_k_per_group(first, ["query_id"], [F.col("distance")], k).groupBy("query_id").agg(F.max("distance").alias("least"))
        bounded = pairs.join(stage(found), "query_id")
        reach = (F.col("d") - F.col("radius") <= F.col("least") + 1e-9) & (F.col("inner") - F.col("d") <= F.col("least") + 1e-9)
        return self._meet(bounded.where(reach))

    def nearest(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """(query_id, id, distance, rank): the k nearest vectors of each query, as ``nearest_vectors`` gives them."""
        return top_k_per_group(self.candidates(queries, k), ["query_id"], [F.round("distance", 9), F.col("id")], k)


def semantic_rerank(
    candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, neighbors: int = 3,
    similarity: Callable[[Column, Column], Column] = vec.cosine_similarity,
) -> DataFrame:
    """Candidates of a first search, ranked anew by the similarity of their vectors."""
    joined = candidates.select("query_id", "doc_id").join(doc_vectors, "doc_id").join(
        query_vectors.select("query_id", F.col("vector").alias("qv")), "query_id"
    )
    scores = joined.select("query_id", "doc_id", similarity(F.col("qv"), F.col("vector")).alias("score"))
    return best_docs(scores.where("score IS NOT NULL"), neighbors)
