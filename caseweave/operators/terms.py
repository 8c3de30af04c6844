"""Term tables: frequencies, vocabularies and weights.

The term table is long: ``(doc_id, term, tf, doc_len)``, with ``doc_len`` the number of all tokens of the
document. It carries the length so that weighting needs no second pass over the texts. Tables with one
row per term join by ``term``; such joins have very uneven keys, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.session import stage

#: Tokens and bytes of tokens that are counted at once (a longer document is counted alone).
COUNTED, COUNTED_BYTES = 1 << 18, 8 << 20
#: Rows of a term table whose norms are taken at once, and bytes of a vocabulary that goes to all tasks for it.
WEIGHTED, VOCABULARY = 1 << 17, 64 << 20


def token_slices(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of documents of at most COUNTED tokens and about COUNTED_BYTES."""
    ends = lists.offsets.to_numpy()
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(lists.values), 0).to_numpy(), dtype=np.int64)])[ends]
    start = 0
    while start < len(lists):
        most = min(np.searchsorted(ends, ends[start] + COUNTED, "right"), np.searchsorted(size, size[start] + COUNTED_BYTES, "right"))
        end = min(len(lists), max(start + 1, int(most) - 1))
        yield start, end
        start = end


def term_freq(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Count of each term per document; a document is one row.

    All tokens of a document are in its row, so they are counted there, some documents at a time, and nothing is shuffled.
    """
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, k) for n, k in (("term", T.StringType()), ("tf", T.LongType()), ("doc_len", T.LongType()))]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, b - a) for batch in batches for a, b in token_slices(batch.column(1))):
            lists = part.column(1)
            row = pc.list_parent_indices(lists).to_numpy()
            words = lists.flatten().dictionary_encode()
            code = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.bincount(row, minlength=part.num_rows)
            n = max(1, len(words.dictionary))
            cells, counts = np.unique(row[code >= 0].astype(np.int64) * n + code[code >= 0], return_counts=True)
            at = cells // n
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), words.dictionary.take(pa.array(cells % n)), pa.array(counts), pa.array(lengths[at])], names=schema.names
            )

    return docs.select("doc_id", F.col(tokens).alias("tokens")).mapInArrow(count, schema)


def doc_freq(tf: DataFrame) -> DataFrame:
    """Number of documents and total count per term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def top_terms_by_df(tf: DataFrame, n: int = 50_000) -> DataFrame:
    """The n terms found in most documents."""
    return doc_freq(tf).orderBy(F.desc("df"), "term").limit(n)


def term_totals(tf: DataFrame, min_total: int = 1) -> DataFrame:
    return doc_freq(tf).where(F.col("total") >= min_total).select("term", "total")


def trim_terms_by_freq(tf: DataFrame, n: int, rarest: bool = False) -> DataFrame:
    """The n terms of highest total count, or of lowest with ``rarest``."""
    total = F.asc("total") if rarest else F.desc("total")
    return term_totals(tf).orderBy(total, "term").limit(n)


def doc_term_totals(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """Total count per term over the chosen documents only."""
    return term_totals(tf.join(docs.select("doc_id"), "doc_id", "left_semi"))


def drop_hapax(tf: DataFrame) -> DataFrame:
    """Drop terms seen only once in the whole corpus."""
    return tf.join(term_totals(tf, 2).select("term"), "term", "left_semi")


def prune_sparse_terms(tf: DataFrame, n_docs: Column | int, sparse: float) -> DataFrame:
    """Keep terms with df > N·(1 − sparse)."""
    kept = doc_freq(tf).where(F.col("df") > F.lit(n_docs) * F.lit(1.0 - sparse)).select("term")
    return tf.join(kept, "term", "left_semi")


def bound_vocabulary(
    tf: DataFrame, n_docs: Column | int, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None
) -> DataFrame:
    """Vocabulary within document-frequency bounds; a float bound is a share of the documents.

    ``max_features`` keeps the terms of highest total count.
    """

    def bound(value):
        return F.lit(n_docs) * F.lit(value) if isinstance(value, float) else F.lit(value)

    kept = doc_freq(tf).where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))
    return kept if max_features is None else kept.orderBy(F.desc("total"), "term").limit(max_features)


IDF_FORMS = {
    "ln": lambda n, df: F.log(n / df),
    "smooth": lambda n, df: F.log((n + 1) / (df + 1)) + 1,
    "log2": lambda n, df: F.log2(n / df),
    "shifted": lambda n, df: F.log((n + 1) / (df + 1)),
}


def idf(vocabulary: DataFrame, n_docs: Column | int, form: str | Callable[[Column, Column], Column] = "ln") -> DataFrame:
    """Inverse document frequency: ln(N/df), smooth ln((1+N)/(1+df))+1, log2(N/df) or ln((N+1)/(df+1)).

    ``form`` names one of these or is a function of (N, df).
    """
    weigh = form if callable(form) else IDF_FORMS[form]
    return vocabulary.withColumn("idf", weigh(F.lit(n_docs), F.col("df")))


def tfidf(
    tf: DataFrame, n_docs: Column | int, idf_form: str | Callable[[Column, Column], Column] = "ln", by_length: bool = True, l2: bool = False,
    vocabulary: DataFrame | None = None, together: bool = False,
) -> DataFrame:
    """Weights ``w`` = tf (over document length) × idf, optionally with rows of norm 1.

    The document length counts all tokens, those outside the vocabulary too. ``together`` says that no id comes twice and that the
    rows of a document follow one another in one partition, as ``term_freq`` makes them (read from files they may not). Then norms of 1
    need no shuffle: the vocabulary goes to all tasks, unless it is larger than VOCABULARY, and documents are weighed where they lie.
    """
    inverse = idf(doc_freq(tf) if vocabulary is None else vocabulary, n_docs, idf_form).select("term", "idf")
    base = F.col("tf") / F.col("doc_len") if by_length else F.col("tf")
    if together and l2:
        inverse = stage(inverse)
        if (inverse.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0) <= VOCABULARY:
            found = tf.join(F.broadcast(inverse), "term")  # keeps the order of the rows
            return unit_rows(found.select("doc_id", "term", (base * F.col("idf")).cast("double").alias("w")))
    weights = tf.join(inverse, "term").select("doc_id", "term", (base * F.col("idf")).alias("w"))
    return l2_normalize(weights) if l2 else weights


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about WEIGHTED rows that end with a document, each with its rows' documents as numbers from 0."""
    held, rows = [], 0

    def numbered(table: pa.Table) -> np.ndarray:
        code = table["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.cumsum(np.append(False, code[1:] != code[:-1])[: len(code)])

    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= WEIGHTED:
            table = pa.Table.from_batches(held)
            number = numbered(table)
            end = int(np.searchsorted(number, number[-1]))  # the last document may go on
            if end:
                yield table.slice(0, end).combine_chunks(), number[:end]
            held, rows = table.slice(end).to_batches(), rows - end
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, numbered(table)


def unit_rows(weights: DataFrame) -> DataFrame:
    """``l2_normalize`` of weights whose documents lie together."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in whole_documents(batches):
            w = rows["w"].to_numpy()
            norm = np.sqrt(np.bincount(number, weights=w * w))[number]
            part = rows.set_column(2, "w", pa.array(w / np.where(norm > 0, norm, 1.0)))
            yield from part.filter(pa.array(norm > 0)).to_batches(max_chunksize=1 << 16)

    return weights.mapInArrow(divide, weights.schema)


def l2_normalize(weights: DataFrame) -> DataFrame:
    """Divide each row by its Euclidean norm; rows of norm 0 drop out."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    return weights.withColumn("_norm", norm).where("_norm > 0").withColumn("w", F.col("w") / F.col("_norm")).drop("_norm")


def squares_about_mean(w: str, n: Column) -> Column:
    """Aggregate: squared distances from the mean over n rows, of which the present ones are at hand and the rest is zero.

    It adds the present values' own spread to what their mean differs from zero, and subtracts no large sums.
    """
    present = F.count(F.col(w))
    return present * F.var_pop(w) + present * (n - present) / n * F.avg(w) * F.avg(w)


def scale_columns(weights: DataFrame, n_docs: Column | int) -> DataFrame:
    """Divide each term's weights by their sample standard deviation; absent weights count as 0."""
    spread = weights.groupBy("term").agg(F.sqrt(squares_about_mean("w", F.lit(n_docs)) / (F.lit(n_docs) - 1)).alias("_sd")).where("_sd > 0")
    return weights.join(spread, "term").select("doc_id", "term", (F.col("w") / F.col("_sd")).alias("w"))


def vocabulary_difference(tf: DataFrame, general: DataFrame, k: int = 1000) -> DataFrame:
    """Terms of the corpus that the general vocabulary lacks, most frequent first."""
    return term_totals(tf).join(general.select("term"), "term", "left_anti").orderBy(F.desc("total"), "term").limit(k)


def docs_with_terms_freq(tf: DataFrame, seeds: Sequence[str], min_total: int = 50, k: int = 50) -> DataFrame:
    """Totals of all terms in the documents that contain any seed term."""
    hits = tf.where(F.col("term").isin(list(seeds))).select("doc_id").distinct()
    totals = doc_term_totals(tf, hits).where(F.col("total") >= min_total)
    return totals.orderBy(F.desc("total"), "term").limit(k)


def stem_terms(tf: DataFrame) -> DataFrame:
    """Term table over stems: each distinct term is stemmed once, then counts are merged."""
    from caseweave.functions.text import stem

    stems = tf.select("term").distinct().withColumn("stem", stem(F.col("term")))
    return (
        tf.join(stems, "term")
        .groupBy("doc_id", F.col("stem").alias("term"))
        .agg(F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len"))
    )
