"""A cleaning pipeline over ``documents``; every stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseweave.llm import decontam, langid, pieces, quality, queries, simhash
from caseweave.session import stage


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under column names that no operator uses, and who is who; stages turn them back."""
    names = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text finds too unlikely go."""
    inner, name = apart(docs)
    judged = quality.classify(inner, queries.table(spark, sf_dir, "labels"), doc_id=name["doc_id"], text=name["text"], lang=name["lang"])
    return judged.filter("kept").select(*name.values()).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those of no clear language go."""
    inner, name = apart(docs)
    found = langid.identify(inner, queries.language_model(docs), text=name["text"])
    return found.filter("not rejected").select(*name.values()).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: SimHash over three words, links at two bits or fewer."""
    return simhash.keep_first(docs, radius=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontam.without_items(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, decoded again; the digests of both stand beside the document.

    A made column whose name the documents have already gets underscores at its end.
    """
    inner, name = apart(docs)
    made = queries.piece_digests(pieces.encode_decode(inner, public_tokenizers.path("piece_bpe_32k.model"), name["text"]))
    taken, out = {c.lower() for c in docs.columns}, list(docs.columns)
    for column in made.columns[len(out):]:
        while column.lower() in taken:
            column += "_"
        out.append(column)
    return made.toDF(*out)


STAGES = [
    ("quality_classifier", classify_quality),
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encode", encode),
]

#: The language model, the classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
