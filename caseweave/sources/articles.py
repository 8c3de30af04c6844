"""Knowledge articles, Q&A dumps and wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.text import extract_tags, html_to_text

# Fixed value: the header at which each article tree starts.
XML_HEADER = '<?xml version="1.0"'


def techzone_posts(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """Files that hold several XML trees one after another → (post_id, text).

    Each tree starts at its XML header; lines before the first header drop out. Of several contents
    under one id the last one counts.
    """
    pieces = spark.read.text(path, lineSep=XML_HEADER).where(F.col("value").rlike(r"^[^<]*\?>"))
    found = F.regexp_extract_all("value", F.lit(r"(?s)<techZoneContent\b.*?</techZoneContent>"), F.lit(0))
    content = F.from_xml("element", "_id STRING, content ARRAY<STRING>, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    text = F.try_element_at("x.content", F.lit(-1))
    return (
        pieces.select(F.explode(found).alias("element"))
        .select(content.alias("x"))
        .where(F.col("x._corrupt_record").isNull() & (F.size("x.content") > 0))
        .select(
            F.lit("articles").alias("source"), F.col("x._id").alias("post_id"),
            (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"),
        )
    )


def qa_dump_posts(spark: SparkSession, path: str) -> DataFrame:
    """``<community>/Posts.xml`` rows → posts with plain text and tag list.

    The start of a row element separates the records, so a dump of one large file is read in parallel.
    """
    pieces = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="<row ").select(
        F.try_element_at(F.split("_metadata.file_path", "/"), F.lit(-2)).alias("source"),
        F.regexp_extract("value", r"(?s)^(.*)/>", 1).alias("attributes"),
    )
    row = F.from_xml(F.concat(F.lit("<row "), "attributes", F.lit("/>")), "_Id STRING, _Body STRING, _Tags STRING")
    return pieces.where("attributes <> ''").select("source", row.alias("r")).where("r._Id IS NOT NULL").select(
        "source", F.col("r._Id").alias("post_id"), html_to_text(F.col("r._Body")).alias("text"),
        F.coalesce(extract_tags(F.col("r._Tags")), F.array().cast("array<string>")).alias("tags"),
    )


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """``<page>`` records → (title, text) of non-empty articles that are no redirect or disambiguation."""
    pieces = spark.read.text(path, lineSep="</page>").where(F.col("value").contains("<page>"))
    page = F.from_xml(
        F.concat(F.regexp_extract("value", r"(?s)<page>.*$", 0), F.lit("</page>")),
        "title STRING, ns INT, revision STRUCT<text: STRUCT<_VALUE: STRING>>",
    )
    return pieces.select(page.alias("p")).select("p.title", "p.ns", F.col("p.revision.text._VALUE").alias("text")).where(
        (F.length(F.trim("text")) > 0)
        & (F.coalesce("ns", F.lit(0)) == 0)
        & ~F.col("text").rlike(r"(?i)^\s*#REDIRECT")
        & ~F.col("title").contains("(disambiguation)")
    ).select("title", "text")
