"""Forum threads: one text file per thread, or many behind ``==> name <==`` lines in one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.text import strip_vote_suffix

# Section markers and fields of the thread files.
HEADER = r"(?:Description|Reply): ([^/]+)/ (.*)"
STATS = {
    "nreplies": ("Replies: ([0-9]+)", "int"),
    "rating": (r"Avg\. Rating: ([0-9\.]+)", "double"),
    "views": ("Views: ([0-9]+)", "int"),
    "votes": ("Votes: ([0-9]+)", "int"),
    "shares": ("Shares: ([0-9]+)", "int"),
}
FILE_ID = r"([0-9]{7})[^/]*$"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def post_author(header: Column) -> Column:
    return F.rtrim(F.regexp_extract(header, HEADER, 1))


def post_date(header: Column) -> Column:
    """Time of ``Oct 8th, 2001`` or ``Wed, 10/10/2001 - 09:58``, NULL if it is neither."""
    text = F.trim(F.regexp_extract(header, HEADER, 2))
    plain = F.regexp_replace(text, "([0-9])(st|nd|rd|th)", "$1")
    day = F.try_to_timestamp(plain, F.lit("MMM d, yyyy"))
    minute = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]+, ", ""), F.lit("MM/dd/yyyy - HH:mm"))
    return F.coalesce(day, minute)


def parse_post_header(header: Column) -> Column:
    """Struct (author, date) of a ``Description:`` or ``Reply:`` line."""
    return F.struct(post_author(header).alias("author"), post_date(header).alias("date"))


def parse_post_stats(line: Column) -> Column:
    """Struct of the numbers in a ``Statistics:`` line; missing ones are NULL."""
    return F.struct(
        *[_or_null(F.regexp_extract(line, pattern, 1)).try_cast(kind).alias(name) for name, (pattern, kind) in STATS.items()]
    )


def _files(spark: SparkSession, path: str, id_pattern: str, bundled: bool) -> DataFrame:
    """(post_id, value) per thread; ``bundled`` files hold many, each after a line with its name, and are splittable."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if not bundled:
        return reader.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", id_pattern, 1).alias("post_id"), "value")
    parts = reader.option("lineSep", "==> ").text(path).where(F.contains("value", F.lit(" <==\n")))
    name = F.substring_index("value", " <==\n", 1)
    return parts.select(F.regexp_extract(name, id_pattern, 1).alias("post_id"), F.substring("value", F.length(name) + 6, F.length("value")).alias("value"))


def forum_posts(spark: SparkSession, path: str, id_pattern: str = FILE_ID, bundled: bool = False) -> DataFrame:
    """Thread files → posts by section markers. Files without a description drop out."""

    def after(marker, group=1):
        return F.regexp_extract("value", rf"(?m)^{marker}:.*\n(.*)$", group)

    description = r"(?m)^(Description: .*)\n(.*)$"
    header = F.regexp_extract("value", description, 1)
    text = F.rtrim(strip_vote_suffix(F.regexp_extract("value", description, 2)))
    blocks = F.regexp_extract_all("value", F.lit(r"(?m)^Reply: .*\n.*$"), F.lit(0))

    def reply(block):
        head, body = F.split_part(block, F.lit("\n"), F.lit(1)), F.split_part(block, F.lit("\n"), F.lit(2))
        return F.struct(post_author(head).alias("author"), post_date(head).alias("date"), F.rtrim(body).alias("text"))

    stats = parse_post_stats(F.regexp_extract("value", "(?m)^Statistics:.*$", 0))
    return (
        _files(spark, path, id_pattern, bundled)
        .where(header != "")
        .select(
            F.lit("forum").alias("source"), "post_id",
            F.rtrim(after("Title")).alias("title"), F.rtrim(after("URL")).alias("url"), stats.alias("stats"),
            post_author(header).alias("author"), post_date(header).alias("posted_at"), text.alias("text"),
            F.transform(blocks, reply).alias("comments"),
        )
        .select("source", "post_id", "title", "url", "stats.*", "author", "posted_at", "text", "comments")
    )


def forum_posts_positional(spark: SparkSession, path: str, id_pattern: str = FILE_ID, bundled: bool = False) -> DataFrame:
    """The same files by fixed line numbers; replies are every third line from line 14 on."""
    lines = F.split("value", "\n")
    replies = F.filter(lines, lambda x, i: (i >= 13) & ((i - 13) % 3 == 0))
    line = lambda n: F.try_element_at(lines, F.lit(n))
    return _files(spark, path, id_pattern, bundled).select(
        "post_id", line(3).alias("title"), line(6).alias("url"), line(8).alias("stats"), line(11).alias("text"),
        F.array_join(replies, " ").alias("replies"),
    )
