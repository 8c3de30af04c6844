"""Queries that write table rows in the file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.adapters import DEFECTS_SQL, defects, incidents
from caseweave.catalog.contagion import EDGES_SQL, RANK_SQL, STATS_SQL, edges_of
from caseweave.catalog.registry import query
from caseweave.functions.text import tokenize
from caseweave.operators import relational
from caseweave.plans import contagion as plan
from caseweave.session import fresh_path, spread, stage
from caseweave.sources import articles, records, tables, threads

PROLOG = '<?xml version="1.0" encoding="UTF-8"?>\n'


def escaped(c):
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def element(name, value):
    return F.concat(F.lit(f'<Field name="{name}">'), value, F.lit("\n</Field>\n"))


def defect_files(t) -> str:
    """Bug record files: all defects with an audit entry, one note per conversation turn count."""
    fields = F.flatten(
        F.transform(
            F.map_entries("metadata"),
            lambda e: F.transform(e["value"], lambda v: F.concat(F.lit('<Field name="'), e["key"], F.lit('">'), v, F.lit("\n</Field>\n"))),
        )
    )
    status = F.element_at(F.col("metadata")["Status"], 1)
    app = F.element_at(F.col("metadata")["Component"], 1)
    xml = F.concat(
        F.lit(PROLOG + '<CDETS xmlns="cdetsng">\n<Defect id="'), F.col("defect_id"), F.lit('">\n'), F.array_join(fields, ""),
        element("Headline", F.concat(F.lit("Fault in "), app)),
        element("Description", F.concat(F.lit("Component "), app, F.lit(" &amp; status "), status)),
        F.lit('<AuditTrail id="a1" defectID="'), F.col("defect_id"), F.lit('">\n'),
        element("Field", F.lit("Status")), element("NewValue", status), F.lit("</AuditTrail>\n<Notes><Note id=\"n1\">\n"),
        element("Note", F.concat(F.lit("note on "), app)), element("Title", F.lit("first")),
        F.lit("</Note></Notes>\n</Defect>\n</CDETS>"),
    )
    path = fresh_path(t.spark, "defects")
    defects(spread(t.events)).select(xml.alias("value")).write.text(path)
    return path


def records_of(t):
    return records.read_delimited_records(t.spark, defect_files(t))


@query(
    "read_delimited_records",
    "SELECT 'D' || lpad(event_id::VARCHAR, 8, '0') AS defect_id, true AS closed FROM events",
)
def _(t):
    return records_of(t).select(
        F.regexp_extract("record", 'Defect id="([^"]+)"', 1).alias("defect_id"), F.col("record").endswith("</CDETS>").alias("closed")
    )


@query(
    "parse_defects",
    f"""WITH {DEFECTS_SQL} SELECT defect_id, app_name, status, severity, strftime(closed, '%Y-%m-%d %H:%M:%S') AS to_ts,
    15 AS n_names, 'Status' AS audited FROM def""",
)
def _(t):
    parsed = stage(records.parse_defects(records_of(t)))
    inc = relational.defect_to_incident(parsed).select(
        F.col("incident_id").alias("defect_id"), "app_name", F.element_at("statuses", 1).alias("status"), "severity",
        F.date_format("to_ts", "yyyy-MM-dd HH:mm:ss").alias("to_ts"),
    )
    extra = parsed.select(
        "defect_id", F.size(F.map_keys("metadata")).alias("n_names"), F.element_at(F.col("metadata")["Field"], 1).alias("audited")
    )
    return inc.join(extra, "defect_id")


@query(
    "defect_direct_fields",
    f"WITH {DEFECTS_SQL} SELECT defect_id, app_name AS Component, status AS Status, 'Fault in ' || app_name AS Headline FROM def",
)
def _(t):
    return records.defect_direct_fields(records_of(t), ["Component", "Status", "Headline"])


@query(
    "defect_audit_rows",
    f"WITH {DEFECTS_SQL} SELECT defect_id, 'a1' AS audit_id, 'Status' AS field, status AS new_value FROM def",
)
def _(t):
    rows = records.defect_audit_rows(records_of(t))
    return rows.select("defect_id", "audit_id", F.col("fields")["Field"].alias("field"), F.col("fields")["NewValue"].alias("new_value"))


@query(
    "defect_posts",
    f"""WITH {DEFECTS_SQL} SELECT defect_id AS post_id, 'Component ' || app_name || ' & status ' || status AS text,
    'note on ' || app_name AS comment, 1 AS n_comments FROM def""",
)
def _(t):
    posts = records.defect_posts(records_of(t))
    return posts.select("post_id", "text", F.col("comments")[0]["text"].alias("comment"), F.size("comments").alias("n_comments"))


def thread_files(t) -> str:
    """Files of many threads: a conversation's first turn opens a thread, the others reply."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    turns = relational.collect_groups(t.conversations.withColumn("text", flat), "conv_id", "turn", "text")
    reply = F.concat(F.lit("\n\nReply: user."), F.col("position") - 1, F.lit(" / Wed, 10/10/2001 - 09:58\n"), "text")
    said = turns.withColumn("text", F.when(F.col("position") == 0, F.concat("text", F.lit(" 7 votes"))).otherwise(reply))
    page = F.concat(
        F.format_string("==> %07d_html.txt <==\n", "conv_id"),
        F.lit("\nTitle:\nThread "), F.col("conv_id"), F.lit("\n\nURL:\nhttp://forum.example/"), F.col("conv_id"),
        F.lit("\n\nStatistics: Replies: "), F.col("n") - 1, F.lit("   Avg. Rating: "),
        F.when(F.col("conv_id") % 2 == 0, F.lit("4.5")).otherwise(F.lit("")),
        F.lit(" Views: "), F.col("conv_id") * 3, F.lit("   Votes: 2 Shares: 0\n\nDescription: opener / Aug 21st, 2001\n"), "text",
    )
    path = fresh_path(t.spark, "threads")
    relational.joined_groups(said, "conv_id", "text").select(page.alias("value")).write.text(path)
    return path


THREADS_SQL = r"""
turns AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
th AS (SELECT conv_id, lpad(conv_id::VARCHAR, 7, '0') AS post_id, max(text) FILTER (rn = 1) AS text,
              (count(*) - 1)::INTEGER AS nreplies,
              coalesce(string_agg(text, '|' ORDER BY turn) FILTER (rn > 1), '') AS replies FROM turns GROUP BY 1)"""


@query(
    "forum_posts",
    f"""WITH {THREADS_SQL} SELECT post_id, 'Thread ' || conv_id AS title, nreplies,
    CASE WHEN conv_id % 2 = 0 THEN 4.5::DOUBLE END AS rating, (conv_id * 3)::INTEGER AS views, 'opener' AS author,
    '2001-08-21' AS posted_at, text, replies,
    CASE WHEN nreplies > 0 THEN 'user.0 2001-10-10 09:58' END AS first_reply FROM th""",
)
def _(t):
    posts = threads.forum_posts(t.spark, thread_files(t), bundled=True)
    first = F.try_element_at("comments", F.lit(1))
    return posts.select(
        "post_id", "title", "nreplies", "rating", "views", "author", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"), "text",
        F.array_join(F.transform("comments", lambda c: c["text"]), "|").alias("replies"),
        F.concat_ws(" ", first["author"], F.date_format(first["date"], "yyyy-MM-dd HH:mm")).alias("first_reply"),
    ).withColumn("first_reply", F.when(F.col("first_reply") != "", F.col("first_reply")))


@query(
    "all_texts",
    f"""WITH {THREADS_SQL} SELECT lpad(conv_id::VARCHAR, 7, '0') AS post_id, (rn - 1)::INTEGER AS position, text FROM turns""",
)
def _(t):
    return relational.all_texts(threads.forum_posts(t.spark, thread_files(t), bundled=True))


@query(
    "forum_posts_positional",
    f"""WITH {THREADS_SQL} SELECT post_id, 'Thread ' || conv_id AS title, 'http://forum.example/' || conv_id AS url,
    text || ' 7 votes' AS text, replace(replies, '|', ' ') AS replies FROM th""",
)
def _(t):
    return threads.forum_posts_positional(t.spark, thread_files(t), bundled=True).drop("stats")


@query(
    "parse_post_header",
    """SELECT event_id, 'user.' || user_id AS author, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS day,
    strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events""",
)
def _(t):
    ts = F.col("ts").cast("timestamp")
    day = F.dayofmonth(ts)
    suffix = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    name = F.concat(F.lit("user."), F.col("user_id"))
    opening = F.concat(F.lit("Description: "), name, F.lit(" / "), F.date_format(ts, "MMM d"), suffix, F.date_format(ts, ", yyyy"))
    reply = F.concat(F.lit("Reply: "), name, F.lit(" / "), F.date_format(ts, "EEE, MM/dd/yyyy - HH:mm"))
    parsed = t.events.select("event_id", threads.parse_post_header(opening).alias("o"), threads.parse_post_header(reply).alias("r"))
    return parsed.select(
        "event_id", F.col("o.author").alias("author"), F.date_format("o.date", "yyyy-MM-dd HH:mm").alias("day"),
        F.date_format("r.date", "yyyy-MM-dd HH:mm").alias("minute"),
    )


@query(
    "parse_post_stats",
    """SELECT event_id, (user_id)::INTEGER AS nreplies, CASE WHEN event_id % 3 > 0 THEN value END AS rating,
    event_id::INTEGER AS views, 0 AS votes, 1 AS shares FROM events""",
)
def _(t):
    line = F.concat(
        F.lit("Statistics: Replies: "), F.col("user_id"), F.lit("   Avg. Rating: "),
        F.when(F.col("event_id") % 3 > 0, F.format_string("%.2f", "value")).otherwise(F.lit("")),
        F.lit(" Views: "), F.col("event_id"), F.lit("   Votes: 0 Shares: 1"),
    )
    return t.events.select("event_id", threads.parse_post_stats(line).alias("s")).select("event_id", "s.*")


CLEAN = r"trim(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "techzone_posts",
    f"SELECT doc_id::VARCHAR AS post_id, {CLEAN.format('text')} AS text FROM documents",
)
def _(t):
    tree = F.concat(
        F.when(F.col("doc_id") % 5 == 0, F.lit("stray line\n")).otherwise(F.lit("")),
        F.lit(PROLOG + '<techZone xmlns="cdetsng"><techZoneContent id="'), F.col("doc_id"), F.lit('"><content>'),
        escaped(F.col("text")), F.lit("</content></techZoneContent></techZone>"),
    )
    path = fresh_path(t.spark, "articles")
    t.documents.select(tree.alias("value")).write.text(path)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return articles.techzone_posts(t.spark, path).select("post_id", flat.alias("text"))


@query(
    "qa_dump_posts",
    r"""SELECT page_id::VARCHAR AS post_id, 'community' AS source,
      CASE WHEN page_id % 4 = 0 THEN '' ELSE '<' || regexp_extract(url, '//([^/]+)', 1) || '><page>' END AS tags,
      trim(regexp_replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text
    FROM pages""",
)
def _(t):
    tags = F.concat(F.lit("<"), F.regexp_extract("url", "//([^/]+)", 1), F.lit("><page>"))
    tag_part = F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit('" Tags="'), escaped(tags)))
    row = F.concat(F.lit('<row Id="'), F.col("page_id"), F.lit('" Body="'), escaped(F.col("html")), tag_part, F.lit('"/>'))
    path = fresh_path(t.spark, "qa")
    t.pages.select(row.alias("value")).write.text(path + "/community")
    posts = articles.qa_dump_posts(t.spark, path)
    return posts.select("post_id", "source", F.array_join("tags", "").alias("tags"), "text")


@query(
    "wiki_pages",
    f"""SELECT 'Page ' || doc_id AS title, {CLEAN.format('text')} AS text FROM documents
    WHERE lang IN ('en', 'fr') AND source <> 'src1' AND {CLEAN.format('text')} <> ''""",
)
def _(t):
    title = F.concat(F.lit("Page "), F.col("doc_id"), F.when(F.col("lang") == "de", F.lit(" (disambiguation)")).otherwise(F.lit("")))
    text = F.concat(F.when(F.col("source") == "src1", F.lit("#REDIRECT [[x]] ")).otherwise(F.lit("")), escaped(F.col("text")))
    page = F.concat(
        F.lit("<page>\n<title>"), title, F.lit("</title>\n<ns>"), F.when(F.col("lang") == "es", F.lit("4")).otherwise(F.lit("0")),
        F.lit('</ns>\n<revision>\n<id>1</id>\n<text xml:space="preserve">'), text, F.lit("</text>\n</revision>\n</page>"),
    )
    path = fresh_path(t.spark, "wiki")
    t.documents.select(page.alias("value")).write.text(path)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return articles.wiki_pages(t.spark, path).select("title", flat.alias("text"))


@query(
    "load_word_list",
    rf"""SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM benchmark""",
)
def _(t):
    words = t.benchmark.select(F.explode(tokenize(F.col("text"))).alias("value"))
    lines = words.unionByName(t.benchmark.select(F.concat(F.lit("; item "), F.col("item_id")).alias("value")))
    path = fresh_path(t.spark, "words")
    lines.write.text(path)
    return tables.load_word_list(t.spark, path)


@query(
    "write_nodes_edges",
    f"WITH {EDGES_SQL} SELECT src, dst, round(weight, 6) AS weight, round(avg_days, 6) AS avg_days FROM edges",
)
def _(t):
    path = fresh_path(t.spark, "edges")
    tables.write_nodes_edges(edges_of(t).select("src", "dst", "weight", "avg_days"), path)
    read = tables.read_nodes_edges(t.spark, path)
    return read.select("src", "dst", F.round("weight", 6).alias("weight"), F.round("avg_days", 6).alias("avg_days"))


@query("write_tables", "SELECT lang, doc_id, source, n_chars FROM documents")
def _(t):
    path = fresh_path(t.spark, "export")
    tables.write_tables(t.documents.select("doc_id", "source", "n_chars", "lang"), path, "csv", "lang")
    schema = "doc_id LONG, source STRING, n_chars LONG, lang STRING"
    return t.spark.read.schema(schema).option("header", "true").csv(path).select("lang", "doc_id", "source", "n_chars")


@query("save_embedding", "SELECT vec_id::VARCHAR AS word, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _(t):
    path = fresh_path(t.spark, "embedding")
    vectors = t.embeddings.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    tables.save_embedding(vectors, path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return tables.load_embedding(t.spark, path).select("word", F.round(total, 6).alias("total"))


@query(
    "read_nodes_edges",
    f"WITH RECURSIVE {RANK_SQL}{STATS_SQL} SELECT app_id, app_name, round(avg_severity, 6) AS avg_severity, incidents::INTEGER AS incidents, "
    "round(rank / (SELECT max(rank) FROM ranks), 6) AS risk FROM stats JOIN ranks ON id = app_id",
)
def _(t):
    path = fresh_path(t.spark, "nodes")
    nodes = plan.rank_components(incidents(t.events), edges_of(t))
    tables.write_nodes_edges(nodes, path, ",", header=True)
    read = tables.read_nodes_edges(t.spark, path, tables.NODE_SCHEMA, ",", header=True)
    return read.withColumn("risk", F.round("risk", 6)).withColumn("avg_severity", F.round("avg_severity", 6))


@query("load_embedding", "SELECT vec_id::VARCHAR AS word, len(embedding)::INTEGER AS n FROM embeddings")
def _(t):
    path = fresh_path(t.spark, "embedding")
    tables.save_embedding(
        t.embeddings.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("vector")), path
    )
    return tables.load_embedding(t.spark, path).select("word", F.size("vector").alias("n"))
