"""Queries of projections, counts, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.adapters import DEFECTS_SQL, INCIDENTS_SQL, defects, incidents, posts
from caseweave.catalog.registry import query
from caseweave.operators import intervals, ordering, relational
from caseweave.session import fresh_path, spread, stage
from caseweave.sources import merged, tables

STAMP_OUT = "yyyy-MM-dd HH:mm:ss"


def stamp(c):
    return F.date_format(c, STAMP_OUT)


def defect_incidents(t):
    return relational.defect_to_incident(defects(spread(t.events)))


@query(
    "defect_to_incident",
    f"""WITH {DEFECTS_SQL} SELECT defect_id AS incident_id, app_name,
    strftime(created, '%Y-%m-%d %H:%M:%S') AS from_ts, strftime(closed, '%Y-%m-%d %H:%M:%S') AS to_ts, severity,
    CASE WHEN k % 4 = k % 3 THEN 'v' || (k % 4)
         ELSE 'v' || least(k % 4, k % 3) || ',v' || greatest(k % 4, k % 3) END AS versions,
    'r' || (k % 5) AS releases FROM def""",
)
def _(t):
    return defect_incidents(t).select(
        "incident_id", "app_name", stamp("from_ts").alias("from_ts"), stamp("to_ts").alias("to_ts"), "severity",
        F.array_join("versions", ",").alias("versions"), F.array_join("releases", ",").alias("releases"),
    )


@query(
    "parse_ts_or_null",
    """SELECT event_id, CASE WHEN k % 11 <> 0 THEN
      strftime(date_trunc('second', ts) + to_days(k % 30), '%Y-%m-%d %H:%M:%S') END AS updated
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
)
def _(t):
    text = F.element_at(F.element_at("metadata", F.lit("Sys-Last-Updated")), 1)
    return defects(t.events).select(
        F.substring("defect_id", 2, 20).cast("long").alias("event_id"), stamp(relational.parse_ts_or_null(text)).alias("updated")
    )


@query(
    "valid_incidents",
    f"""WITH {DEFECTS_SQL}, ids AS (SELECT app_name, dense_rank() OVER (ORDER BY app_name) AS app_id
      FROM (SELECT DISTINCT app_name FROM def))
    SELECT defect_id AS incident_id, app_id FROM def JOIN ids USING (app_name) WHERE closed IS NOT NULL""",
)
def _(t):
    inc = defect_incidents(t)
    ids = ordering.assign_dense_ids(inc, "app_name", "app_id")
    return intervals.valid_incidents(relational.map_ids(inc, ids, "app_name")).select("incident_id", "app_id")


@query(
    "filter_status_any",
    f"WITH {DEFECTS_SQL} SELECT defect_id AS incident_id, status FROM def WHERE status IN ('C', 'D', 'R', 'U')",
)
def _(t):
    kept = relational.filter_status_any(defect_incidents(t))
    return kept.select("incident_id", F.element_at("statuses", 1).alias("status"))


@query(
    "filter_duration",
    f"""WITH {DEFECTS_SQL} SELECT defect_id AS incident_id FROM def
    WHERE (epoch(closed) - epoch(created)) / 86400.0 <= 15""",
)
def _(t):
    return intervals.filter_duration(defect_incidents(t)).select("incident_id")


@query(
    "days_between_frac",
    f"""WITH {INCIDENTS_SQL} SELECT incident_id, round((epoch_us(to_ts) - epoch_us(from_ts)) / 86400000000.0, 6) AS days
    FROM inc""",
)
def _(t):
    days = intervals.days_between_frac(F.col("from_ts"), F.col("to_ts"))
    return incidents(t.events).select("incident_id", F.round(days, 6).alias("days"))


@query(
    "days_between_int",
    f"""WITH {DEFECTS_SQL} SELECT defect_id AS incident_id, CAST(trunc((epoch(closed) - epoch(created)) / 86400.0) AS INTEGER)
    AS days FROM def""",
)
def _(t):
    days = intervals.days_between_int(F.col("from_ts"), F.col("to_ts"))
    return defect_incidents(t).select("incident_id", days.alias("days"))


@query(
    "count_by_severity",
    f"WITH {DEFECTS_SQL} SELECT severity, count(*) AS n FROM def GROUP BY 1",
)
def _(t):
    return relational.count_by(defect_incidents(t), "severity")


@query(
    "count_by_severity_app",
    f"WITH {DEFECTS_SQL} SELECT severity, app_name, count(*) AS n FROM def GROUP BY 1, 2",
)
def _(t):
    return relational.count_by(defect_incidents(t), "severity", "app_name")


@query(
    "versions_per_app",
    f"""WITH {DEFECTS_SQL} SELECT app_name, CAST(sum(CASE WHEN k % 4 = k % 3 THEN 1 ELSE 2 END) AS BIGINT) AS n_versions
    FROM def GROUP BY 1""",
)
def _(t):
    return relational.versions_per_app(defect_incidents(t)).orderBy(F.desc("n_versions"), "app_name")


@query(
    "distinct_values",
    f"""WITH {DEFECTS_SQL} SELECT 'Component' AS name, count(DISTINCT app_name) AS n_values FROM def
    UNION ALL SELECT 'Status', count(DISTINCT status) FROM def
    UNION ALL SELECT 'Integrated-releases', count(DISTINCT k % 5) FROM def""",
)
def _(t):
    return relational.distinct_values(defects(t.events), ["Component", "Status", "Integrated-releases"])


@query(
    "histogram",
    f"""WITH {DEFECTS_SQL}, d AS (SELECT (epoch(closed) - epoch(created)) / 86400.0 AS days FROM def
      WHERE severity = 2 AND closed IS NOT NULL),
    e AS (SELECT min(days) AS lo, (max(days) - min(days)) / 50 AS w FROM d),
    c AS (SELECT least(floor((days - lo) / w), 49)::BIGINT AS bin, count(*) AS n FROM d, e GROUP BY 1)
    SELECT b.bin, round(lo + b.bin * w, 6) AS lower, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(50)) AS bin) b LEFT JOIN c USING (bin) CROSS JOIN e""",
)
def _(t):
    days = intervals.days_between_frac(F.col("from_ts"), F.col("to_ts"))
    resolved = defect_incidents(t).where("severity = 2").select(days.alias("days")).where("days IS NOT NULL")
    return relational.histogram(stage(resolved), "days", 50).withColumn("lower", F.round("lower", 6))


@query(
    "percentile_r6",
    """WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn FROM orders),
    p AS (SELECT unnest([25, 90]) AS pct), n AS (SELECT pct, pct / 100.0 * (count(*) + 1) AS r FROM o, p GROUP BY 1)
    SELECT pct::INTEGER AS pct, round(a.v + (r - floor(r)) * (b.v - a.v), 4) AS percentile
    FROM n JOIN o a ON a.rn = floor(r) JOIN o b ON b.rn = floor(r) + 1""",
)
def _(t):
    found = ordering.percentiles_r6(t.orders, "o_totalprice", [25, 90])
    return found.select(F.col("percent").alias("pct"), F.round("percentile", 4).alias("percentile"))


@query(
    "assign_dense_ids",
    "SELECT url, dense_rank() OVER (ORDER BY url) AS id FROM (SELECT DISTINCT url FROM pages WHERE url <> '')",
)
def _(t):
    return ordering.assign_dense_ids(t.pages, "url")


@query(
    "top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(t):
    return ordering.top_k(t.orders.select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.col("o_orderkey"))


@query(
    "top_k_per_group",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    WHERE rank <= 10""",
)
def _(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordering.top_k_per_group(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query(
    "map_ids_broadcast",
    """SELECT c_custkey, coalesce(r_name, 'unknown') AS r_name
    FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
      WHERE r_name <> 'ASIA') ON n_nationkey = c_nationkey""",
)
def _(t):
    ids = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).where("r_name <> 'ASIA'")
    ids = ids.select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    customers = t.customer.select("c_custkey", "c_nationkey")
    return relational.map_ids(customers, ids, "c_nationkey", F.lit("unknown")).select("c_custkey", "r_name")


@query(
    "user_clusters_left",
    """SELECT DISTINCT o_custkey AS "user", p_brand AS cluster
    FROM orders LEFT JOIN part ON p_partkey = o_orderkey""",
)
def _(t):
    user_docs = t.orders.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("doc_id"))
    return relational.user_clusters_left(
        user_docs, t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("cluster"))
    )


USERS = """u AS (SELECT DISTINCT o_custkey AS "user", l_partkey AS doc_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
a AS (SELECT p_partkey AS doc_id, p_brand AS cluster FROM part)"""


@query(
    "users_to_clusters",
    f"""WITH {USERS}, o AS (SELECT "user", cluster, count(*) AS own_docs FROM u JOIN a USING (doc_id) GROUP BY 1, 2),
    s AS (SELECT cluster, count(*) AS size FROM a GROUP BY 1)
    SELECT "user", cluster, own_docs, size - own_docs AS open_docs FROM o JOIN s USING (cluster)""",
)
def _(t):
    user_docs = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("doc_id")
    )
    return relational.users_to_clusters(
        user_docs, t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("cluster"))
    )


@query(
    "suggest_documents",
    f"""WITH {USERS}, o AS (SELECT DISTINCT "user", cluster FROM u JOIN a USING (doc_id)),
    r AS (SELECT "user", doc_id, row_number() OVER (PARTITION BY "user" ORDER BY doc_id)::INTEGER AS rank
      FROM o JOIN a USING (cluster) ANTI JOIN u USING ("user", doc_id))
    SELECT * FROM r WHERE rank <= 5""",
)
def _(t):
    user_docs = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("doc_id")
    )
    clusters = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("cluster"))
    return relational.suggest_for_all(user_docs, clusters, 5)


@query(
    "cluster_members",
    "SELECT source AS cluster, doc_id, count(*) OVER (PARTITION BY source) AS size FROM documents",
)
def _(t):
    from caseweave.operators.clusters import cluster_members

    return cluster_members(t.documents.select("doc_id", F.col("source").alias("cluster")))


@query(
    "attach_by_position",
    """SELECT doc_id, d.lang, coalesce(l.quality, -1) AS cluster FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(t):
    ids = t.labels.select("doc_id", F.col("quality").alias("cluster"))
    return relational.map_ids(t.documents.select("doc_id", "lang"), ids, "doc_id", F.lit(-1))


@query(
    "lookup_semi",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def _(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_semi")


@query(
    "anti_join",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query(
    "union_sources",
    """SELECT 'documents' AS corpus, doc_id AS id, length(text) AS n FROM documents
    UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark
    UNION ALL SELECT 'conversations', conv_id, length(text) FROM conversations""",
)
def _(t):
    return relational.union_sources(
        {
            "documents": t.documents.select(F.col("doc_id").alias("id"), "text"),
            "benchmark": t.benchmark.select(F.col("item_id").alias("id"), "text"),
            "conversations": t.conversations.select(F.col("conv_id").alias("id"), "text"),
        }
    ).select("corpus", "id", F.length("text").cast("long").alias("n"))


@query("distinct_rows", "SELECT DISTINCT lang, text FROM documents")
def _(t):
    return t.documents.select("lang", "text").dropDuplicates()


@query(
    "collect_groups",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS position, text FROM conversations""",
)
def _(t):
    return relational.collect_groups(t.conversations, "conv_id", "turn", "text")


@query(
    "tagged_texts",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN quality = 1 THEN 'good' END,
      CASE WHEN toxic = 1 THEN 'toxic' END, lang], lambda x: x IS NOT NULL))), ',') AS tags
    FROM documents JOIN labels USING (doc_id)""",
)
def _(t):
    kept = relational.tagged_texts(posts(t.documents, t.labels))
    return kept.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("filter_by_size", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000")
def _(t):
    return tables.filter_by_size(t.documents, F.col("n_chars"), 1000).select("doc_id", "n_chars")


@query(
    "sample_rows",
    "SELECT doc_id FROM documents WHERE ('0x' || substr(md5('11:' || doc_id), 1, 8))::BIGINT < 429496729",
)
def _(t):
    return tables.sample_rows(t.documents, 0.1, 11, "doc_id").select("doc_id")


@query(
    "upsert_by_id",
    """SELECT user_id, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t):
    return relational.upsert_by_id(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query(
    "merged_table",
    """SELECT user_id, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t):
    """The same rows from a stored table: events of odd ids first, the others merged into it."""
    kept = merged.MergedTable(t.spark, fresh_path(t.spark, "latest"), ["user_id"], ["ts", "event_id"], buckets=8)
    kept.create(t.events.where("event_id % 2 = 1"))
    kept.merge(t.events.where("event_id % 2 = 0"))
    return kept.read().select("user_id", "event_id", "value")
