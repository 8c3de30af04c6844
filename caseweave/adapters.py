"""Views of the generic test tables as incidents, defects, posts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


#: Components that incidents are dealt to; their number doesn't follow the data.
COMPONENTS = 1249


def incidents(events: DataFrame) -> DataFrame:
    """Events as incidents of a fixed number of components that stay open for zero to 23 hours."""
    ts = F.col("ts").cast("timestamp")
    app = F.col("user_id") % COMPONENTS + 1
    return events.select(
        F.col("event_id").alias("incident_id"),
        app.alias("app_id"),
        F.concat(F.lit("app-"), app.cast("string")).alias("app_name"),
        ts.alias("from_ts"),
        F.timestamp_micros(F.unix_micros(ts) + (_k() % 24).cast("long") * 3_600_000_000).alias("to_ts"),
        (_k() % 6 + 1).alias("severity"),
        F.array_distinct(
            F.array(
                F.concat(F.lit("v"), (_k() % 4).cast("string")),
                F.concat(F.lit("v"), (_k() % 3).cast("string")),
            )
        ).alias("versions"),
    )


INCIDENTS_SQL = f"""
inc AS (
  SELECT event_id AS incident_id, user_id % {COMPONENTS} + 1 AS app_id, 'app-' || (user_id % {COMPONENTS} + 1) AS app_name,
         ts AS from_ts, ts + to_hours(k % 24) AS to_ts, 1 + k % 6 AS severity, k
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""


def defects(events: DataFrame) -> DataFrame:
    """Every event as a defect record: an id and its attribute map with value lists."""
    ts = F.col("ts").cast("timestamp")
    stamp = "MM/dd/yyyy HH:mm:ss"

    def after(days):
        return F.date_format(F.timestamp_micros(F.unix_micros(ts) + days * 86_400_000_000), stamp)

    k = F.col("k")
    empty = F.lit("")
    fields = {
        "New-on": F.array(F.date_format(ts, stamp)),
        "Closed-on": F.array(F.when(k % 3 == 0, empty).otherwise(after((k % 20).cast("long")))),
        "Resolved-on": F.array(F.when(k % 5 == 0, empty).otherwise(after((k % 10).cast("long")))),
        "Sys-Last-Updated": F.array(F.when(k % 11 == 0, F.lit("not a date")).otherwise(after((k % 30).cast("long")))),
        "Component": F.array(F.concat(F.lit("app-"), F.col("user_id").cast("string"))),
        "Severity": F.when(k % 7 == 0, F.array(F.lit("none")))
        .when(k % 4 == 0, F.array((k % 6 + 1).cast("string"), F.lit("2")))
        .otherwise(F.array((k % 6 + 1).cast("string"))),
        "Status": F.array(F.substring(F.lit("CDRUNAO"), k % 7 + 1, F.lit(1))),
        "Version": F.array(
            F.concat(F.lit("v"), (k % 4).cast("string")), F.concat(F.lit("v"), (k % 3).cast("string"))
        ),
        "Integrated-releases": F.array(F.concat(F.lit("r"), (k % 5).cast("string"))),
    }
    entries = F.map_from_entries(
        F.array(*[F.struct(F.lit(name), F.array_sort(F.array_distinct(v))) for name, v in fields.items()])
    )
    return events.withColumn("k", _k()).select(
        F.format_string("D%08d", "event_id").alias("defect_id"), entries.alias("metadata")
    )


DEFECTS_SQL = """
def0 AS (
  SELECT 'D' || lpad(event_id::VARCHAR, 8, '0') AS defect_id, user_id, date_trunc('second', ts) AS ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
),
def AS (
  SELECT defect_id, k, ts AS created,
         CASE WHEN k % 3 <> 0 THEN ts + to_days(k % 20)
              WHEN k % 5 <> 0 THEN ts + to_days(k % 10)
              WHEN k % 11 <> 0 THEN ts + to_days(k % 30) END AS closed,
         'app-' || user_id AS app_name,
         CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN least(1 + k % 6, 2) ELSE 1 + k % 6 END AS severity,
         substr('CDRUNAO', k % 7 + 1, 1) AS status
  FROM def0
)"""


def posts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as posts; the labels and the language are their tags."""
    tag = F.filter(
        F.array(
            F.when(F.col("quality") == 1, F.lit("good")),
            F.when(F.col("toxic") == 1, F.lit("toxic")),
            F.when(F.col("quality").isNotNull(), F.col("lang")),
        ),
        lambda x: x.isNotNull(),
    )
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", "source", "lang", "text", F.array_sort(F.array_distinct(tag)).alias("tags")
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    """Embedding rows as (id, vector of doubles, label)."""
    return embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )
