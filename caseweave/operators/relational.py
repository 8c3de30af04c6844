"""Incident projections, counts, lookups and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.ordering import positions, top_k_per_group

STAMP = "MM/dd/yyyy HH:mm:ss"


def parse_ts_or_null(text: Column, pattern: str = STAMP) -> Column:
    """Timestamp of a date string, NULL where it does not parse."""
    return F.try_to_timestamp(F.trim(text), F.lit(pattern))


def _values(name: str) -> Column:
    return F.element_at("metadata", F.lit(name))


def _first(name: str) -> Column:
    return F.array_min(F.filter(_values(name), lambda v: F.length(F.trim(v)) > 0))


def defect_to_incident(
    defects: DataFrame, app_field: str = "Component", default_severity: int | None = None, app_ids: DataFrame | None = None
) -> DataFrame:
    """Defect attribute map → incident row.

    Closed is the first non-empty of Closed-on, Resolved-on and Sys-Last-Updated. ``app_ids``
    (app_name, app_id) adds the component id; unknown components get NULL.
    """
    closed = F.coalesce(_first("Closed-on"), _first("Resolved-on"), _first("Sys-Last-Updated"))
    numeric = F.filter(_values("Severity"), lambda v: v.rlike(r"^\d+$"))
    severity = F.array_min(F.transform(numeric, lambda v: v.try_cast("int")))
    if default_severity is not None:
        severity = F.coalesce(severity, F.lit(default_severity))
    out = defects.select(
        F.col("defect_id").alias("incident_id"),
        _first(app_field).alias("app_name"),
        parse_ts_or_null(_first("New-on")).alias("from_ts"),
        parse_ts_or_null(closed).alias("to_ts"),
        severity.alias("severity"),
        _values("Version").alias("versions"),
        _values("Integrated-releases").alias("releases"),
        _values("Status").alias("statuses"),
    )
    return out if app_ids is None else map_ids(out, app_ids, "app_name")


def map_ids(df: DataFrame, ids: DataFrame, key: str, default: Column | None = None, drop: bool = False) -> DataFrame:
    """Dictionary lookup as a join. Spark broadcasts the dictionary when its measured size allows it."""
    joined = df.join(ids, key, "inner" if drop else "left")
    if default is not None:
        new = [c for c in ids.columns if c != key]
        joined = joined.withColumns({c: F.coalesce(F.col(c), default) for c in new})
    return joined


def filter_status_any(df: DataFrame, statuses: Sequence[str] = ("C", "D", "R", "U"), column: str = "statuses") -> DataFrame:
    return df.where(F.arrays_overlap(column, F.array(*[F.lit(s) for s in statuses])))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def versions_per_app(incidents: DataFrame) -> DataFrame:
    """Number of (incident, distinct version) pairs per component."""
    return incidents.groupBy("app_name").agg(
        F.sum(F.size(F.array_distinct("versions"))).cast("long").alias("n_versions")
    )


def distinct_values(defects: DataFrame, names: Sequence[str]) -> DataFrame:
    """Number of distinct non-empty values of each attribute."""
    wanted = F.array(*[F.lit(n) for n in names])
    entries = defects.select(F.explode(F.map_entries("metadata")).alias("e")).where(F.array_contains(wanted, F.col("e.key")))
    values = entries.select(F.col("e.key").alias("name"), F.explode("e.value").alias("value"))
    return values.where("value <> ''").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_values"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins count 0."""
    ends = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    lo = ends["lo"]
    width = (ends["hi"] - lo) / bins
    bin_no = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)))
    counts = df.where(F.col(value).isNotNull()).groupBy(bin_no.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return (
        df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
        .select("bin", (lo + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def upsert_by_id(df: DataFrame, ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each id. It is a maximum, so map tasks already keep one row per id.

    Rows that tie in ``order`` are told apart by their other columns in turn, the largest value wins; maps have no order
    and take no part in it.
    """
    ranked = F.struct(*order, *[f.name for f in df.schema.fields if f.name not in order and "map<" not in f.dataType.simpleString()])
    last = F.max_by(F.struct(*df.columns), ranked)
    return df.groupBy(*ids).agg(last.alias("r")).select("r.*")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames under each other with a ``corpus`` column; missing columns are NULL."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("corpus", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def collect_groups(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Texts of each group in order: one row (group, position, text) per text, positions from 0.

    A group is never one array, so a thread may have any number of texts.
    """
    placed = positions(df.select(group, order, text), [group], [F.col(order), F.col(text)])
    return placed.select(group, (F.col("position") - 1).alias("position"), text)


def joined_groups(groups: DataFrame, group: str, text: str, chunk: int = 256) -> DataFrame:
    """(group, text, n): the texts of each group as one string; chunks of them are joined first."""

    def together(df, *keys):
        rows = F.array_sort(F.collect_list(F.struct("position", text)))
        return df.groupBy(*keys).agg(F.min("position").alias("position"), F.array_join(F.transform(rows, lambda r: r[text]), "").alias(text), F.sum("n").alias("n"))

    parts = together(groups.withColumn("n", F.lit(1)), group, F.floor(F.col("position") / chunk).alias("chunk"))
    return together(parts, group).select(group, text, "n")


def all_texts(posts: DataFrame, text: str = "text", comments: str = "comments") -> DataFrame:
    """Every opening text and every comment as one row."""
    texts = F.concat(F.array(F.col(text)), F.transform(comments, lambda c: c["text"]))
    return posts.select("post_id", F.posexplode(texts).alias("position", "text")).where(F.col("text").isNotNull())


def tagged_texts(posts: DataFrame, tags: str = "tags") -> DataFrame:
    return posts.where(F.size(tags) > 0)


def user_clusters_left(user_docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Distinct (user, cluster); users whose documents have no cluster keep a NULL."""
    return user_docs.join(assignment, "doc_id", "left").select("user", "cluster").distinct()


def users_to_clusters(user_docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per user and cluster: own documents there and how many of the cluster the user has not joined."""
    sizes = assignment.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    own = (
        user_docs.distinct().join(assignment, "doc_id").groupBy("user", "cluster").agg(F.count(F.lit(1)).alias("own_docs"))
    )
    return own.join(sizes, "cluster").select("user", "cluster", "own_docs", (F.col("size") - F.col("own_docs")).alias("open_docs"))


def suggest_for_all(user_docs: DataFrame, assignment: DataFrame, k: int) -> DataFrame:
    """(user, doc_id, rank): the first k documents by id of each user's clusters which the user has not joined yet.

    The k + own documents of lowest id of a cluster hold the k that are open, so each (user, cluster) takes no more of it,
    by their positions: a cluster has few keys and very many users, and must not be joined as a whole.
    """
    own = user_docs.select("user", "doc_id").distinct()
    read = own.join(assignment, "doc_id").groupBy("user", "cluster").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(assignment.select("cluster", "doc_id"), ["cluster"], [F.col("doc_id")])
    wanted = read.select("user", "cluster", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + k)).alias("position"))
    offered = placed.join(wanted, ["cluster", "position"]).select("user", "doc_id")
    return top_k_per_group(offered.join(own, ["user", "doc_id"], "left_anti"), ["user"], [F.col("doc_id")], k)


def suggest_documents(user: str, user_docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Documents of one user's clusters which the user has not joined yet."""
    own = user_docs.where(F.col("user") == user)
    clusters = own.join(assignment, "doc_id").select("cluster").distinct()
    return assignment.join(clusters, "cluster", "left_semi").join(own, "doc_id", "left_anti")
