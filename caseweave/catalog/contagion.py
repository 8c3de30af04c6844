"""Queries over incidents and their component graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.adapters import INCIDENTS_SQL, incidents
from caseweave.catalog.registry import query
from caseweave.operators import graph, intervals, ordering
from caseweave.plans import contagion as plan
from caseweave.session import spread, stage

PAIRS_SQL = INCIDENTS_SQL + """,
spans AS (
  SELECT *, CAST(floor(epoch_us(from_ts) / 86400000000.0) AS BIGINT) - 1 AS d0,
         CAST(floor(epoch_us(from_ts) / 86400000000.0) AS BIGINT) - 2
           + CAST(ceil((epoch_us(to_ts) - epoch_us(from_ts)) / 86400000000.0 + 2) AS BIGINT) AS d1
  FROM inc
),
pairs AS (
  SELECT p.incident_id AS parent, c.incident_id AS child, p.app_id AS src, c.app_id AS dst,
         (epoch_us(c.from_ts) - epoch_us(p.from_ts)) / 86400000000.0 AS elapsed
  FROM spans p JOIN spans c ON p.from_ts <= c.from_ts AND c.d0 <= p.d1 AND p.d0 <= c.d1
   AND p.incident_id <> c.incident_id
)"""

EDGES_SQL = PAIRS_SQL + """,
valid_pairs AS (
  SELECT x.* FROM pairs x JOIN inc p ON p.incident_id = x.parent JOIN inc c ON c.incident_id = x.child
  WHERE p.app_id > 0 AND c.app_id > 0
    AND epoch_us(p.to_ts) - epoch_us(p.from_ts) <= 15 * 86400000000
    AND epoch_us(c.to_ts) - epoch_us(c.from_ts) <= 15 * 86400000000
),
raw_edges AS (SELECT src, dst, count(*) AS pairs, avg(elapsed) AS avg_days FROM valid_pairs GROUP BY 1, 2),
edges AS (
  SELECT src, dst, pairs, avg_days, pairs / (SELECT max(pairs) FROM raw_edges)::DOUBLE AS weight FROM raw_edges
)"""

STRONG_SQL = EDGES_SQL + """,
ordered AS (SELECT weight, row_number() OVER (ORDER BY weight) AS rn, count(*) OVER () AS n FROM edges),
strong AS (
  SELECT * FROM edges
  WHERE weight > (SELECT coalesce(max(weight), -1) FROM ordered WHERE rn = floor(0.5 * n))
)"""


def rank_sql(links: str, share: str) -> str:
    """CTEs of the settled rank over the CTE ``links`` with the weight expression ``share``: (id, rank) in ``ranks``."""
    return f"""
share AS MATERIALIZED (SELECT src, dst, {share} AS w FROM {links}),
r AS (
  SELECT id, 0.15::DOUBLE AS rank, 0.15::DOUBLE AS delta, true AS got, 0 AS i FROM (SELECT src AS id FROM {links} UNION SELECT dst FROM {links})
  UNION ALL
  SELECT r.id, r.rank + coalesce(m.more, 0), coalesce(m.more, 0), m.more IS NOT NULL, r.i + 1
  FROM r LEFT JOIN (
    SELECT w.dst, 0.85::DOUBLE * sum(u.delta * w.w) AS more FROM r u JOIN share w ON w.src = u.id WHERE u.got AND u.delta > 0.001 GROUP BY 1
  ) m ON m.dst = r.id
  WHERE EXISTS (SELECT 1 FROM r x WHERE x.got AND x.delta > 0.001)),
ranks AS (SELECT id, rank FROM r WHERE i = (SELECT max(i) FROM r))"""


SHARE = "1.0::DOUBLE / count(*) OVER (PARTITION BY src)"
RANK_SQL = STRONG_SQL + "," + rank_sql("strong", SHARE)

STATS_SQL = """,
stats AS (
  SELECT app_id, app_name, avg(severity)::DOUBLE AS avg_severity, count(*) AS incidents FROM inc GROUP BY 1, 2
)"""

LAYOUT_SQL = RANK_SQL + STATS_SQL + """,
layout AS (
  SELECT row_number() OVER (ORDER BY app_id, member) - 1 AS "index", app_id, app_name, member,
         CAST(trunc(avg_severity) AS INTEGER) AS severity, rank AS contagion
  FROM stats JOIN ranks ON id = app_id CROSS JOIN (SELECT unnest([0, 1]) AS member)
)"""

LINKS_SQL = LAYOUT_SQL + """,
links AS (
  SELECT s."index" AS source, t."index" AS target, avg_days AS weight
  FROM edges e JOIN layout s ON s.app_id = e.src AND s.member = 1 JOIN layout t ON t.app_id = e.dst AND t.member = 0
  WHERE e.weight > 0.01 ORDER BY e.weight DESC, source, target LIMIT 1000
)"""


def edges_of(t):
    return plan.build_contagion_graph(incidents(t.events))


def ranks_of(edges):
    return plan.rank_strong_edges(edges)


def layout_of(t):
    edges = stage(edges_of(t))
    inc = incidents(t.events)
    nodes = graph.join_nodes_rank(graph.app_node_stats(inc), ranks_of(edges))
    layout = stage(graph.bipartite_layout_nodes(nodes))
    return edges, layout


@query(
    "build_contagion_graph",
    f"WITH {EDGES_SQL} SELECT src, dst, pairs, round(avg_days, 6) AS avg_days, round(weight, 6) AS weight FROM edges",
)
def _(t):
    return edges_of(t).select(
        "src", "dst", "pairs", F.round("avg_days", 6).alias("avg_days"), F.round("weight", 6).alias("weight")
    )


@query(
    "pair_incidents_by_overlap",
    f"""WITH {PAIRS_SQL},
    up AS (SELECT child AS incident_id, count(*) AS n_parents, sum(elapsed) AS parent_days FROM pairs GROUP BY 1),
    down AS (SELECT parent AS incident_id, count(*) AS n_children FROM pairs GROUP BY 1)
    SELECT incident_id, coalesce(n_parents, 0) AS n_parents, coalesce(n_children, 0) AS n_children,
           round(coalesce(parent_days, 0), 6) AS parent_days
    FROM up FULL JOIN down USING (incident_id)""",
)
def _(t):
    degrees = intervals.overlap_degrees(incidents(spread(t.events)))  # a small file holds very many pairs
    return degrees.withColumn("parent_days", F.round("parent_days", 6))


@query(
    "pairs_of_probes",
    f"""WITH {PAIRS_SQL} SELECT parent, child, p.app_name AS parent_name, c.app_name AS child_name, p.severity AS parent_severity,
    c.severity AS child_severity, round(elapsed, 6) AS elapsed_days
    FROM pairs JOIN inc p ON p.incident_id = parent JOIN inc c ON c.incident_id = child WHERE child % 100 = 0""",
)
def _(t):
    """The pairs of every hundredth incident with the rows of both ends."""
    inc = incidents(spread(t.events))  # a small file holds very many pairs
    ends = inc.select("incident_id", F.col("app_name").alias("name"), "severity")
    rows = inc.select("incident_id", "app_id", "from_ts", "to_ts").join(ends, "incident_id")  # before they are pairs, which are not shuffled
    pairs = intervals.pair_incidents_by_overlap(rows.where("incident_id % 100 = 0"), rows, carried=["name", "severity"])
    return pairs.select(
        "parent", "child", "parent_name", "child_name", "parent_severity", "child_severity", F.round("elapsed_days", 6).alias("elapsed_days")
    )


@query(
    "edge_endpoints",
    f"""WITH {PAIRS_SQL} SELECT p.severity AS parent_severity, c.severity AS child_severity, count(*) AS pairs,
    round(avg(elapsed), 6) AS avg_days
    FROM pairs JOIN inc p ON p.incident_id = parent JOIN inc c ON c.incident_id = child GROUP BY 1, 2""",
)
def _(t):
    totals = intervals.pair_totals(incidents(t.events), "severity")
    return totals.select(
        F.col("src").alias("parent_severity"), F.col("dst").alias("child_severity"), "pairs",
        F.round(F.col("elapsed") / F.col("pairs"), 6).alias("avg_days"),
    )


@query(
    "app_edge_stats",
    f"""WITH {PAIRS_SQL} SELECT src, dst, count(*) AS pairs, CAST(trunc(round(avg(elapsed), 9)) AS DOUBLE) AS avg_days
    FROM pairs GROUP BY 1, 2""",
)
def _(t):
    return intervals.app_edge_stats(incidents(t.events), integer_days=True)


@query(
    "normalize_edge_weight",
    f"""WITH {PAIRS_SQL} SELECT src, dst, round(count(*) / (SELECT count(*) FROM pairs)::DOUBLE, 9) AS weight
    FROM pairs GROUP BY 1, 2""",
)
def _(t):
    edges = intervals.normalize_edge_weight(intervals.app_edge_stats(incidents(t.events)), "total")
    return edges.select("src", "dst", F.round("weight", 9).alias("weight"))


@query(
    "app_node_stats",
    f"WITH {INCIDENTS_SQL}{STATS_SQL} SELECT app_id, app_name, round(avg_severity, 6) AS avg_severity, incidents FROM stats",
)
def _(t):
    return graph.app_node_stats(incidents(t.events)).withColumn("avg_severity", F.round("avg_severity", 6))


@query("prune_weak_edges", f"WITH {STRONG_SQL} SELECT src, dst, pairs FROM strong")
def _(t):
    return ordering.prune_weak_edges(stage(edges_of(t))).select("src", "dst", "pairs")


@query("page_rank", f"WITH RECURSIVE {RANK_SQL} SELECT id, round(rank, 6) AS rank FROM ranks")
def _(t):
    return ranks_of(edges_of(t)).withColumn("rank", F.round("rank", 6))


@query(
    "weighted_page_rank",
    f"""WITH RECURSIVE {EDGES_SQL}, shares AS (
      SELECT src, dst, pairs / (SELECT sum(pairs) FROM raw_edges)::DOUBLE AS weight FROM raw_edges),
    {rank_sql("shares", "weight")} SELECT id, round(rank, 6) AS rank FROM ranks""",
)
def _(t):
    edges = plan.build_contagion_graph(incidents(t.events), weight="total")
    return graph.weighted_page_rank(edges).withColumn("rank", F.round("rank", 6))


@query(
    "join_nodes_rank",
    f"""WITH RECURSIVE {RANK_SQL}{STATS_SQL} SELECT app_id, app_name, round(avg_severity, 6) AS avg_severity, incidents,
    round(rank, 6) AS rank FROM stats JOIN ranks ON id = app_id""",
)
def _(t):
    joined = graph.join_nodes_rank(graph.app_node_stats(incidents(t.events)), ranks_of(edges_of(t)))
    return joined.withColumn("rank", F.round("rank", 6)).withColumn("avg_severity", F.round("avg_severity", 6))


@query(
    "risk_nodes",
    f"""WITH RECURSIVE {RANK_SQL}{STATS_SQL} SELECT app_id, app_name, round(avg_severity, 6) AS avg_severity, incidents,
    round(rank / (SELECT max(rank) FROM ranks), 6) AS risk FROM stats JOIN ranks ON id = app_id""",
)
def _(t):
    inc = incidents(t.events)
    nodes = plan.rank_components(inc, edges_of(t))
    return nodes.withColumn("risk", F.round("risk", 6)).withColumn("avg_severity", F.round("avg_severity", 6))


@query(
    "bipartite_layout_nodes",
    f'WITH RECURSIVE {LAYOUT_SQL} SELECT "index", app_id, app_name, member, severity, round(contagion, 6) AS contagion FROM layout',
)
def _(t):
    return layout_of(t)[1].withColumn("contagion", F.round("contagion", 6))


@query(
    "bipartite_layout_edges",
    f"WITH RECURSIVE {LINKS_SQL} SELECT source, target, round(weight, 6) AS weight FROM links",
)
def _(t):
    return graph.bipartite_layout_edges(*layout_of(t)).withColumn("weight", F.round("weight", 6))


@query(
    "edge_severity_class",
    f"""WITH RECURSIVE {LINKS_SQL} SELECT source, target,
    CASE WHEN s.severity = t.severity THEN s.severity::VARCHAR ELSE 'others' END AS "class"
    FROM links JOIN layout s ON s."index" = source JOIN layout t ON t."index" = target""",
)
def _(t):
    edges, layout = layout_of(t)
    return graph.edge_severity_class(graph.bipartite_layout_edges(edges, layout), layout)


@query(
    "neighbor_counts",
    f"""WITH RECURSIVE {LINKS_SQL}, e AS (
      SELECT source AS a, target AS b FROM links UNION ALL SELECT target, source FROM links)
    SELECT n."index", count(*) FILTER (m.member > n.member) AS higher, count(*) FILTER (m.member < n.member) AS lower
    FROM layout n LEFT JOIN e ON e.a = n."index" LEFT JOIN layout m ON m."index" = e.b GROUP BY 1""",
)
def _(t):
    edges, layout = layout_of(t)
    return graph.neighbor_counts(graph.bipartite_layout_edges(edges, layout), layout)


@query(
    "layout_index",
    f"""WITH RECURSIVE {LAYOUT_SQL}, p AS (
      SELECT "index", member, row_number() OVER (PARTITION BY member ORDER BY severity, contagion_r DESC, "index") - 1
        + 2 * (dense_rank() OVER (PARTITION BY member ORDER BY severity) - 1) AS plot_index
      FROM (SELECT *, round(contagion, 6) AS contagion_r FROM layout))
    SELECT *, max(plot_index) OVER (PARTITION BY member) AS group_max FROM p""",
)
def _(t):
    layout = layout_of(t)[1].withColumn("contagion", F.round("contagion", 6))
    return graph.layout_index(layout)


SPREAD_SQL = """
s AS (
  SELECT id, CASE WHEN f THEN 0.0::DOUBLE END AS time, CASE WHEN f THEN 0 END AS round, 0 AS i FROM (
    SELECT DISTINCT app_id AS id, ('0x' || substr(md5('11:' || app_id), 1, 8))::BIGINT < 429496729 AS f FROM inc)
  UNION ALL
  SELECT s.id, coalesce(s.time, m.reached), CASE WHEN s.time IS NOT NULL THEN s.round WHEN m.reached IS NOT NULL THEN s.i + 1 END, s.i + 1
  FROM s LEFT JOIN (
    SELECT e.dst, min(u.time + e.avg_days) AS reached FROM s u JOIN edges e ON e.src = u.id
    WHERE u.round = u.i AND u.time + 0.25 <= e.avg_days GROUP BY 1
  ) m ON m.dst = s.id
  WHERE EXISTS (SELECT 1 FROM s x WHERE x.round = x.i))"""


@query(
    "spread_from_failed",
    f"WITH RECURSIVE {EDGES_SQL}, {SPREAD_SQL} SELECT id, round(time, 6) AS time, round FROM s WHERE i = (SELECT max(i) FROM s)",
)
def _(t):
    nodes = incidents(t.events).select(F.col("app_id").alias("id")).distinct()
    nodes = nodes.withColumn("failed", graph.seed_share(F.col("id"), 0.1))
    spread = graph.spread_from_failed(nodes, edges_of(t), lag_days=0.25)
    return spread.withColumn("time", F.round("time", 6))
