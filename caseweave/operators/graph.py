"""Ranking, spread and layout tables of the component graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caseweave.operators.ordering import positions
from caseweave.session import stage


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def weighted_page_rank(
    edges: DataFrame,
    weight: str = "weight",
    reset: float = 0.15,
    tol: float | None = 0.001,
    iterations: int | None = None,
    max_iter: int = 100,
) -> DataFrame:
    """Un-normalised rank r(v) = reset + (1-reset)·Σ w(u,v)·r(u), built up from passed-on increments.

    With ``iterations`` the increments are passed on so many times in full. Otherwise only increments
    above ``tol`` are passed on, until none is left; weights whose ranks do not converge end in an
    error after ``max_iter`` rounds. A round reads the rank table twice, so it is staged after each: one
    row per node is little next to the edges, and each round then joins the edges once.
    """
    damping = 1.0 - reset
    links = stage(edges.select("src", "dst", F.col(weight).alias("w")))
    ranks = _ends(links).select(
        "id", F.lit(reset).alias("rank"), F.lit(reset).alias("delta"), F.lit(True).alias("got")
    )
    rounds = iterations if iterations is not None else max_iter
    for _ in range(rounds):
        sending = ranks.where("got")
        if iterations is None:
            sending = sending.where(F.col("delta") > tol)
        inbox = (
            sending.join(links, sending["id"] == links["src"])
            .groupBy("dst")
            .agg((F.lit(damping) * F.sum(F.col("delta") * F.col("w"))).alias("more"))
        )
        ranks = ranks.join(inbox, ranks["id"] == inbox["dst"], "left").select(
            "id",
            (F.col("rank") + F.coalesce("more", F.lit(0.0))).alias("rank"),
            F.coalesce("more", F.lit(0.0)).alias("delta"),
            F.col("more").isNotNull().alias("got"),
        )
        seen = Observation()  # counted while the table is written
        ranks = stage(ranks.observe(seen, F.count_if(F.col("got") & (F.col("delta") > (0.0 if tol is None else tol))).alias("open")))
        if iterations is None and not seen.get["open"]:
            break
    else:
        if iterations is None:
            raise RuntimeError(f"ranks did not settle within {max_iter} rounds; normalise the weights")
    return ranks.select("id", "rank")


def page_rank(edges: DataFrame, **kwargs) -> DataFrame:
    """Rank with equal shares 1/out-degree; the edge weight is not used. Options as above."""
    degree = edges.groupBy("src").agg((F.lit(1.0) / F.count(F.lit(1))).alias("share"))
    return weighted_page_rank(edges.select("src", "dst").join(degree, "src"), "share", **kwargs)


def app_node_stats(incidents: DataFrame) -> DataFrame:
    """Per component: average severity and number of incidents."""
    return incidents.groupBy("app_id", "app_name").agg(
        F.avg("severity").alias("avg_severity"), F.count(F.lit(1)).alias("incidents")
    )


def join_nodes_rank(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Component statistics with their rank; components without a rank drop out."""
    return nodes.join(ranks.withColumnRenamed("id", "app_id"), "app_id")


def risk_nodes(incidents: DataFrame, ranks: DataFrame) -> DataFrame:
    """Components with risk = rank / largest rank."""
    largest = ranks.agg(F.max("rank")).scalar()
    return join_nodes_rank(app_node_stats(incidents), ranks).select(
        "app_id", "app_name", "avg_severity", "incidents", (F.col("rank") / largest).alias("risk")
    )


def bipartite_layout_nodes(ranked: DataFrame) -> DataFrame:
    """Each component as a parent (member 0) and a child (member 1), numbered from 0 by component."""
    both = ranked.select(
        "app_id", "app_name", F.col("avg_severity").cast("int").alias("severity"),
        F.col("rank").alias("contagion"), F.explode(F.array(F.lit(0), F.lit(1))).alias("member"),
    )
    return positions(both, [], [F.col("app_id"), F.col("member")], "index").withColumn("index", F.col("index") - 1)


def bipartite_layout_edges(edges: DataFrame, layout: DataFrame, min_weight: float = 0.01, k: int = 1000) -> DataFrame:
    """The k heaviest edges between layout nodes: source as child side, target as parent side."""
    source = layout.where("member = 1").select(F.col("app_id").alias("src"), F.col("index").alias("source"))
    target = layout.where("member = 0").select(F.col("app_id").alias("dst"), F.col("index").alias("target"))
    return (
        edges.where(F.col("weight") > min_weight)
        .join(source, "src")
        .join(target, "dst")
        .orderBy(F.desc("weight"), "source", "target")
        .limit(k)
        .select("source", "target", F.col("avg_days").alias("weight"))
    )


def _with_ends(links: DataFrame, layout: DataFrame, what: str) -> DataFrame:
    value = F.col(what)
    return links.join(layout.select(F.col("index").alias("source"), value.alias("source_value")), "source").join(
        layout.select(F.col("index").alias("target"), value.alias("target_value")), "target"
    )


def edge_severity_class(links: DataFrame, layout: DataFrame) -> DataFrame:
    """Edge class: the severity both ends share, else ``others``."""
    return _with_ends(links, layout, "severity").select(
        "source", "target",
        F.when(F.col("source_value") == F.col("target_value"), F.col("source_value").cast("string"))
        .otherwise(F.lit("others")).alias("class"),
    )


def neighbor_counts(links: DataFrame, layout: DataFrame) -> DataFrame:
    """Per layout node the neighbours with a higher and a lower member value."""
    ends = _with_ends(links, layout, "member").select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("index"), (F.col("target_value") - F.col("source_value")).alias("step")),
                F.struct(F.col("target").alias("index"), (F.col("source_value") - F.col("target_value")).alias("step")),
            )
        ).alias("e")
    )
    counts = ends.groupBy("e.index").agg(
        F.count_if(F.col("e.step") > 0).alias("higher"), F.count_if(F.col("e.step") < 0).alias("lower")
    )
    return layout.select("index").join(counts, "index", "left").fillna(0, ["higher", "lower"])


def layout_index(layout: DataFrame) -> DataFrame:
    """Plot position per member: severity ascending, contagion descending, a gap of 2 per severity."""
    placed = positions(layout, ["member"], [F.col("severity"), F.desc("contagion"), F.col("index")])
    steps = placed.groupBy("member", "severity").agg(F.count(F.lit(1)).alias("n"))
    # few rows: one per member and severity
    gaps = steps.alias("a").join(
        steps.alias("b"), (F.col("a.member") == F.col("b.member")) & (F.col("b.severity") < F.col("a.severity")), "left"
    ).groupBy("a.member", "a.severity").agg((F.count("b.severity") * 2).alias("gap"))
    size = placed.groupBy("member").agg(F.count(F.lit(1)).alias("n")).join(
        steps.groupBy("member").agg(F.count(F.lit(1)).alias("kinds")), "member"
    ).select("member", (F.col("n") - 1 + 2 * (F.col("kinds") - 1)).alias("group_max"))
    return (
        placed.join(gaps, ["member", "severity"])
        .join(size, "member")
        .select("index", "member", (F.col("position") - 1 + F.col("gap")).alias("plot_index"), "group_max")
    )


def seed_share(id_col: Column, share: float, seed: int = 11) -> Column:
    """True for a reproducible share of the ids, by hash."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 8), 16, 10).cast("long")
    return h < int(share * 2**32)


def spread_from_failed(
    nodes: DataFrame, edges: DataFrame, failed: str = "failed", lag_days: float = 10.0,
    rounds: int | None = None, max_rounds: int = 1000,
) -> DataFrame:
    """Round in which and time at which a failure reaches each node.

    u failed and v not yet, and time(u) + lag ≤ days(u,v): v fails at time(u) + days. The smallest time
    of a round counts and the first round wins. Without ``rounds`` it runs until nothing new fails.
    """
    links = stage(edges.select("src", "dst", F.col("avg_days").alias("days")))
    state = nodes.select(
        "id", F.when(F.col(failed), F.lit(0.0)).alias("time"), F.when(F.col(failed), F.lit(0)).alias("round")
    )
    for i in range(1, (rounds if rounds is not None else max_rounds) + 1):
        front = state.where(F.col("round") == i - 1)
        reach = (
            front.join(links, (front["id"] == links["src"]) & (front["time"] + lag_days <= links["days"]))
            .groupBy("dst")
            .agg(F.min(F.col("time") + F.col("days")).alias("reached"))
        )
        state = state.join(reach, state["id"] == reach["dst"], "left").select(
            "id", F.coalesce("time", "reached").alias("time"),
            F.when(F.col("time").isNotNull(), F.col("round")).when(F.col("reached").isNotNull(), F.lit(i)).alias("round"),
        )
        seen = Observation()
        state = stage(state.observe(seen, F.count_if(F.col("round") == i).alias("reached")))
        if rounds is None and not seen.get["reached"]:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"the spread did not end within {max_rounds} rounds")
    return state.select("id", "time", "round")
