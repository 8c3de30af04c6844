"""From incidents to the weighted component graph, its ranks and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseweave.operators import graph, intervals, ordering
from caseweave.session import stage


def build_contagion_graph(
    incidents: DataFrame, max_days: float | None = 15.0, weight: str = "max",
    integer_days: bool = False, break_ties: bool = False,
) -> DataFrame:
    """Valid incidents of limited duration → component edges with normalised weight."""
    kept = intervals.valid_incidents(incidents)
    if max_days is not None:
        kept = intervals.filter_duration(kept, max_days)
    return intervals.normalize_edge_weight(intervals.app_edge_stats(kept, integer_days, break_ties), weight)


def rank_components(incidents: DataFrame, edges: DataFrame, drop_share: float = 0.5, **kwargs) -> DataFrame:
    """Rank over the stronger edges and the risk table of the components."""
    return graph.risk_nodes(incidents, stage(rank_strong_edges(edges, drop_share, **kwargs)))


def rank_strong_edges(edges: DataFrame, drop_share: float = 0.5, **kwargs) -> DataFrame:
    """Rank over the stronger edges. The edges are staged: they are read for the cut and for the rounds."""
    return graph.page_rank(ordering.prune_weak_edges(stage(edges), "weight", drop_share), **kwargs)
