"""Query catalog: every operator of the inventory as (Spark query, DuckDB twin)."""

from panelkit.catalog.spec import REGISTRY, Query  # noqa: F401
from panelkit.catalog import q_score, q_window, q_features, q_profile, q_model, q_table, q_trees, q_stream, q_edges  # noqa: F401


def all_queries() -> dict:
    return dict(REGISTRY)
