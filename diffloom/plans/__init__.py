"""Jobs composed from the operators, and the registered queries with their oracle SQL."""

from importlib import import_module

_MODULES = ["derive", "snapshot_queries", "line_queries", "history_queries", "patch_queries", "move_queries", "review_queries", "interdiff_queries", "forge_queries", "text_queries", "report_queries", "node_queries", "stream_queries"]


def all_queries():
    """Every registered query by name."""
    for module in _MODULES:
        import_module(f"diffloom.plans.{module}")
    from diffloom.plans.registry import QUERIES

    return dict(QUERIES)
