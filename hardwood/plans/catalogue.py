"""Every registered query of the engine."""

from . import availability_queries, context_queries, desk_queries, frame_queries, ingest_queries, metric_queries, model_queries, monitor_queries, pricing_queries, quote_queries, serving_queries, source_queries, trading_queries, window_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
