"""Registered queries of the loan engine and the SQL that must give the same rows."""

from tranchery.plans import layer_queries, layout_queries, metric_queries, quality_queries, scalar_queries, stream_queries  # noqa: F401
from tranchery.plans.catalog import QUERIES, SQL  # noqa: F401
