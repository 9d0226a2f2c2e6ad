"""All registered queries."""

from flowlens.plans import data_queries, rule_queries, run_queries, stream_queries, window_queries  # noqa: F401
from flowlens.plans.registry import ORACLES, QUERIES  # noqa: F401
