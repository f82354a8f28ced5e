"""All registered queries."""

from textloom.plans import (  # noqa: F401
    eval_queries, metric_queries, output_queries, pipeline_queries, prep_queries, quote_queries, retrieval_queries, source_queries,
)
from textloom.plans.registry import ORACLES, QUERIES  # noqa: F401
