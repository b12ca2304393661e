"""All registered queries."""
from scholarsieve.plans import (  # noqa: F401
    queries_collection, queries_feedback, queries_fulltext, queries_grounding, queries_ranking,
    queries_render, queries_screening, queries_state,
)
from scholarsieve.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
