"""Imports every query module so that the registry is filled."""

from holdfast.plans import (  # noqa: F401
    attack_queries, design_queries, review_queries, score_queries, source_queries, stream_queries,
    text_queries,
)
from holdfast.plans.registry import ORACLES, QUERIES  # noqa: F401
