"""Registered queries; importing this package fills the registry."""

from facetloom.plans import (  # noqa: F401
    catalog_queries,
    dataset_queries,
    facet_queries,
    ranking_queries,
    session_queries,
)
from facetloom.plans.registry import ORACLES, QUERIES

flagship = QUERIES["session_target_rank"]

__all__ = ["ORACLES", "QUERIES", "flagship"]
