"""All registered queries. Importing a module registers what it defines."""

from factloom.plans import claim_queries, document_queries, facts_queries, index_queries, retrieval_queries  # noqa: F401
from factloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
