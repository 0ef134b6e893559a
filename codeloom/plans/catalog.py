"""All registered queries."""

from codeloom.plans import assist, corpus, curation, metrics, retrieval, segments, storage, streaming, tokens  # noqa: F401
from codeloom.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
