"""All registered queries."""

from corpusflow.plans import queries_text  # noqa: F401
from corpusflow.plans import queries_corpus  # noqa: F401
from corpusflow.plans import queries_records  # noqa: F401
from corpusflow.plans import queries_calls  # noqa: F401
from corpusflow.plans import queries_streams  # noqa: F401  (reuses batch oracles, so it comes last)
from corpusflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
