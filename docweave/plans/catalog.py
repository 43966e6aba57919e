"""All queries of the package but those of the llm subpackage."""

from docweave.plans import exchange, relational, retrieval, structure  # noqa: F401
from docweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
