"""All registered queries; importing this module fills the registry."""

from clearwright.plans import binaries, decisions, documents, evidence, metrics, quality, scalars  # noqa: F401
from clearwright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
