"""All registered queries."""

from silolens.plans import federation, insight, modeling, prepare  # noqa: F401
from silolens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
