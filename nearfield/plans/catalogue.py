"""Everything registered by the plan modules."""

from nearfield.plans import approximate, evaluation, neighbours, preparation, runs  # noqa: F401
from nearfield.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
