"""All registered queries: importing the operators' registrations fills the registry."""

from shelfspark.operators import registered, registered_facts, registered_primitives, registered_quality, registered_tables  # noqa: F401
from shelfspark.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
