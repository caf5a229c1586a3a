"""Registered queries and the SQL that says the same."""

from rillframe.plans import files, relational, sequences, timed, values  # noqa: F401
from rillframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
