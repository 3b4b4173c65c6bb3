"""The same results in plain SQL: literal joins, windows and unions over the test tables."""

from oracles.queries import all_oracles

__all__ = ["all_oracles"]
