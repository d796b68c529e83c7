"""Imports every module of queries, so that the registry is complete."""

from cohortine.plans import (  # noqa: F401
    checked,
    evaluated,
    grouped,
    joined,
    records,
    reporting,
    rows,
    sourced,
)
from cohortine.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
