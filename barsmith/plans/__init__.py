"""Registered queries and the SQL that states their results."""

from barsmith.plans import queries  # noqa: F401
from barsmith.plans.registry import QUERIES, SQL  # noqa: F401
