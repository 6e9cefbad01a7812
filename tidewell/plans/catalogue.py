"""All queries of the library; importing a module of plans registers its queries."""

from tidewell.plans import aggregates, evidence, jobs, models, more, related, schedules, transforms  # noqa: F401
from tidewell.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
