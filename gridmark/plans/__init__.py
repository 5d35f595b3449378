"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from gridmark.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
