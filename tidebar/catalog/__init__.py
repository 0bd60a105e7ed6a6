"""Registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from tidebar.catalog.registry import ORACLE, QUERIES  # noqa: F401
from tidebar.catalog import bars, features, labels, trading, audits, models, checks  # noqa: F401,E402
