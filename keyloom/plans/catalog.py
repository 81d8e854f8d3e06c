"""All queries of the reconciliation engine."""

from keyloom.plans import data_queries, ddl_queries, log_queries, meta_queries, repair_queries  # noqa: F401  they register their queries
from keyloom.plans.registry import ORACLE, QUERIES  # noqa: F401
