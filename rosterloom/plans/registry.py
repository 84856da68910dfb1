"""All registered reconciliation queries and their SQL oracles."""

from rosterloom.plans import graph_queries, period_queries, queries, roster_queries, run_queries

FLAGSHIP = "roster_findings"
QUERIES: dict = {**queries.QUERIES, **graph_queries.QUERIES, **roster_queries.QUERIES, **period_queries.QUERIES, **run_queries.QUERIES}
ORACLES: dict = {**queries.ORACLES, **graph_queries.ORACLES, **roster_queries.ORACLES, **period_queries.ORACLES, **run_queries.ORACLES}
