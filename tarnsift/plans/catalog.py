"""All registered queries over the given tables, and their SQL."""

from tarnsift.plans import data_queries, evaluation_queries, evidence_queries, protocol_queries, rollup_queries

_PARTS = (data_queries, evaluation_queries, rollup_queries, evidence_queries, protocol_queries)
QUERIES = {name: f for p in _PARTS for name, f in p.QUERIES.items()}
ORACLE_SQL = {name: sql for p in _PARTS for name, sql in p.ORACLE_SQL.items()}
