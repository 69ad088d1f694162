"""All registered queries and oracle statements."""

from orderweave.plans import document_queries, order_queries, table_queries

_MODULES = (order_queries, document_queries, table_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in _MODULES for name, q in m.ORACLE.items()}
