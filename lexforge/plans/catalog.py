"""All queries of the core, with the SQL of those that SQL can express."""

from . import clinical_queries, retrieval_queries, source_queries, text_queries, training

_MODULES = (training, text_queries, clinical_queries, retrieval_queries, source_queries)
FLAGSHIP = "p1_found"
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
