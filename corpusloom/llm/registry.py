"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import queries_data, queries_models, queries_near, queries_prints, queries_tokens

MODULES = (queries_data, queries_tokens, queries_near, queries_prints, queries_models)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
