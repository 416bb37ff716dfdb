"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cloakwork.llm import alignment, exact_dedup, lm_scoring, mixing, near_dedup, packing, periodic_runs, pii, secrets, sharding, topk_search, toxicity, url_filter

_MODULES = (packing, lm_scoring, mixing, near_dedup, secrets, sharding, toxicity, url_filter, exact_dedup, topk_search, periodic_runs, pii, alignment)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
