"""All registered queries over the given tables, with their SQL."""

from __future__ import annotations

from gamelode.plans import data_queries, io_queries, label_queries, retrieval_queries, search_queries, text_queries

MODULES = (text_queries, search_queries, data_queries, label_queries, retrieval_queries, io_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.R.run.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.R.sql.items()}
