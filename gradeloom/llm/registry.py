"""The corpus queries: one ``opN_<name>`` for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from . import op_queries as q

QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op") and name[2:3].isdigit()}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return q.ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
