"""All registered queries.  Importing the query modules fills the registry."""

from __future__ import annotations

from ledger_spark.plans import (event_queries, ingest_queries, metric_queries, quality_queries, question_queries,
                                registry, text_queries)  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
