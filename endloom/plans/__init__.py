"""Registered queries of the analytic operators: name -> (function, SQL or None)."""

from __future__ import annotations


def all_queries() -> dict:
    from . import evidence_queries, gene_queries, position_queries, sequence_queries

    return {**position_queries.QUERIES, **gene_queries.QUERIES, **sequence_queries.QUERIES, **evidence_queries.QUERIES}
