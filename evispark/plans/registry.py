"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from evispark.plans import chains, genes, graph, landed, more, operations, scoring, search, streams, texts

QUERIES = {**graph.QUERIES, **scoring.QUERIES, **texts.QUERIES, **operations.QUERIES, **more.QUERIES, **search.QUERIES, **streams.QUERIES, **chains.QUERIES, **genes.QUERIES, **landed.QUERIES}
ORACLE = {**graph.ORACLE, **scoring.ORACLE, **texts.ORACLE, **operations.ORACLE, **more.ORACLE, **search.ORACLE, **streams.ORACLE, **chains.ORACLE, **genes.ORACLE, **landed.ORACLE}
