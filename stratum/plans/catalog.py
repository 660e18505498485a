"""All registered queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.plans import corpus, extras, files, graphs, ingest, knowledge, outlines, retrieval, search, streams, upkeep, web

_GROUPS = (retrieval, search, corpus, knowledge, ingest, extras, files, upkeep, graphs, web, streams, outlines)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for g in _GROUPS for k, f in g.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for g in _GROUPS for k, s in g.ORACLES.items()}
