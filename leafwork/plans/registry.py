"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafwork.plans import documents, glyphs, layout, objects, rendering, scalars, streams, structure, writing

MODULES = [layout, rendering, scalars, writing, glyphs, documents, structure, objects, streams]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
