"""Every query of the core by name, with its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.plans import code, graphs, quality, retrieval, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **graphs.QUERIES, **quality.QUERIES, **code.QUERIES, **structure.QUERIES}
SQL: dict[str, str] = {**retrieval.SQL, **graphs.SQL, **quality.SQL, **code.SQL, **structure.SQL}
