"""Registry of queries and of the SQL that states the same result."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_settings, shared_folder
from ..sources.readers import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_settings(spark)
            return f(Tables(spark, folder))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return f

    return add


def scratch(t: Tables, name: str) -> str:
    """Folder for a written table, below the shared folder and private to the application."""
    return f"{shared_folder(t.spark)}/paneloom-{t.spark.sparkContext.applicationId}/{name}"
