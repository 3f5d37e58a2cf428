"""What the operators share: reading, durable intermediate tables, registry."""

from __future__ import annotations

import textwrap
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_settings, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL if there is one.

    The skew and AQE settings are put on the caller's session, as the plans rely on them.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settle(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return f

    return add


def settle(spark: SparkSession) -> None:
    """Put the runtime settings of the library on ``spark``.

    Shuffle files go at the end of the job that wrote them; every later job here reads written tables.
    Whole texts go to tasks in batches of few rows, as a batch is bounded by rows only.
    """
    apply_settings(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has used, below the folder that all executors share."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: compressed, prunable, no lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
