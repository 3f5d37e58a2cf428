"""Session builder and the two session-level helpers every job needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; safe to apply to a session somebody else built.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app: str = "paneloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Session with AQE and skew handling on.

    On a cluster leave ``master`` unset (spark-submit gives it) and leave
    ``shuffle_partitions`` unset too unless the job size is known: AQE merges
    small shuffle partitions but cannot split the ones that were planned too big.
    """
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Put ``SQL_CONF`` on a session that somebody else built."""
    for name, value in SQL_CONF.items():
        spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="paneloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    For tables that are read several times and for lookup tables made by a job: the optimiser knows
    the size of what was written, so it decides by measure whether to broadcast it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/paneloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
