"""Writers: Parquet, CSV, pieces, samples, a named-metric log."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.positions import key_hash, ordered_positions


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_named_texts(df: DataFrame, path: str, name: str, value: str, order: Sequence[str] = ()) -> None:
    """Write text files with names of their own: ``path/<name>`` holds the values of that name, line by line.

    ``name`` may have folders in it. One task writes a file, from rows sorted by ``order``. Spark's
    writer makes a folder for each name; its one file is then renamed through the
    file system of ``path``, a call for each file.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.parts"
    rows = df.repartition(name).sortWithinPartitions(name, *order).select(F.col(value).alias("value"), F.col(name).alias("_file"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("_file").text(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(hadoop.Path(f"{staged}/_file=*")):
        target = hadoop.Path(f"{path.rstrip('/')}/{unquote(folder.getPath().getName().removeprefix('_file='))}")
        fs.mkdirs(target.getParent())
        for file in fs.globStatus(hadoop.Path(folder.getPath(), "part-*")):
            if not fs.rename(file.getPath(), target):
                raise RuntimeError(f"{target} could not be written")


def piece_bounds(df: DataFrame, order: Sequence[str], n: int) -> list[tuple]:
    """Order keys of the first row of pieces 1..n-1, ``order`` being a unique key.

    Piece i holds the rows from ``i * len // n`` up to ``(i + 1) * len // n``. Only the
    key columns are ordered and checkpointed, and n - 1 keys come to the driver.
    """
    keys = ordered_positions(df.select(*order), order)
    total = df.count()
    starts = sorted({i * total // n for i in range(1, n)})
    rows = keys.where(F.col("position").isin(starts)).orderBy("position").collect()
    first = {r["position"]: tuple(r[c] for c in order) for r in rows}
    return [first[i * total // n] for i in range(1, n) if i * total // n in first]


def with_piece(df: DataFrame, order: Sequence[str], bounds: Sequence[tuple], out: str = "piece") -> DataFrame:
    """Piece number of each row by comparing its key with the bounds: no shuffle."""
    key = F.struct(*order)
    number = F.lit(0)
    for b in bounds:
        limit = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, b)])
        number = number + F.when(key >= limit, 1).otherwise(0)
    return df.withColumn(out, number)


def write_pieces(df: DataFrame, path: str, order: Sequence[str], n: int) -> int:
    """Write n contiguous pieces as ``piece=<i>`` folders; returns the checked row count."""
    pieces = with_piece(df, order, piece_bounds(df, order, n))
    pieces.write.mode("overwrite").partitionBy("piece").parquet(path)
    written, expected = df.sparkSession.read.parquet(path).count(), df.count()
    if written != expected:
        raise RuntimeError(f"pieces hold {written} rows, the table {expected}")
    return written


def stable_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """The n rows with the smallest key hash: a fixed-size sample that never changes."""
    return df.orderBy(key_hash(*keys, seed=seed), *keys).limit(n)


def slim(df: DataFrame, *heavy: str) -> DataFrame:
    """The table without its heavy columns."""
    return df.drop(*heavy)


def log_metric(spark: SparkSession, path: str, name: str, value, seq: int) -> None:
    """Append one named value to a log folder."""
    row = spark.createDataFrame([(name, str(value), seq)], "name string, value string, seq long")
    row.coalesce(1).write.mode("append").parquet(path)


def latest_metrics(log: DataFrame) -> DataFrame:
    """Value of the last write per name, and whether it replaced an earlier one."""
    return log.groupBy("name").agg(
        F.max_by("value", "seq").alias("value"), F.count("*").alias("writes")
    ).withColumn("command", F.when(F.col("writes") == 1, "newcommand").otherwise("renewcommand"))
