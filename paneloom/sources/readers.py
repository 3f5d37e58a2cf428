"""Readers: delimited files, Parquet pieces, path-encoded text, nested JSON, score shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import durable

MOST_BYTES = 64 << 20  # a file of a tree that is read as one row


class Tables:
    """The tables of a folder: ``t.orders`` reads ``<folder>/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """Delimited files with a header row and a given schema.

    Large files are read in splits. ``multi_line`` allows line breaks inside quoted fields;
    each file is then one task, so such data should come in many files.
    """
    reader = spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
    return reader.option("escape", '"').csv(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType, bad: str = "_bad", multi_line: bool = False) -> DataFrame:
    """Like ``read_csv``; a field that does not parse is null and marks its row as bad.

    Fields are read as text and cast one by one, so the mark does not depend on which
    columns a later step selects (the reader's own corrupt-record column does).
    """
    text = StructType([StructField(f.name, StringType()) for f in schema])
    raw = read_csv(spark, path, text, multi_line)
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    broken = [F.col(n).isNotNull() & c.isNull() for n, c in cast.items()]
    return raw.select(*[c.alias(n) for n, c in cast.items()], reduce(lambda a, b: a | b, broken).alias(bad))


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index columns that a previous export left without a name."""
    return df.drop(*[c for c in df.columns if c == "_c0" or c.startswith("Unnamed:")])


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet pieces of a folder; other files in it are ignored."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)


def path_keys(path: Column) -> dict[str, Column]:
    """sector/company/<SYMBOL><year><quarter>.csv to columns."""
    return {
        "sector": F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1),
        "company": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1),
        "symbol": F.regexp_extract(path, r"([^/]+)\d{5}\.csv$", 1),
        "year": F.regexp_extract(path, r"(\d{4})\d\.csv$", 1).try_cast("int"),
        "quarter": F.regexp_extract(path, r"\d{4}(\d)\.csv$", 1).try_cast("int"),
    }


def read_file_tree(spark: SparkSession, root: str, pattern: str = "*.csv", exclude: str = "", most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length, text of every file of a folder tree, a file being one row; no file stops the job.

    The listing alone says which files there are. ``text`` is null for a file that could not be read
    (unreadable, gone meanwhile, above ``most_bytes``) or that is not UTF-8, so raw and usable
    files can be counted. Names that end with ``exclude`` are left out, and files of no bytes, which
    Spark does not list.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = files.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    if exclude:
        files = files.where(~F.col("path").endswith(exclude))
    listed = files.select("path", "length")  # nothing is opened for these columns
    opened = files.where(F.col("length") <= most_bytes).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return listed.join(opened, "path", "left")


def _record(text: Column, i: int) -> Column:
    """Value of the i-th ``name,value`` record; the last one may hold line breaks. Null if it is missing."""
    found = F.get(F.split(text, r"\r?\n", 3), i)
    value = F.regexp_replace(F.regexp_replace(found, r'(?s)^[^,]*,"?', ""), r'(?s)"?\s*$', "")
    return F.when(found.contains(","), value)


def read_call_files(spark: SparkSession, root: str, exclude: str = "speaker names.csv", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Transcript files of a folder tree, one row a file: keys taken from the path, content, and whether it could be loaded.

    A file holds one record per line as ``name,value``; the second record is the time
    of the call and the third the transcript. A file without both, such as one
    that was cut, and a file that cannot be read at all have ``loaded`` false.
    """
    files = read_file_tree(spark, root, exclude=exclude, most_bytes=most_bytes)
    call = files.select(
        *[c.alias(n) for n, c in path_keys(F.col("path")).items()], _record(F.col("text"), 1).alias("datetime"), _record(F.col("text"), 2).alias("transcript"))
    return call.withColumn("loaded", F.col("datetime").isNotNull() & F.col("transcript").isNotNull())


def read_calls(spark: SparkSession, root: str, exclude: str = "speaker names.csv") -> DataFrame:
    """The transcript files of a folder tree that could be loaded."""
    return read_call_files(spark, root, exclude).where("loaded").drop("loaded")


ENTRY_SCHEMA = "struct<bs:array<struct<label:string,value:double>>,ic:array<struct<label:string,value:double>>>"


def labelled_value(entries: Column, label: str) -> Column:
    """Value of the last array entry carrying a label, null if there is none."""
    hits = F.filter(entries, lambda e: e["label"] == label)
    return F.try_element_at(hits, F.lit(-1))["value"]


def json_field(text: Column, schema: str, field: str) -> Column:
    return F.from_json(text, schema)[field]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0 in its file), value: the lines of text files that hold more than blanks.

    Large files are read in splits. Lines are counted per split; the counts before a split, in the
    order of the splits' places in the file, give its offset. No file is held as one row.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.trim("value").alias("value"))
    # Numbers that grow along a split; written, so that both uses below see the same ones.
    lines = durable(lines.where("value <> ''").withColumn("at", F.monotonically_increasing_id()))
    splits = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    return lines.join(splits, ["path", "block"]).select(
        name.alias("file"), (F.col("offset") + F.col("at") - F.col("first")).alias("line"), "value")


def read_score_shards(spark: SparkSession, path: str) -> DataFrame:
    """(position, score) from files ``<name>_<start>_<end>.txt`` with one number per line.

    The position is the start given in the file name plus the line's number, so shards
    may come in any order and length. Where shards overlap the first by name wins; a line
    that is no number has a null score.
    """
    lines = numbered_lines(spark, path)
    start = F.regexp_extract("file", r"_(\d+)_\d+\.txt$", 1).try_cast("long")
    scored = lines.select("file", (start + F.col("line")).alias("position"), F.col("value").try_cast("double").alias("score"))
    return scored.where("position is not null").groupBy("position").agg(F.min_by("score", "file").alias("score"))
