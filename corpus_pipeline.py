"""A corpus pipeline of operators of ``paneloom.llm``: each stage reads what its predecessor wrote.

Language identification, near-duplicates, secrets, mixing, packing. All but the last stage
return the columns of ``documents``; rows that they keep stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paneloom.llm import op1_minhash, op4_language, op5_secrets, op6_packing, op8_mixing
from paneloom.llm.base import settle, stored

LEAST_SCORE = 0.5  # a language must be more likely than all others together
MOST_BITS = 7.5  # a byte; a text that no learned language codes better than at random is in none


def _row(docs: DataFrame) -> Column:
    return F.struct(*[f"`{c}`" for c in docs.columns])


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: not ``und``, a clear best language, coded better than at random.

    Learns from the labelled rows of ``docs`` that are not held out. Null and letterless texts go;
    repeated rows are judged each by its own text.
    """
    settle(spark)
    found = op4_language.identify(docs, op4_language.learned(docs), _row(docs), text_in_row=True)
    good = (F.col("lang_pred") != op4_language.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("bits_per_byte") <= MOST_BITS)
    return _columns(found.where(good), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each class over shingles of five words, similarity 0.8.

    Rows are judged one by one, also those that share a doc_id or have none (they come last in
    their class); of equal rows one stays. Null and wordless texts are in no class and stay.
    """
    settle(spark)
    numbered = stored(docs.select(_row(docs).alias("row"), F.monotonically_increasing_id().alias("nth")), "numbered")
    text, doc_id = (F.col("row").getField(c).alias(c) for c in ("text", "doc_id"))
    out = op1_minhash.near_duplicates(numbered.select(F.col("nth").alias("doc_id"), text), shingle=5, percent=80)
    out = out.select(F.col("doc_id").alias("nth"), "component_id").join(numbered.select("nth", doc_id), "nth")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "nth"))
    kept = stored(out.groupBy("component_id").agg(first.getField("nth").alias("nth")).select("nth"), "kept")
    return _columns(numbered.join(kept, "nth", "left_semi"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark, n_chars follows. Repeated rows and nulls stay."""
    settle(spark)
    return op5_secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources by weights 1, 2, 3 in turn, at most 3 times.

    Repeated rows are documents of their own; wordless ones of a source with words may be taken as well.
    """
    settle(spark)
    # The copies are worked out on narrow rows and then brought to the documents.
    numbered = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("nth"))
    numbered = stored(numbered, "numbered")
    narrow = numbered.select(
        F.col("row").getField("doc_id").alias("doc_id"), F.col("row").getField("text").alias("text"),
        F.col("row").getField("source").alias("source"), "nth")
    copies = op8_mixing.mixed(narrow, keep=("nth",)).where("copies > 0").select("nth", "copies")
    taken = numbered.join(copies, "nth").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return _columns(taken, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; a null text is one end token."""
    settle(spark)
    return op6_packing.packed_documents(docs)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing),
]
# Code lengths, MinHash components and token ids are beyond SQL; tests/llm holds every stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
