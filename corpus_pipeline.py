"""A corpus pipeline: each stage is stored, and works on all that the one before it kept.

Rows are never told apart by their ids, which may be null or repeat: a stage carries whole rows through its operator, or
numbers them in a stored table first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixing, near_dedup, packing, quality_rules
from tidemark.llm.queries import BYTES
from tidemark.llm.storage import materialize
from tidemark.llm.text import remainder


def renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named c0, c1, ..., so that no name of theirs meets one that an operator adds."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place(docs: DataFrame, column: str) -> str:
    """The name that :func:`renamed` gives a column."""
    return f"c{docs.columns.index(column)}"


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` of rows of :func:`renamed`, by their own names."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language (op 9); the network learns from those whose crc32 remainder is not 2."""
    rows, key = renamed(docs), place(docs, "doc_id")
    found = language_id.identify(rows, rows.filter(remainder(key, 4) != 2), key, place(docs, "text"), place(docs, "lang"), carry=True)
    return restored(found.filter(F.col("lang_pred") != language_id.UNKNOWN), docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the quality rules (op 8)."""
    return restored(quality_rules.quality_rules(renamed(docs), place(docs, "text"), out="_rules").filter("_rules.kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (op 3)."""
    return restored(near_dedup.one_of_each(renamed(docs), place(docs, "text")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources does (op 4): none, once or twice."""
    rows = materialize(renamed(docs).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    taken = mixing.systematic_copies(rows, place(docs, "text"), place(docs, "source"), key="_row").filter("copies > 0").select("_row", "copies")
    return restored(rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all documents (op 7); a document taken twice is packed twice, as another ``document``."""
    named = docs.select(F.struct(F.monotonically_increasing_id().alias("document"), "doc_id").alias("_key"), "text")
    pieces = packing.token_pieces(named, BYTES, key="_key").drop("ids")
    packed = packing.pack_pieces(pieces.select("_key.document", "_key.doc_id", "piece", "start", "length", "ids_crc32"))
    return packed.select("document", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language), ("quality_rules", rules), ("near_dedup", near_duplicates), ("source_mix", mix), ("packing", pack)]

#: Language identification and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stored as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
