"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.stored import shuffles_freed


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table with lower-case columns; times without a zone are read in the session's."""
    df = lower_columns(spark.read.parquet(f"{folder}/{name}.parquet"))
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema))


def read_feed(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", **options: str) -> DataFrame:
    """A feed of a declared schema: parquet, csv or json; unknown columns are left out."""
    return lower_columns(spark.read.schema(schema).options(**options).format(kind).load(path))


def with_audit(df: DataFrame, system: str, layer: str, at=None) -> DataFrame:
    """Audit columns: time of ingestion (``at`` or now), source system, layer marker."""
    return df.withColumns({"_ingested_at": F.lit(at).cast("timestamp") if at else F.current_timestamp(), "_source_system": F.lit(system), f"_{layer}_layer": F.lit(True)})


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Rewrites only the partitions that ``df`` has, so a second run on the same input changes nothing."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    with shuffles_freed(df.sparkSession):
        (writer.partitionBy(*by) if by else writer).parquet(path)


def append_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Adds rows to the partitions of a table that is made step by step."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a table of actions or reports."""
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, at=None) -> None:
    """Adds the rows of a report to a folder of JSON lines, with the time of the report."""
    df.withColumn("_reported_at", F.lit(at).cast("timestamp") if at else F.current_timestamp()).write.mode("append").json(path)


def string_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SUPPLIER_MASTER = string_schema(
    "SUPPLIER_ID", "SUPPLIER_NAME", "COUNTRY_CODE", "REGION", "PRIMARY_CATEGORY", "ANNUAL_SPEND_USD", "CONTRACT_TYPE", "PAYMENT_TERMS_DAYS",
    "AVG_LEAD_TIME_DAYS", "SOLE_SOURCE_FLAG", "TIER", "ERP_LAST_UPDATED", "FINANCIAL_SCORE_EXT", "CONTACT_EMAIL",
)
