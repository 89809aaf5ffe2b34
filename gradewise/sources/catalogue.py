"""Catalogue and profiling scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Catalogue names of types.
TYPE_NAMES = {"bigint": "bigint", "int": "integer", "double": "double precision", "float": "double precision", "string": "character varying", "boolean": "boolean", "date": "timestamp"}


def type_name(spark_type: str) -> str:
    return "timestamp" if spark_type.startswith("timestamp") else TYPE_NAMES.get(spark_type, spark_type)


def describe_table(df: DataFrame) -> DataFrame:
    """``column_name, data_type`` in the order of the columns."""
    return df.sparkSession.createDataFrame([(c, type_name(t)) for c, t in df.dtypes], "column_name string, data_type string")


def _sampled(df: DataFrame, sample_limit: int | None) -> DataFrame:
    return df if sample_limit is None else df.limit(sample_limit)


def column_profile(df: DataFrame, column: str, col_id: str, sample_limit: int | None = 100_000) -> DataFrame:
    """``value, n_rows, n_ids`` of a column over a sample (any rows), most rows first; None reads all."""
    rows = _sampled(df.select(F.col(column).alias("value"), F.col(col_id).alias("id_")), sample_limit)
    return rows.groupBy("value").agg(F.count("*").alias("n_rows"), F.count_distinct("id_").alias("n_ids")).orderBy(F.desc("n_rows"))


def fetch_portfolio(df: DataFrame, column: str, col_id: str, sample_limit: int | None = 100_000) -> DataFrame:
    """``portfolio, n_ids``, most ids first; the first row is the dominant portfolio."""
    rows = _sampled(df.select(F.col(column).alias("portfolio"), F.col(col_id).alias("id_")), sample_limit)
    return rows.groupBy("portfolio").agg(F.count_distinct("id_").alias("n_ids")).orderBy(F.desc("n_ids"), "portfolio")


def fetch_columns_by_id(df: DataFrame, col_id: str, columns: list[str]) -> DataFrame:
    return df.select(col_id, *[c for c in dict.fromkeys(columns) if c != col_id])
