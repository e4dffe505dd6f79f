"""Access to the Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, rows repeated as a whole once (their key tells; maps can't be compared)."""
    return table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
