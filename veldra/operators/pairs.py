"""Pairs of rows with an equal key, with the work of hot keys spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a key from which its pairs are made in several tasks, and the rows each takes of one side.
HOT = 256


def equal_blocks(df: DataFrame, keys: list[str], id: str, carry: list[str], hot: int = HOT) -> DataFrame:
    """``keys, a, b`` and both sides of ``carry`` (with ``_a``, ``_b``): every two rows of an equal key, a < b.

    A key of more than ``hot`` rows is cut into blocks of about so many: each row is sent to
    the tasks of all blocks and met there by the rows of that block only. No pair is lost.
    Null keys make no pairs; ids are to be unique within a key.
    """
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, F.col(id).alias("__i"), *carry).withColumn("__n", F.count("*").over(w)).filter("__n > 1")
    blocks = F.ceil(F.col("__n") / hot).cast("int")
    a = rows.select(*keys, F.col("__i").alias("a"), *(F.col(c).alias(f"{c}_a") for c in carry), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__s"))
    b = rows.select(*keys, F.col("__i").alias("b"), *(F.col(c).alias(f"{c}_b") for c in carry), F.pmod(F.xxhash64("__i"), blocks.cast("long")).cast("int").alias("__s"))
    return a.join(b, [*keys, "__s"]).filter("a < b").drop("__s")
