"""Pairs of rows with an equal key, with the work of hot keys spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a key from which its pairs are made in several tasks, and the rows each of them takes of one side.
HOT = 512


def equal_pairs(keyed: DataFrame, key: str, id: str, hot: int = HOT) -> DataFrame:
    """``a, b`` with a < b: every two different ids of an equal key, each pair once.

    A key of more than ``hot`` rows is cut into blocks of about ``hot`` rows. A row goes to
    the tasks of all blocks once and is met there by the rows of that block only, so
    no task makes more than ``hot`` times the rows it reads, and no pair is lost. Null
    keys and ids make no pairs; repeated rows count once.
    """
    rows = keyed.select(F.col(key).alias("k"), F.col(id).alias("i")).filter("k is not null and i is not null").repartition("k").dropDuplicates(["k", "i"])
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("k"))).filter("n > 1")
    blocks = F.ceil(F.col("n") / hot).cast("int")
    a = sized.select("k", F.col("i").alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("s"))
    b = sized.select("k", F.col("i").alias("b"), F.pmod(F.xxhash64("i"), blocks.cast("long")).cast("int").alias("s"))
    return a.join(b, ["k", "s"]).filter("a < b").select("a", "b").distinct()
