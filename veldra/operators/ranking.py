"""Operators on ranked hits: boosts, caps, budgets, neighbours and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Weights of the boosts: fixed values.
BOOSTS = {"table": 0.05, "year": 0.03, "section": 0.02, "keyword": 0.02, "filename": 0.03, "entity_penalty": -0.01, "hit": 0.01, "graph": 0.35}


def dedup_max(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def boost(is_table: Column, year_hit: Column, section_hit: Column, keyword_hit: Column | None, filename_hit: Column, hits: Column, graph: Column, scope: str = "single") -> Column:
    """Sum of the boosts; ``keyword_hit`` is None where the query has no keywords."""

    def when(c: Column, w: float) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)

    out = when(is_table, BOOSTS["table"]) + when(year_hit, BOOSTS["year"]) + when(section_hit, BOOSTS["section"]) + when(filename_hit, BOOSTS["filename"])
    if keyword_hit is not None:
        out += F.when(F.coalesce(keyword_hit, F.lit(False)), BOOSTS["keyword"]).otherwise(BOOSTS["entity_penalty"] if scope in ("single", "few") else 0.0)
    return out + F.greatest(hits - 1, F.lit(0)) * BOOSTS["hit"] + F.greatest(graph, F.lit(0.0)) * BOOSTS["graph"]


def threshold_cap(df: DataFrame, score: str, least: float, k: int, by: str = "query_id", tie: str = "id") -> DataFrame:
    return df.filter(F.col(score) >= least).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)).cast("int")).filter(F.col("place") <= k)


def diversity_cap(df: DataFrame, docs: int = 6, each: int = 4, by: str = "query_id", doc: str = "source_file", score: str = "score", tie: str = "id") -> DataFrame:
    """At most ``each`` rows of the ``docs`` documents with the best rows."""
    own = Window.partitionBy(by, doc)
    ranked = df.withColumn("__best", F.max(score).over(own)).withColumn("in_doc", F.row_number().over(own.orderBy(F.desc(score), tie)).cast("int"))
    ranked = ranked.withColumn("doc_rank", F.dense_rank().over(Window.partitionBy(by).orderBy(F.desc("__best"), doc)).cast("int"))
    return ranked.filter((F.col("doc_rank") <= docs) & (F.col("in_doc") <= each)).drop("__best")


def token_budget(df: DataFrame, budget: Column | int, order: list[Column], by: list[str], size: str = "tokens", is_table: str = "is_table") -> DataFrame:
    """The prefix that fits: tables are forced in and counted; the first other row that overflows ends the rest."""
    w = Window.partitionBy(*by).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = (~F.coalesce(F.col(is_table), F.lit(False))) & (total > budget)
    stopped = F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running_tokens", total).withColumn("__stop", stopped).filter("__stop = 0").drop("__stop")


def neighbours(hits: DataFrame, chunks: DataFrame, by: str = "query_id", minus: float = 0.05) -> DataFrame:
    """Chunks next to a hit in its file that aren't hits: ``query_id, chunk_id, score, anchor``.

    The first anchor in the order of rank gives the score, less ``minus``.
    """
    wanted = hits.select(by, "source_file", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"), F.col("id").alias("anchor"), "score", "rank")
    found = wanted.join(chunks.select("source_file", "chunk_index", "chunk_id"), ["source_file", "chunk_index"])
    found = found.join(hits.select(by, F.col("id").alias("chunk_id")), [by, "chunk_id"], "left_anti")
    return dedup_max(found, [by, "chunk_id"], [F.asc("rank"), F.asc("anchor")]).select(by, "chunk_id", F.round(F.col("score") - minus, 8).alias("score"), "anchor")


def page_number_key(label: Column) -> Column:
    """Sort key of page labels: numbers first by value (``~`` aside), others by text."""
    plain = F.regexp_replace(label, "~", "")
    return F.struct(F.when(plain.rlike("^[0-9]{1,9}$"), 0).otherwise(1).alias("kind"), F.when(plain.rlike("^[0-9]{1,9}$"), plain.cast("int")).otherwise(0).alias("n"), label.alias("label"))


def source_rollup(hits: DataFrame, by: list[str]) -> DataFrame:
    """For each file its distinct page labels in order, and how many chunks."""
    pages = F.array_sort(F.collect_set(F.when(F.coalesce(F.col("page_label"), F.lit("")) != "", page_number_key(F.col("page_label")))))
    return hits.groupBy(*by, "source_file").agg(F.array_join(F.transform(pages, lambda p: p["label"]), ",").alias("pages"), F.count("*").alias("chunks"))
