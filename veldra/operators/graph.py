"""Property-graph operators over vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions import text as T

#: Relations are kept from this confidence on; what their names look like is a fixed value.
LEAST_CONFIDENCE = 0.90
RELATION_NAME = "^[A-Z_][A-Z0-9_]*$"


def khop(edges: DataFrame, seeds: DataFrame, hops: int = 3, names: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """``seed, node, hops, strengths, path``: trails of 1 to ``hops`` edges from the seeds, either way along an edge.

    An edge occurs once in a trail, a node may come again. ``edges``: edge_id, src, dst,
    strength. Each hop is one equi-join on the node reached. Seeds may have the node they
    begin at in ``start``. With ``names`` (entity_key, name) and ``kind`` (a column of the edges)
    the trail as ``text``, too: ``(a) --[KIND]--> (b)``.
    """
    extra = [F.col(kind).alias("kind")] if kind else []
    both = edges.select("edge_id", F.col("src").alias("at"), F.col("dst").alias("to"), "strength", *extra).unionByName(edges.filter("src <> dst").select("edge_id", F.col("dst").alias("at"), F.col("src").alias("to"), "strength", *extra))
    start = F.col("start") if "start" in seeds.columns else F.col("seed")
    now = seeds.select("seed", start.alias("node"), F.array().cast("array<double>").alias("strengths"), F.array().cast("array<string>").alias("path"))
    if names is not None:
        both = both.join(names.select(F.col("entity_key").alias("to"), F.col("name").alias("to_name")), "to", "left")
        now = now.join(names.select(F.col("entity_key").alias("node"), F.concat(F.lit("("), F.coalesce("name", F.lit("")), F.lit(")")).alias("text")), "node", "left")
    out = None
    for h in range(1, hops + 1):
        now = now.join(both, now["node"] == both["at"]).filter(~F.array_contains("path", F.col("edge_id").cast("string")))
        text = [] if names is None else [F.concat(F.coalesce("text", F.lit("()")), F.lit(" --["), "kind", F.lit("]--> ("), F.coalesce("to_name", F.lit("")), F.lit(")")).alias("text")]
        now = now.select("seed", F.col("to").alias("node"), F.concat("strengths", F.array("strength")).alias("strengths"), F.concat("path", F.array(F.col("edge_id").cast("string"))).alias("path"), *text)
        step = now.withColumn("hops", F.lit(h))
        out = step if out is None else out.unionByName(step)
    return out


def hop_decay(hops: Column) -> Column:
    return F.when(hops <= 1, 1.0).when(hops == 2, 0.65).otherwise(0.4)


def edge_strength(confidence: Column, count: Column) -> Column:
    return confidence * F.log10(count + 9)


def path_score(paths: DataFrame) -> DataFrame:
    """``seed, node, score, hops``: of the shortest trail (the first of them), its weakest edge times the decay of its length."""
    first = paths.withColumn("n", F.row_number().over(Window.partitionBy("seed", "node").orderBy("hops", F.array_join("path", ",")))).filter("n = 1")
    return first.select("seed", "node", F.round(hop_decay(F.col("hops")) * F.array_min("strengths"), 6).alias("score"), "hops")


def incident(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges of which either end is among the keys."""
    k = keys.select(F.col("key").alias("__k")).distinct()
    one = edges.join(k, edges["src"] == F.col("__k"), "left_semi")
    return one.unionByName(edges.join(k, edges["dst"] == F.col("__k"), "left_semi")).distinct()


def orphans(entities: DataFrame, mentions: DataFrame, key: str = "key") -> DataFrame:
    return entities.join(mentions.select(key).distinct(), key, "left_anti")


def merge_relations(rows: DataFrame) -> DataFrame:
    """One row for each (src, relation, dst): highest confidence, count, all different evidence joined in order.

    Equal pieces of evidence are counted before the pieces of a relation are gathered.
    """
    pieces = rows.groupBy("src", "relation", "dst", "evidence").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list("evidence"))
    return pieces.groupBy("src", "relation", "dst").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("count"), F.array_join(parts, " | ").alias("evidence"))


def validate_relations(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Well named relations between two different known entities, sure enough, with evidence found in the source."""
    known = entities.select(F.col("key").alias("__k")).distinct()
    ok = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    ok = ok.filter(F.col("relation").rlike(RELATION_NAME) & (F.col("src") != F.col("dst")) & (F.col("confidence") >= LEAST_CONFIDENCE) & T.evidence_supported(F.col("evidence"), F.col("source")))
    for end in ("src", "dst"):
        ok = ok.join(known, ok[end] == F.col("__k"), "left_semi")
    return ok


def merge_aliases(old: Column, new: Column) -> Column:
    """The old aliases that no new one equals but for case and blanks, then the new ones."""
    low = F.transform(new, lambda x: F.lower(F.trim(x)))
    return F.concat(F.filter(old, lambda x: ~F.array_contains(low, F.lower(F.trim(x)))), new)
