"""Graph operators over places, orders and the entities found in texts."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veldra.functions import text as T
from veldra.operators import graph as G, ranking as R
from veldra.queries import search as Q
from veldra.queries.text import normalize_sql
from veldra.tables import table


def places(spark, d) -> DataFrame:
    """Edges supplier-nation and nation-region."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    one = s.select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.lit("LOCATED_IN").alias("relation"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), (F.lit(0.90) + F.pmod("s_suppkey", F.lit(10)) / 100).alias("confidence"), (F.pmod("s_suppkey", F.lit(7)) + 1).cast("long").alias("count"))
    two = n.select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.lit("PART_OF").alias("relation"), F.concat(F.lit("R"), "n_regionkey").alias("dst"), F.lit(0.95).alias("confidence"), F.lit(3).cast("long").alias("count"))
    e = one.unionByName(two)
    return e.withColumn("edge_id", F.concat("src", F.lit(">"), "dst")).withColumn("strength", F.round(G.edge_strength(F.col("confidence"), F.col("count")), 6))


def supplies(spark, d) -> DataFrame:
    """Edges supplier-part with counts of lines."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")).agg(F.count("*").alias("count"), F.round(F.max("l_discount") * 2 + 0.8, 6).alias("confidence"))


def seeds(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("seed"))


def khop(spark, d):
    return G.khop(places(spark, d), seeds(spark, d)).groupBy("seed", "node", "hops").agg(F.count("*").alias("trails"))


def entities(spark, d) -> DataFrame:
    return table(spark, d, "g_entity").dropDuplicates(["entity_key"])


def relations(spark, d) -> DataFrame:
    """Relation rows drawn from order lines, some of them not valid."""
    li = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.concat(F.lit("S"), "l_suppkey").alias("src"),
        F.when(flag == "A", "supplies part").when(flag == "N", "SUPPLIES").otherwise("RETURNED").alias("relation"),
        F.concat(F.lit("P"), "l_partkey").alias("dst"),
        (F.lit(0.85) + F.col("l_discount") * 2).alias("confidence"),
        F.concat(F.lit("part "), "l_partkey", F.lit(" of supplier "), "l_suppkey").alias("evidence"),
        F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("Part "), "l_partkey", F.lit(", of Supplier "), "l_suppkey", F.lit("."))).otherwise("nothing").alias("source"),
    )


def known(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("key"))
    return p.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key")))


def alias_table(spark, d) -> DataFrame:
    e = entities(spark, d)
    a = e.select("entity_key", T.normalize_name(F.col("name")).alias("norm"), F.explode("aliases").alias("alias")).withColumn("alias_norm", T.normalize_name(F.col("alias"))).filter("alias_norm <> '' and norm <> '' and alias_norm <> norm")
    return R.dedup_max(a, ["alias_norm"], [F.asc("norm"), F.asc("entity_key")]).select("alias_norm", F.col("norm").alias("canonical"))


#: Entities of a type compared with as many others at once.
ENTITIES_PER_BLOCK = 2_000


def semantic(spark, d):
    """Each entity's most similar other one of its type by the cosine of their vectors, if 0.85 or more.

    All entities of a type are compared, a block of them with a block at a time.
    """
    e = entities(spark, d).filter("size(embedding) = 8 and type is not null and entity_key is not null and not exists(embedding, x -> x is null or isnan(x)) and exists(embedding, x -> x <> 0)")
    e = e.select("entity_key", F.upper("type").alias("type"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = e.groupBy("type").agg(F.ceil(F.count("*") / ENTITIES_PER_BLOCK).alias("blocks"))
    e = e.join(blocks, "type").withColumn("own", F.pmod(F.xxhash64("entity_key"), F.col("blocks"))).withColumn("every", F.explode(F.expr("sequence(0L, blocks - 1)")))
    names = ("type", "one", "two", "entity_key", "embedding")
    sides = [e.select(*(F.col(c).alias(n) for c, n in zip(("type", one, two, "entity_key", "embedding"), names))) for one, two in (("own", "every"), ("every", "own"))]

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"entity_key": [], "other": [], "cosine": []})
        two = two.sort_values("entity_key")
        x, y = (np.array(side["embedding"].tolist(), np.float64) for side in (one, two))
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        cosine = np.round(x @ y.T, 6)
        cosine[one["entity_key"].to_numpy()[:, None] == two["entity_key"].to_numpy()] = -2
        at = cosine.argmax(axis=1)  # the first, of the least key, among equals
        out = pd.DataFrame({"entity_key": one["entity_key"].to_numpy(), "other": two["entity_key"].to_numpy()[at], "cosine": cosine[np.arange(len(one)), at]})
        return out[out["cosine"] >= 0.85]

    by = ("type", "one", "two")
    p = sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInPandas(best, "entity_key string, other string, cosine double")
    return R.dedup_max(p, ["entity_key"], [F.desc("cosine"), F.asc("other")])


#: Ratio over which two names are one, and how many counts of single and paired letters a name is filed under.
SAME_NAME, _LETTERS, _PAIRS = 0.85, 64, 192


class _Heads:
    """First names, looked up by exact bounds before they are compared.

    A ratio over ``SAME_NAME`` leaves fewer than (1 - SAME_NAME) times both lengths in
    insertions and deletions. Each changes the counts of letters by 1 and those of pairs of
    letters by 3 at most, so names whose counts differ by more can't be that alike; counts
    that share a place or are cut at 255 only differ less.
    """

    def __init__(self, most: int) -> None:
        self.names: list[str] = []
        self.counts = np.zeros((_LETTERS + _PAIRS, most), np.uint8)
        self.length, self.letters, self.pairs = (np.zeros(most, np.int64) for _ in range(3))

    @staticmethod
    def _counts(name: str) -> np.ndarray:
        o = np.array([ord(c) for c in name], np.int64)
        at = np.concatenate([o % _LETTERS, _LETTERS + (o[:-1] * 31 + o[1:]) % _PAIRS])
        return np.minimum(np.bincount(at, minlength=_LETTERS + _PAIRS), 255)

    def find(self, name: str) -> tuple[float, str]:
        """The greatest (ratio, head) of the heads that can be over ``SAME_NAME``."""
        n, own = len(self.names), self._counts(name)
        left = (1 - SAME_NAME) * (self.length[:n] + len(name)) + 1e-6
        near = np.abs(self.length[:n] - len(name)) <= left
        for lo, hi, total, changed in ((0, _LETTERS, self.letters, 1), (_LETTERS, _LETTERS + _PAIRS, self.pairs, 3)):
            at = np.flatnonzero(near)
            common = np.zeros(len(at), np.int64)
            for k in lo + np.flatnonzero(own[lo:hi]):
                common += np.minimum(self.counts[k, at], own[k])
            near[at] = total[at] + own[lo:hi].sum() - 2 * common <= changed * left[at]
        heads = (self.names[k] for k in np.flatnonzero(near))
        return max(((difflib.SequenceMatcher(None, name, h).ratio(), h) for h in heads), default=(0.0, ""))

    def add(self, name: str) -> None:
        n, own = len(self.names), self._counts(name)
        self.counts[:, n] = own
        self.length[n], self.letters[n], self.pairs[n] = len(name), own[:_LETTERS].sum(), own[_LETTERS:].sum()
        self.names.append(name)


def resolution(spark, d):
    """Greedy resolution: names of one type and number signature go to the first like one (ratio over 0.85)."""
    e = entities(spark, d).select("entity_key", F.upper(F.coalesce("type", F.lit(""))).alias("type"), T.normalize_name(F.col("name")).alias("norm")).filter("norm <> ''")
    e = e.withColumn("numbers", F.array_join(F.regexp_extract_all("norm", F.lit("([0-9]+)"), F.lit(1)), "|"))

    def greedy(own: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(own["norm"]))
        heads, canonical = _Heads(len(names)), {}
        for norm in names:
            ratio, head = heads.find(norm)
            if ratio > SAME_NAME:
                canonical[norm] = head
            else:
                heads.add(norm)
                canonical[norm] = norm
        return pd.DataFrame({"entity_key": own["entity_key"], "canonical": own["norm"].map(canonical)})

    return e.groupBy("type", "numbers").applyInPandas(greedy, "entity_key string, canonical string")


def dual_keys(spark, d):
    """Keys of entity hits, then both ends of relation hits, each once with its first position."""
    p = places(spark, d).filter("relation = 'LOCATED_IN'")
    hit = p.filter("src <= 'S3'").select(F.col("src").alias("key"), F.lit(0).alias("pos"))
    ends = p.filter("confidence >= 0.95")
    both = hit.unionByName(ends.select(F.col("src").alias("key"), F.lit(1).alias("pos"))).unionByName(ends.select(F.col("dst").alias("key"), F.lit(2).alias("pos")))
    return both.groupBy("key").agg(F.min("pos").alias("pos"))


def gleaning(spark, d):
    """Second-pass entities whose names are new, after those of the first."""
    e = entities(spark, d).select("entity_key", F.lower("name").alias("n")).filter("n is not null")
    first, second = e.filter("entity_key like 'PERSON%'"), e.filter("entity_key not like 'PERSON%'")
    return first.unionByName(second.join(first.select("n"), "n", "left_anti").select("entity_key", "n"))


QUERIES = {
    "graph_khop": khop,
    "graph_path_score": lambda spark, d: G.path_score(G.khop(places(spark, d), seeds(spark, d))),
    "graph_global_top": lambda spark, d: supplies(spark, d).orderBy(F.desc("count"), "src", "dst").limit(30),
    "edge_incidence": lambda spark, d: G.incident(places(spark, d).select("src", "relation", "dst"), seeds(spark, d).filter("seed like '%1'").withColumnRenamed("seed", "key")),
    "orphan_entities": lambda spark, d: G.orphans(table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("key")), table(spark, d, "lineitem").filter("l_quantity > 48").select(F.concat(F.lit("P"), "l_partkey").alias("key"))),
    "mention_counts": lambda spark, d: table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_key"), F.col("l_partkey").alias("entity_key")).agg(F.count("*").alias("count")),
    "relation_merge": lambda spark, d: G.merge_relations(relations(spark, d)).withColumn("confidence", F.round("confidence", 6)),
    "relation_validation": lambda spark, d: G.validate_relations(relations(spark, d), known(spark, d)).groupBy("src", "relation", "dst").agg(F.count("*").alias("n")),
    "evidence_support": lambda spark, d: relations(spark, d).groupBy(T.evidence_supported(F.col("evidence"), F.col("source")).alias("supported")).agg(F.count("*").alias("n")),
    "entity_merge": lambda spark, d: table(spark, d, "g_entity").filter("name_norm is not null and name_norm <> ''").groupBy("name_norm").agg(F.min("effective_date").alias("first_date"), F.array_join(F.array_sort(F.collect_set("description")), " ").alias("description"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))), "|").alias("aliases")),
    "alias_merge": lambda spark, d: entities(spark, d).filter("aliases is not null").select("entity_key", F.array_join(G.merge_aliases(F.col("aliases"), F.array(F.coalesce("name", F.lit("")))), "|").alias("aliases")),
    "alias_resolution": lambda spark, d: (lambda e: e.join(alias_table(spark, d), e["norm"] == F.col("alias_norm"), "left").select("entity_key", F.coalesce("canonical", "norm").alias("name")))(entities(spark, d).select("entity_key", T.normalize_name(F.col("name")).alias("norm"))),
    "semantic_entity_merge": semantic,
    "entity_resolution": resolution,
    "dual_level_keys": dual_keys,
    "relationship_union": lambda spark, d: places(spark, d).filter("confidence >= 0.93").select("src", "relation", "dst").unionByName(places(spark, d).filter("count >= 3").select("src", "relation", "dst")).distinct(),
    "gleaning_merge": gleaning,
    "entity_text": lambda spark, d: entities(spark, d).select("entity_key", F.concat_ws(" ", "name", F.concat(F.lit("("), F.upper("type"), F.lit(")")), "description").alias("text")),
    "relationship_text": lambda spark, d: places(spark, d).select("edge_id", F.concat_ws(" ", "src", F.lower(F.regexp_replace("relation", "_", " ")), "dst").alias("text")),
    "graph_export": lambda spark, d: places(spark, d).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), "relation", F.lit(" | "), "dst", F.lit(" |")))), "\n").alias("markdown")),
}

PL = """
pl AS (SELECT *, src || '>' || dst AS edge_id, round(confidence * log10(count + 9), 6) AS strength FROM (
  SELECT 'S' || s_suppkey AS src, 'LOCATED_IN' AS relation, 'N' || s_nationkey AS dst, 0.90::DOUBLE + (s_suppkey % 10)::DOUBLE / 100 AS confidence, ((s_suppkey % 7) + 1)::BIGINT AS count FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'PART_OF', 'R' || n_regionkey, 0.95::DOUBLE, 3::BIGINT FROM nation))"""
_HOPS = f"""WITH {PL}, bo AS (SELECT edge_id, src AS frm, dst AS nxt, strength FROM pl UNION ALL SELECT edge_id, dst, src, strength FROM pl),
h1 AS (SELECT frm AS seed, nxt AS node, 1 AS hops, strength AS low, [edge_id] AS path FROM bo WHERE frm LIKE 'S%'),
h2 AS (SELECT seed, nxt AS node, 2 AS hops, least(low, strength) AS low, list_append(path, edge_id) AS path FROM h1 JOIN bo ON node = frm WHERE NOT list_contains(path, edge_id)),
h3 AS (SELECT seed, nxt AS node, 3 AS hops, least(low, strength) AS low, list_append(path, edge_id) AS path FROM h2 JOIN bo ON node = frm WHERE NOT list_contains(path, edge_id)),
hh AS (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3)"""
_REL = """rl AS (SELECT 'S' || l_suppkey AS src, CASE l_returnflag WHEN 'A' THEN 'supplies part' WHEN 'N' THEN 'SUPPLIES' ELSE 'RETURNED' END AS relation, 'P' || l_partkey AS dst,
  0.85::DOUBLE + l_discount * 2 AS confidence, 'part ' || l_partkey || ' of supplier ' || l_suppkey AS evidence, l_linenumber % 2 = 1 AS supported FROM lineitem)"""
_EN = "en AS (SELECT DISTINCT ON (entity_key) * FROM g_entity)"

SQL = {
    "graph_khop": f"{_HOPS} SELECT seed, node, hops::INT AS hops, count(*) AS trails FROM hh GROUP BY ALL",
    "graph_path_score": f"{_HOPS} SELECT seed, node, round(CASE hops WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.65::DOUBLE ELSE 0.4::DOUBLE END * low, 6) AS score, hops::INT AS hops FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY hops, array_to_string(path, ',')) AS n FROM hh) WHERE n = 1",
    "graph_global_top": "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, count(*) AS count, round(max(l_discount) * 2 + 0.8, 6) AS confidence FROM lineitem GROUP BY ALL ORDER BY count DESC, src, dst LIMIT 30",
    "edge_incidence": f"WITH {PL} SELECT DISTINCT src, relation, dst FROM pl WHERE (src LIKE 'S%1') OR (dst LIKE 'S%1')",
    "orphan_entities": "SELECT 'P' || p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    "mention_counts": "SELECT l_orderkey AS chunk_key, l_partkey AS entity_key, count(*) AS count FROM lineitem GROUP BY ALL",
    "relation_merge": f"WITH {_REL} SELECT src, relation, dst, round(max(confidence), 6) AS confidence, count(*) AS count, any_value(evidence) AS evidence FROM rl GROUP BY src, relation, dst",
    "relation_validation": f"WITH {_REL} SELECT src, relation, dst, count(*) AS n FROM rl WHERE regexp_full_match(relation, '[A-Z_][A-Z0-9_]*') AND least(confidence, 1) >= 0.9 AND supported AND src IN (SELECT 'S' || s_suppkey FROM supplier) AND dst IN (SELECT 'P' || p_partkey FROM part) GROUP BY ALL",
    "evidence_support": f"WITH {_REL} SELECT supported, count(*) AS n FROM rl GROUP BY ALL",
    "entity_merge": """WITH d AS (SELECT name_norm, min(effective_date) AS first_date, coalesce(array_to_string(list_sort(list(DISTINCT description) FILTER (description IS NOT NULL)), ' '), '') AS description FROM g_entity WHERE name_norm <> '' GROUP BY 1),
a AS (SELECT name_norm, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases FROM (SELECT name_norm, unnest(aliases) AS alias FROM g_entity WHERE name_norm <> '') WHERE alias IS NOT NULL GROUP BY 1)
SELECT name_norm, first_date, description, coalesce(aliases, '') AS aliases FROM d LEFT JOIN a USING (name_norm)""",
    "alias_merge": f"WITH {_EN} SELECT entity_key, array_to_string(list_append(list_filter(aliases, lambda x: lower(trim(x)) <> lower(trim(coalesce(name, '')))), coalesce(name, '')), '|') AS aliases FROM en WHERE aliases IS NOT NULL",
    "alias_resolution": f"""WITH {_EN}, x AS (SELECT entity_key, {normalize_sql('name')} AS norm, aliases FROM en), u AS (SELECT entity_key, norm, unnest(aliases) AS alias FROM x),
v AS (SELECT *, {normalize_sql('alias')} AS alias_norm FROM u), t AS (SELECT DISTINCT ON (alias_norm) alias_norm, norm AS canonical FROM v WHERE alias_norm <> '' AND norm <> '' AND alias_norm <> norm ORDER BY alias_norm, norm, entity_key)
SELECT entity_key, coalesce(canonical, norm) AS name FROM x LEFT JOIN t ON norm = alias_norm""",
    "semantic_entity_merge": f"""WITH {_EN}, v AS (SELECT entity_key, upper(type) AS type, embedding::DOUBLE[8] AS e FROM en WHERE len(embedding) = 8 AND type IS NOT NULL),
p AS (SELECT a.entity_key, b.entity_key AS other, round(array_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.type = b.type AND a.entity_key <> b.entity_key)
SELECT DISTINCT ON (entity_key) entity_key, other, cosine FROM p WHERE cosine >= 0.85 ORDER BY entity_key, cosine DESC, other""",
    "dual_level_keys": f"WITH {PL}, l AS (SELECT * FROM pl WHERE relation = 'LOCATED_IN') SELECT key, min(pos)::INT AS pos FROM (SELECT src AS key, 0 AS pos FROM l WHERE src <= 'S3' UNION ALL SELECT src, 1 FROM l WHERE confidence >= 0.95 UNION ALL SELECT dst, 2 FROM l WHERE confidence >= 0.95) GROUP BY key",
    "relationship_union": f"WITH {PL} SELECT src, relation, dst FROM pl WHERE confidence >= 0.93 UNION SELECT src, relation, dst FROM pl WHERE count >= 3",
    "gleaning_merge": f"WITH {_EN}, x AS (SELECT entity_key, lower(name) AS n FROM en WHERE name IS NOT NULL) SELECT entity_key, n FROM x WHERE entity_key LIKE 'PERSON%' OR n NOT IN (SELECT n FROM x WHERE entity_key LIKE 'PERSON%')",
    "entity_text": f"WITH {_EN} SELECT entity_key, concat_ws(' ', name, '(' || upper(type) || ')', description) AS text FROM en",
    "relationship_text": f"WITH {PL} SELECT edge_id, concat_ws(' ', src, lower(replace(relation, '_', ' ')), dst) AS text FROM pl",
    "graph_export": f"WITH {PL} SELECT src, string_agg('| ' || relation || ' | ' || dst || ' |', chr(10) ORDER BY '| ' || relation || ' | ' || dst || ' |') AS markdown FROM pl GROUP BY src",
}
