"""Graphs built from extractions: a model's answers about orders, made of their lines, and those of a rule about chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veldra.functions import text as T
from veldra.operators import build as B
from veldra.storage import stage
from veldra.tables import chunks, table


def answers(spark, d, part: str = "true") -> DataFrame:
    """``chunk_key, text, payload`` of each order: suppliers and parts named in it, what they have to do with each other; some answers fenced, some broken."""
    li = table(spark, d, "lineitem").filter(part)
    s, p, odd = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber") % 2 == 1
    said = F.concat(F.lit("Part "), p, F.lit(" came from Supplier "), s)
    supplier = F.struct(F.concat(F.lit("Supplier "), s).alias("name"), F.lit("supplier").alias("type"), F.lit("A supplier.").alias("description"), F.array(F.concat(F.lit("S-"), s)).alias("aliases"))
    item = F.struct(F.concat(F.lit("Part "), p).alias("name"), F.when(F.col("l_partkey") % 10 == 0, "bad type").otherwise("PART").alias("type"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))
    relation = F.struct(
        F.concat(F.lit("S-"), s).alias("source"), F.when(F.col("l_returnflag") == "A", "supplied part").otherwise("supplied").alias("relation"), F.concat(F.lit("part "), p).alias("target"),
        F.round(0.85 + F.col("l_discount") * 2, 4).alias("confidence"), F.when(odd, said).otherwise(F.lit("returned without any receipt whatsoever")).alias("evidence"), F.lit("").alias("description"), F.array(F.lit("Trade")).alias("keywords"),
    )
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", supplier.alias("s"), item.alias("p"), relation.alias("r"), F.when(odd, said).alias("t"))))
    o = li.groupBy("l_orderkey").agg(rows.alias("x"))
    entities = F.flatten(F.transform("x", lambda x: F.array(x["s"], x["p"])))
    payload = F.to_json(F.struct(entities.alias("entities"), F.transform("x", lambda x: x["r"]).alias("relationships")))
    k = F.pmod("l_orderkey", F.lit(10))
    payload = F.when(k == 0, F.concat(F.lit("```json\n"), payload, F.lit("\n```"))).when(k == 1, F.lit("sorry")).otherwise(payload)
    return o.select(F.col("l_orderkey").cast("string").alias("chunk_key"), F.array_join(F.transform("x", lambda x: x["t"]), ". ").alias("text"), payload.alias("payload"))


def parsed(spark, d, part: str = "true") -> DataFrame:
    return stage(B.parse_extractions(answers(spark, d, part)), "parsed")


def relations(spark, d, part: str = "true") -> DataFrame:
    p = parsed(spark, d, part)
    return B.chunk_relations(B.valid_relations(p, stage(B.valid_entities(p), "named")))


def upserted(spark, d):
    """Relations of the orders of even numbers, then those of odd ones put into them."""
    def state(part: str) -> DataFrame:
        return relations(spark, d, part).withColumns({"source": F.concat(F.lit("f"), F.pmod(F.col("key").cast("long"), F.lit(3)).cast("string")), "chunk_id": F.col("key"), "page": F.lit("1")})

    both = B.upsert_relations(B.upsert_relations(None, state("l_orderkey % 2 = 0")), state("l_orderkey % 2 = 1"))
    return both.select("src_key", "relation", "dst_key", F.round("confidence", 6).alias("confidence"), "count", F.array_join(F.array_sort("sources"), ",").alias("sources"), F.size("chunk_ids").alias("chunks"), F.array_join("keywords", ",").alias("keywords"))


def mentions(spark, d):
    """Mentions of entities counted over two passes of the same orders."""
    p = parsed(spark, d)
    m = B.valid_entities(p).select(F.col("key").alias("chunk_key"), "entity_key").distinct()
    return B.upsert_mentions(B.upsert_mentions(None, m), m)


def entities(spark, d):
    """Entities of the orders, of all their extractions."""
    e = B.merge_entities(B.valid_entities(parsed(spark, d)), ["entity_key"])
    return e.select("entity_key", "name", "type", "description", F.array_join("aliases", "|").alias("aliases"))


def upserted_entities(spark, d):
    """Entities of the table put into one of persons only: what is known stays, descriptions are merged."""
    e = table(spark, d, "g_entity").dropDuplicates(["entity_key"]).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    old = e.filter("entity_key like 'PERSON%'").withColumn("description", F.lit("Old."))
    return B.upsert_entities(old, e).select("entity_key", "name", "description", F.array_join("aliases", "|").alias("aliases"))


def gleaning(spark, d):
    """Answers about the first two lines of orders, with what only the answers about all lines have."""
    g = B.gleaned(parsed(spark, d, "l_linenumber <= 2"), parsed(spark, d))
    return g.select("key", F.size("entities").alias("entities"), F.size("relationships").alias("relationships"))


def graph(spark, d) -> dict[str, DataFrame]:
    """The graph of the chunks, by the rule that stands in for a model."""
    g = B.index_graph(chunks(spark, d))
    return {k: stage(v, k) for k, v in g.items()}


def keys(spark, d, g) -> DataFrame:
    """Questions made of the most named entities: each asks for one."""
    e = g["relations"].groupBy("src_key").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "src_key").limit(20)
    return e.select(F.col("src_key").alias("query_id"), F.col("src_key").alias("entity_key"))


def retrieved(mode: str):
    def run(spark, d):
        g = graph(spark, d)
        return B.retrieve(g, keys(spark, d, g), mode)[0]

    return run


def said(spark, d):
    g = graph(spark, d)
    return B.retrieve(g, keys(spark, d, g), "hybrid")[1]


def collections(spark, d):
    """Texts of both vector collections of the orders' graph."""
    p = parsed(spark, d)
    e = B.merge_entities(B.valid_entities(p), ["entity_key"])
    r = B.upsert_relations(None, relations(spark, d).withColumns({"source": F.lit("f"), "chunk_id": F.col("key"), "page": F.lit("1")}))
    c = B.collections({"entities": e, "relations": r})
    return c["entities"].select(F.col("entity_key").alias("key"), "text").unionByName(c["relationships"].select(F.col("relationship_key").alias("key"), "text"))


def without_source(spark, d):
    """The graph of the chunks without those of its largest file: nodes and edges left of each kind."""
    g = graph(spark, d)
    top = g["chunks"].groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1).select(F.col("source").alias("gone"))
    marked = g["chunks"].join(F.broadcast(top), F.col("source") == F.col("gone"), "left")  # one row
    left = B.delete_source({**g, "chunks": marked}, F.col("gone").isNotNull())
    counts = [left[k].agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k in ("documents", "chunks", "mentions", "entities", "relations")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def report(spark, d):
    g = graph(spark, d)
    names = [r["source"] for r in g["chunks"].groupBy("source").agg(F.count("*").alias("n")).orderBy("n", "source").limit(1).collect()]
    return B.source_report(g, names[0] if names else "")


def cached(spark, d):
    """Answers of chunks of which the cache knows a half."""
    c = chunks(spark, d).filter("text is not null").select(F.col("chunk_id").alias("chunk_key"), "text")
    known = c.filter("length(text) % 2 = 0").select(B.cache_key(F.col("text"), "1", "default").alias("hash"), F.lit("{}").alias("payload"))
    return B.extract_new(c, known).select("chunk_key", "hash", "cached")


QUERIES = {
    "extraction_entities": entities,
    "extraction_relations": lambda spark, d: relations(spark, d).select("key", "src_key", "relation", "dst_key", F.round("confidence", 6).alias("confidence"), "evidence"),
    "endpoint_resolution": lambda spark, d: B.endpoint_names(B.valid_entities(parsed(spark, d))),
    "graph_upsert": upserted,
    "entity_upsert": upserted_entities,
    "mention_upsert": mentions,
    "extraction_gleaning": gleaning,
    "extraction_failures": lambda spark, d: B.failure_rate(parsed(spark, d)),
    "extraction_cache": cached,
    "graph_collections": collections,
    "graph_index_stats": lambda spark, d: B.index_graph(chunks(spark, d))["stats"],
    "graph_index_relations": lambda spark, d: (lambda r: r.select("src_key", "relation", "dst_key", "count", "confidence"))(B.index_graph(chunks(spark, d))["relations"]),
    "graph_retrieve_local": retrieved("local"),
    "graph_retrieve_global": retrieved("global"),
    "graph_retrieve_hybrid": retrieved("hybrid"),
    "graph_relationships": said,
    "graph_delete_source": without_source,
    "graph_source_report": report,
    "graph_markdown": lambda spark, d: (lambda g: B.export_markdown(g["entities"], g["relations"]))(graph(spark, d)),
    "name_semi_join": lambda spark, d: table(spark, d, "g_entity").dropDuplicates(["entity_key"]).select("entity_key", T.normalize_name(F.col("name")).alias("n")).join(table(spark, d, "g_entity").filter("size(aliases) > 0").select(F.explode("aliases").alias("a")).select(T.normalize_name(F.col("a")).alias("n")).distinct(), "n", "left_semi").select("entity_key"),
}

_L = """li AS (SELECT *, 'SUPPLIER::supplier ' || l_suppkey AS s, 'PART::part ' || l_partkey AS p, least(1.0::DOUBLE, round(0.85 + l_discount * 2, 4)) AS c, l_orderkey % 10 <> 1 AS ok FROM lineitem),
rl AS (SELECT l_orderkey::VARCHAR AS key, s AS src_key, 'SUPPLIED' AS relation, p AS dst_key, max(c) AS confidence, any_value('Part ' || l_partkey || ' came from Supplier ' || l_suppkey) AS evidence
  FROM li WHERE ok AND l_linenumber % 2 = 1 AND l_returnflag <> 'A' AND round(0.85 + l_discount * 2, 4) >= 0.9 AND l_partkey % 10 <> 0 GROUP BY ALL),
en AS (SELECT DISTINCT l_orderkey::VARCHAR AS key, s AS entity_key, 'Supplier ' || l_suppkey AS name, 'SUPPLIER' AS type, 'A supplier.' AS description, 'S-' || l_suppkey AS aliases FROM li WHERE ok
  UNION SELECT DISTINCT l_orderkey::VARCHAR, p, 'Part ' || l_partkey, 'PART', '', '' FROM li WHERE ok AND l_partkey % 10 <> 0)"""
SQL = {
    "extraction_entities": f"WITH {_L} SELECT DISTINCT entity_key, name, type, description, aliases FROM en",
    "extraction_relations": f"WITH {_L} SELECT key, src_key, relation, dst_key, round(confidence, 6) AS confidence, evidence FROM rl",
    "endpoint_resolution": f"WITH {_L} SELECT key, lower(name) AS norm, entity_key FROM en UNION SELECT key, 's ' || split_part(aliases, '-', 2), entity_key FROM en WHERE aliases <> ''",
    "graph_upsert": f"WITH {_L} SELECT src_key, relation, dst_key, round(max(confidence), 6) AS confidence, count(*) AS count, string_agg(DISTINCT 'f' || key::BIGINT % 3, ',' ORDER BY 'f' || key::BIGINT % 3) AS sources, count(DISTINCT key)::INT AS chunks, 'trade' AS keywords FROM rl GROUP BY ALL",
    "entity_upsert": """WITH e AS (SELECT DISTINCT ON (entity_key) * FROM g_entity), x AS (SELECT *, entity_key LIKE 'PERSON%' AS o, coalesce(aliases, []) AS al, regexp_replace(lower(description), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS l FROM e)
SELECT entity_key, name, CASE WHEN NOT o THEN coalesce(description, '') WHEN coalesce(description, '') = '' THEN 'Old.' WHEN contains(l, 'old.') THEN description ELSE 'Old. ' || description END AS description, array_to_string(al, '|') AS aliases FROM x""",
    "mention_upsert": f"WITH {_L} SELECT key AS chunk_key, entity_key, 2::BIGINT AS count FROM (SELECT DISTINCT key, entity_key FROM en)",
    "extraction_failures": f"""WITH {_L}, o AS (SELECT l_orderkey, any_value(ok) AS ok, count(*) AS n FROM li GROUP BY 1)
SELECT count(*) AS attempts, count(*) FILTER (NOT ok) AS failures, round(count(*) FILTER (NOT ok) / count(*), 4) AS rate, (sum(n) FILTER (ok) * 2)::BIGINT AS entities, (sum(n) FILTER (ok))::BIGINT AS relationships FROM o""",
    "extraction_gleaning": f"""WITH {_L}, f AS (SELECT l_orderkey::VARCHAR AS key, any_value(ok) AS ok, count(*) FILTER (l_linenumber <= 2) AS n, count(DISTINCT s) - count(DISTINCT s) FILTER (l_linenumber <= 2) + count(DISTINCT p) - count(DISTINCT p) FILTER (l_linenumber <= 2) AS e,
  count(DISTINCT s || (l_returnflag = 'A')::VARCHAR || p) - count(DISTINCT s || (l_returnflag = 'A')::VARCHAR || p) FILTER (l_linenumber <= 2) AS r FROM li GROUP BY 1)
SELECT key, (CASE WHEN ok THEN 2 * n + e ELSE 0 END)::INT AS entities, (CASE WHEN ok THEN n + r ELSE 0 END)::INT AS relationships FROM f WHERE n > 0""",
    "extraction_cache": "SELECT chunk_id AS chunk_key, md5('1::default::' || text) AS hash, length(text) % 2 = 0 AS cached FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) WHERE text IS NOT NULL",
    "graph_collections": f"""WITH {_L}, n AS (SELECT DISTINCT entity_key, name, type, description FROM en)
SELECT entity_key AS key, 'Entity: ' || name || ' (Type: ' || type || '). Description: ' || description AS text FROM n UNION ALL
SELECT src_key || '--' || relation || '--' || dst_key, 'Relationship: ' || a.name || ' -> ' || relation || ' -> ' || b.name || '. Description:  Keywords: trade.' FROM (SELECT DISTINCT src_key, relation, dst_key FROM rl) r JOIN n a ON a.entity_key = src_key JOIN n b ON b.entity_key = dst_key""",
}
