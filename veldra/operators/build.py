"""From models' extractions to a graph kept as tables: validation, upsert, upkeep, reports.

Extractions are rows ``chunk_key, payload, text``: a model's JSON answer about a text. Vertex
and edge tables: documents, chunks, mentions, entities, relations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.operators import graph as G
from veldra.storage import stage

_TEXTS = "array<string>"
#: The shape of an extraction; keywords may be a list or one text with commas.
_ENTITIES = "array<struct<name:string,type:string,description:string,aliases:array<string>,effective_date:string,date:string,citation_text:string,citation:string>>"
_RELATIONS = "array<struct<source:string,relation:string,target:string,confidence:string,evidence:string,description:string,keywords:string>>"
EXTRACTION = f"entities {_ENTITIES}, relationships {_RELATIONS}"
_TYPE = "^[A-Z][A-Z0-9_]*$"


def _tidy(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit("")))


def parse_extractions(df: DataFrame, key: str = "chunk_key", payload: str = "payload", text: str = "text") -> DataFrame:
    """``key, text, mode, entities, relationships``: answers parsed, with the way their JSON was found; bad ones have none of either."""
    s = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), T.json_salvage(F.col(payload)).alias("s"))
    e = s.select("key", "text", F.col("s.mode").alias("mode"), F.from_json("s.json", EXTRACTION).alias("e"))
    return e.select("key", "text", "mode", F.coalesce("e.entities", F.array().cast(_ENTITIES)).alias("entities"), F.coalesce("e.relationships", F.array().cast(_RELATIONS)).alias("relationships"))


def failure_rate(parsed: DataFrame) -> DataFrame:
    """One row: ``attempts, failures, rate`` of extractions without usable JSON, and ``entities, relationships`` in all."""
    bad = F.col("mode").isin("empty", "invalid")
    return parsed.agg(
        F.count("*").alias("attempts"), F.count_if(bad).alias("failures"), F.round(F.count_if(bad) / F.greatest(F.count("*"), F.lit(1)), 4).alias("rate"),
        F.coalesce(F.sum(F.greatest(F.size("entities"), F.lit(0))), F.lit(0)).alias("entities"), F.coalesce(F.sum(F.greatest(F.size("relationships"), F.lit(0))), F.lit(0)).alias("relationships"),
    )


def valid_entities(parsed: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """One row for each entity named in an extraction: ``key, pos, name, type, name_norm, entity_key, description, aliases, effective_date, citation_text``.

    Names that come to nothing and types that aren't capitals with underscores are left
    out. ``canonical``: ``alias_norm, canonical``, learnt names of which a name is a variant.
    """
    e = parsed.select("key", F.posexplode("entities").alias("pos", "e")).select(
        "key", "pos", _tidy(F.col("e.name")).alias("name"), F.upper(_tidy(F.col("e.type"))).alias("type"), _tidy(F.col("e.description")).alias("description"),
        F.transform(F.coalesce("e.aliases", F.array().cast(_TEXTS)), _tidy).alias("aliases"),
        F.nullif(_tidy(F.coalesce("e.effective_date", "e.date")), F.lit("")).alias("effective_date"), F.nullif(_tidy(F.coalesce("e.citation_text", "e.citation")), F.lit("")).alias("citation_text"),
    )
    e = e.filter((F.col("name") != "") & F.col("type").rlike(_TYPE)).withColumn("name_norm", T.normalize_name(F.col("name"))).filter("name_norm <> ''")
    if canonical is not None:
        c = canonical.select(F.col("alias_norm").alias("name_norm"), F.col("canonical").alias("__c"))
        e = e.join(c, "name_norm", "left").withColumn("name_norm", F.coalesce("__c", "name_norm")).drop("__c")
    return e.withColumn("entity_key", F.concat_ws("::", "type", "name_norm")).select("key", "pos", "name", "type", "name_norm", "entity_key", "description", "aliases", "effective_date", "citation_text")


def _joined_descriptions(parts: Column) -> Column:
    """Descriptions in order, each that isn't contained in those before it."""
    return F.aggregate(parts, F.lit(""), lambda s, p: F.when((p == "") | F.contains(s, p), s).when(s == "", p).otherwise(F.concat_ws(" ", s, p)))


def merge_entities(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of one key as one: the first name, descriptions not contained in earlier ones joined, all aliases, the first date and citation."""
    order = F.struct(*(c for c in ("key", "pos") if c in rows.columns))
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), "description", "aliases")))
    out = rows.groupBy(*by).agg(
        F.min_by("name", order).alias("name"), F.min_by("type", order).alias("type"), F.min_by("name_norm", order).alias("name_norm"), ordered.alias("all"),
        F.min_by("effective_date", F.when(F.col("effective_date").isNotNull(), order)).alias("effective_date"), F.min_by("citation_text", F.when(F.col("citation_text").isNotNull(), order)).alias("citation_text"),
    )
    aliases = F.array_distinct(F.filter(F.flatten(F.transform("all", lambda x: x["aliases"])), lambda a: a != ""))
    return out.select(*by, "name", "type", "name_norm", _joined_descriptions(F.transform("all", lambda x: x["description"])).alias("description"), aliases.alias("aliases"), "effective_date", "citation_text")


def endpoint_names(entities: DataFrame) -> DataFrame:
    """``key, norm, entity_key``: what each name and alias in an extraction stands for; of several the last one said."""
    own = entities.select("key", "pos", "entity_key", F.explode(F.array(F.struct(F.lit(0).alias("o"), T.normalize_name(F.col("name")).alias("norm")), F.struct(F.lit(1).alias("o"), F.col("name_norm").alias("norm")))).alias("x"))
    others = entities.select("key", "pos", "entity_key", F.posexplode("aliases").alias("p", "a")).select("key", "pos", "entity_key", F.struct((F.col("p") + 2).alias("o"), T.normalize_name(F.col("a")).alias("norm")).alias("x"))
    every = own.unionByName(others).select("key", "pos", "entity_key", "x.o", "x.norm").filter("norm <> ''")
    return every.groupBy("key", "norm").agg(F.max_by("entity_key", F.struct("pos", "o")).alias("entity_key"))


def valid_relations(parsed: DataFrame, entities: DataFrame, least: float = G.LEAST_CONFIDENCE) -> DataFrame:
    """``key, pos, src_key, relation, dst_key, confidence, evidence, description, keywords`` of relations that hold.

    Their name is capitals with underscores, their ends are two known entities of the
    same extraction, they are sure enough, and their evidence stands in the text.
    """
    r = parsed.select("key", "text", F.posexplode("relationships").alias("pos", "r")).select(
        "key", "text", "pos", T.normalize_name(F.col("r.source")).alias("s"), T.normalize_name(F.col("r.target")).alias("t"), F.upper(_tidy(F.col("r.relation"))).alias("relation"),
        F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(1.0)).alias("confidence"),
        _tidy(F.col("r.evidence")).alias("evidence"), _tidy(F.col("r.description")).alias("description"), F.col("r.keywords").alias("kw"),
    )
    r = r.filter(F.col("relation").rlike(G.RELATION_NAME) & (F.col("confidence") >= least) & (F.col("evidence") != "") & T.evidence_supported(F.col("evidence"), F.col("text")))
    names = endpoint_names(entities)
    for side, end in (("s", "src_key"), ("t", "dst_key")):
        r = r.join(names.select("key", F.col("norm").alias(side), F.col("entity_key").alias(end)), ["key", side])
    words = F.when(F.col("kw").startswith("["), F.from_json("kw", _TEXTS)).otherwise(F.split("kw", ","))
    words = F.filter(F.transform(F.coalesce(words, F.array().cast(_TEXTS)), lambda k: T.strip(F.lower(k))), lambda k: k != "")
    return r.filter("src_key <> dst_key").select("key", "pos", "src_key", "relation", "dst_key", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), "evidence", "description", F.array_distinct(words).alias("keywords"))


def gleaned(first: DataFrame, second: DataFrame) -> DataFrame:
    """Parsed extractions of a first pass with what only the second pass found: entities by name, relationships by ends and name."""
    names = lambda es: F.transform(es, lambda e: F.lower(_tidy(e["name"])))
    key = lambda r: F.concat_ws("\u0001", F.lower(_tidy(r["source"])), F.upper(_tidy(r["relation"])), F.lower(_tidy(r["target"])))
    j = first.join(second.select("key", F.col("entities").alias("e2"), F.col("relationships").alias("r2")), "key", "left")
    none_e, none_r = F.array().cast(_ENTITIES), F.array().cast(_RELATIONS)
    es, rs = F.col("entities"), F.col("relationships")
    # Of equal names in the second pass the first counts.
    fresh_e = F.filter("e2", lambda e, i: ~F.array_contains(F.concat(names(es), names(F.slice("e2", 1, i))), F.lower(_tidy(e["name"]))))
    fresh_r = F.filter("r2", lambda r, i: ~F.array_contains(F.concat(F.transform(rs, key), F.transform(F.slice("r2", 1, i), key)), key(r)))
    return j.select("key", "text", "mode", F.concat(es, F.coalesce(fresh_e, none_e)).alias("entities"), F.concat(rs, F.coalesce(fresh_r, none_r)).alias("relationships"))


def chunk_relations(rows: DataFrame) -> DataFrame:
    """Relations of one extraction that say the same as one: the highest confidence, different evidence and descriptions joined, all keywords."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "evidence", "description", "keywords")))
    g = rows.groupBy("key", "src_key", "relation", "dst_key").agg(F.max("confidence").alias("confidence"), ordered.alias("all"))

    def texts(name: str, sep: str) -> Column:
        return F.array_join(F.array_distinct(F.filter(F.transform("all", lambda x: x[name]), lambda x: x != "")), sep)

    words = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: x["keywords"]))))
    return g.select("key", "src_key", "relation", "dst_key", "confidence", texts("evidence", " | ").alias("evidence"), texts("description", " ").alias("description"), words.alias("keywords"))


def upsert_nodes(state: DataFrame | None, new: DataFrame, key: str, at: str) -> DataFrame:
    """Nodes by key, the latest row of each."""
    rows = new if state is None else state.unionByName(new)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter("__n = 1").drop("__n")


def upsert_mentions(state: DataFrame | None, new: DataFrame) -> DataFrame:
    """``chunk_key, entity_key, count``: counts grow by the mentions that are new."""
    counted = new.groupBy("chunk_key", "entity_key").agg(F.count("*").alias("count"))
    if state is None:
        return counted
    return state.select("chunk_key", "entity_key", "count").unionByName(counted).groupBy("chunk_key", "entity_key").agg(F.sum("count").alias("count"))


def upsert_entities(state: DataFrame | None, new: DataFrame, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Entities by key: what the state knows stays (name, type, date, citation), aliases are replaced where equal and else added, descriptions merged."""
    fields = ["entity_key", "name", "name_norm", "type", "description", "aliases", "effective_date", "citation_text"]
    if state is None:
        return new.select(*fields)
    o, n = state.select(*fields).alias("o"), new.select(*fields).alias("n")
    j = o.join(n, F.col("o.entity_key") == F.col("n.entity_key"), "full_outer")
    first = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    none = F.array().cast(_TEXTS)
    aliases = G.merge_aliases(F.coalesce("o.aliases", none), F.coalesce("n.aliases", none))
    described = F.when(F.col("n.entity_key").isNull(), F.col("o.description")).otherwise(T.merge_descriptions(F.col("o.description"), F.col("n.description"), merge=merge))
    return j.select(first("entity_key"), first("name"), first("name_norm"), first("type"), described.alias("description"), aliases.alias("aliases"), first("effective_date"), first("citation_text"))


def upsert_relations(state: DataFrame | None, new: DataFrame, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Relations by both ends and name: count grows by the extractions, the highest confidence and the first evidence stay, sources, chunks, pages and keywords are added.

    ``new``: chunk_relations with ``source, chunk_id, page``, a row for each extraction.
    """
    by = ["src_key", "relation", "dst_key"]
    order = F.struct("key")
    every = F.array_sort(F.collect_list(F.struct("key", "description")))
    g = new.groupBy(*by).agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("count"), F.coalesce(F.min_by("evidence", F.when(F.col("evidence") != "", order)), F.lit("")).alias("evidence"),
        *(F.array_sort(F.collect_set(c)).alias(a) for c, a in (("source", "sources"), ("chunk_id", "chunk_ids"), ("page", "pages"))),
        F.aggregate(every, F.lit(""), lambda s, x: T.merge_descriptions(s, x["description"], merge=merge)).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"),
    )
    if state is None:
        return g
    o, n = state.select(*g.columns).alias("o"), g.alias("n")
    j = o.join(n, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in by], "full_outer")
    none = F.array().cast(_TEXTS)
    added = lambda c: F.array_union(F.coalesce(f"o.{c}", none), F.coalesce(f"n.{c}", none)).alias(c)
    described = F.when(F.col("n.src_key").isNull(), F.col("o.description")).otherwise(T.merge_descriptions(F.col("o.description"), F.col("n.description"), merge=merge))
    return j.select(
        *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in by),
        F.greatest("o.confidence", "n.confidence").alias("confidence"), (F.coalesce("o.count", F.lit(0)) + F.coalesce("n.count", F.lit(0))).alias("count"),
        F.coalesce(F.nullif("o.evidence", F.lit("")), "n.evidence", "o.evidence").alias("evidence"), added("sources"), added("chunk_ids"), added("pages"), described.alias("description"), added("keywords"),
    )


def default_extract(text: str) -> str:
    """A stand-in for a model, by rule: capitalised phrases as entities, neighbours in a sentence as relations with the sentence as evidence."""
    import json
    import re

    entities, relations = {}, []
    for sentence in re.split(r"(?<=[.?!])\s+|\n+", text or ""):
        names = [m.group(0) for m in re.finditer(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+", sentence)]
        for n in names:
            entities.setdefault(n, {"name": n, "type": "NAME", "description": "", "aliases": []})
        relations += [{"source": a, "relation": "NAMED_WITH", "target": b, "confidence": 0.95, "evidence": sentence.strip(), "keywords": ["named"]} for a, b in zip(names, names[1:]) if a != b]
    return json.dumps({"entities": list(entities.values()), "relationships": relations})


def extract(chunks: DataFrame, model: Callable[[str], str] | None = None, key: str = "chunk_key", text: str = "text") -> DataFrame:
    """``chunk_key, text, payload``: a model's answer about each text (by default a rule's); '' where it fails."""
    ask = model or default_extract

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["text"]:
                try:
                    out.append(ask(t))
                except Exception:  # noqa: BLE001
                    out.append("")
            yield batch.assign(payload=out)

    return chunks.select(F.col(key).alias("chunk_key"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, "chunk_key string, text string, payload string")


def cache_key(text: Column, version: str, config: str) -> Column:
    return F.md5(F.concat_ws("::", F.lit(version), F.lit(config), F.coalesce(text, F.lit(""))))


def extract_new(chunks: DataFrame, cache: DataFrame | None, model: Callable[[str], str] | None = None, version: str = "1", config: str = "default", text: str = "text") -> DataFrame:
    """``chunk_key, text, payload, hash, cached``: answers known by the hash of the text come from the cache, the model is asked for the rest only, each text once."""
    own = chunks.select("chunk_key", F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", cache_key(F.col("text"), version, config))
    if cache is None:
        known = own.limit(0).select("hash", F.lit("").alias("payload"))
    else:
        known = cache.select("hash", "payload").dropDuplicates(["hash"])
    asked = own.join(known, "hash", "left_anti").groupBy("hash").agg(F.first("text").alias("text"))
    asked = extract(asked, model, "hash").select(F.col("chunk_key").alias("hash"), "payload", F.lit(False).alias("cached"))
    return own.join(known.withColumn("cached", F.lit(True)).unionByName(asked), "hash").select("chunk_key", "text", "payload", "hash", "cached")


def index_graph(chunks: DataFrame, model: Callable[[str], str] | None = None, cache: DataFrame | None = None, state: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Chunks to a graph: eligible ones, answers (cached or asked), validation, upsert into ``state``.

    ``chunks``: chunk_id, text, source_file, page_label, section, file_hash. Gives the tables
    ``documents, chunks, entities, mentions, relations`` and ``extractions``, ``stats``.
    """
    state = state or {}
    own = chunks.filter(T.graph_eligible(F.col("text"), 180, F.col("chunk_id")))
    source, file_hash = F.coalesce("source_file", F.lit("Unknown")), F.coalesce(F.nullif("file_hash", F.lit("")), "source_file", F.lit("Unknown"))
    own = own.select(
        F.concat_ws("::", file_hash, source, "chunk_id").alias("chunk_key"), "chunk_id", source.alias("source"), file_hash.alias("file_hash"),
        F.coalesce(F.nullif("page_label", F.lit("")), F.lit("1")).alias("page"), F.coalesce("section", F.lit("")).alias("section"), "text",
    )
    # Read by several of the tables below: staged, so that the model is asked once.
    answers = stage(extract_new(own, cache, model), "answers")
    parsed = stage(parse_extractions(answers), "parsed")
    entities = stage(valid_entities(parsed), "named")
    relations = chunk_relations(valid_relations(parsed, entities)).join(own.select(F.col("chunk_key").alias("key"), "source", "chunk_id", "page"), "key")
    return {
        "documents": upsert_nodes(state.get("documents"), own.groupBy("file_hash").agg(F.max("source").alias("source")), "file_hash", "source"),
        "chunks": upsert_nodes(state.get("chunks"), own, "chunk_key", "text"),
        "entities": upsert_entities(state.get("entities"), merge_entities(entities, ["entity_key"])),
        "mentions": upsert_mentions(state.get("mentions"), entities.select(F.col("key").alias("chunk_key"), "entity_key").distinct()),
        "relations": upsert_relations(state.get("relations"), relations),
        "extractions": answers,
        "stats": failure_rate(parsed),
    }


def delete_source(graph: dict[str, DataFrame], source: Column) -> dict[str, DataFrame]:
    """The graph without the chunks of a source, and then without the entities that nothing mentions and their relations."""
    chunks = graph["chunks"].filter(~F.coalesce(source, F.lit(False)))
    mentions = graph["mentions"].join(chunks.select("chunk_key"), "chunk_key", "left_semi")
    return {**graph, "documents": graph["documents"].join(chunks.select("file_hash").distinct(), "file_hash", "left_semi"), "chunks": chunks, "mentions": mentions, **drop_orphans(graph["entities"], graph["relations"], mentions)}


def drop_orphans(entities: DataFrame, relations: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """``entities`` that are mentioned, and the ``relations`` both ends of which are left."""
    kept = entities.join(mentions.select("entity_key").distinct(), "entity_key", "left_semi")
    keys = kept.select(F.col("entity_key").alias("__k"))
    r = relations.join(keys, relations["src_key"] == F.col("__k"), "left_semi").join(keys, relations["dst_key"] == F.col("__k"), "left_semi")
    return {"entities": kept, "relations": r}


def entity_text(name: Column, type_: Column, description: Column) -> Column:
    """What stands for an entity in its vector collection."""
    return F.concat(F.lit("Entity: "), F.coalesce(name, F.lit("")), F.lit(" (Type: "), F.coalesce(type_, F.lit("")), F.lit("). Description: "), F.coalesce(description, F.lit("")))


def relation_text(source: Column, relation: Column, target: Column, description: Column, keywords: Column) -> Column:
    words = F.when(F.size(keywords) > 0, F.concat(F.lit(" Keywords: "), F.array_join(keywords, ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit("Relationship: "), F.concat_ws(" -> ", source, relation, target), F.lit(". Description: "), F.coalesce(description, F.lit("")), words)


def collections(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The two vector collections of a graph, built anew: ``entity_key, text`` and ``relationship_key, text``."""
    e = graph["entities"]
    named = e.select("entity_key", "name")
    r = graph["relations"].join(named.toDF("src_key", "s"), "src_key").join(named.toDF("dst_key", "t"), "dst_key")
    return {
        "entities": e.select("entity_key", entity_text(F.col("name"), F.col("type"), F.col("description")).alias("text")),
        "relationships": r.select(F.concat_ws("--", "src_key", "relation", "dst_key").alias("relationship_key"), relation_text(F.col("s"), F.col("relation"), F.col("t"), F.col("description"), F.col("keywords")).alias("text")),
    }


def export_markdown(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``part, place, line``: tables of entities by type and name and of relations by source and name, a row a line.

    Lines are sorted over the cluster and numbered by parts, so no task holds them all.
    """
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\n|]", " "), F.lit(""))
    named = entities.select(F.col("entity_key").alias("k"), F.coalesce("name", F.lit("")).alias("n"))
    e = entities.select(F.lit("entities").alias("part"), F.struct(F.coalesce("type", F.lit("")), F.coalesce("name", F.lit("")), "entity_key").alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", cell("name"), cell("type"), cell("description")), F.lit(" |")).alias("line"))
    r = relations.join(named.toDF("src_key", "s"), "src_key").join(named.toDF("dst_key", "t"), "dst_key")
    r = r.select(F.lit("relations").alias("part"), F.struct("s", "relation", "t").alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", cell("s"), "relation", cell("t"), cell("evidence")), F.lit(" |")).alias("line"))
    e, r = (x.withColumn("o", F.concat_ws("\u0001", *(F.col(f"o.{f.name}") for f in x.schema["o"].dataType.fields))) for x in (e, r))
    return e.unionByName(r).orderBy("part", "o", "line").select("part", "line")


def source_report(graph: dict[str, DataFrame], source: str) -> DataFrame:
    """``kind, value`` of one source: its chunks, the entities they mention, and the relations that name it among their sources."""
    c = graph["chunks"].filter(F.col("source") == source)
    m = graph["mentions"].join(c.select("chunk_key"), "chunk_key", "left_semi").select("entity_key").distinct()
    e = graph["entities"].join(m, "entity_key", "left_semi")
    r = graph["relations"].filter(F.array_contains("sources", source))
    return (
        c.select(F.lit("chunk").alias("kind"), F.concat_ws(" | ", "chunk_id", "page", "section", F.length("text").cast("string")).alias("value"))
        .unionByName(e.select(F.lit("entity"), F.concat_ws(" | ", "name", "type", F.array_join("aliases", ", "), "entity_key")).toDF("kind", "value"))
        .unionByName(r.select(F.lit("relation"), F.concat_ws(" | ", "src_key", "relation", "dst_key", F.round("confidence", 2).cast("string"), "evidence")).toDF("kind", "value"))
        .orderBy("kind", "value")
    )


def retrieve(graph: dict[str, DataFrame], keys: DataFrame, mode: str = "local", hops: int = 3, most: int = 40, edges_most: int = 50, top: int = 30, top_chunks: int = 15) -> tuple[DataFrame, DataFrame]:
    """(candidates ``query_id, source, chunk_id, score, hops, path``; relationships ``query_id, source, relation, target, description``).

    ``keys``: query_id, entity_key (the start of a search). local: trails of up to ``hops`` edges from
    a query's entities (mentions count as edges), then the chunks that mention where they end,
    shortest first, ``most`` rows; global: the chunks of the starts of the most counted relations;
    hybrid: both. A candidate has the score of its first trail; others are added to its path.
    """
    r, m, c = graph["relations"], graph["mentions"], graph["chunks"]
    named = graph["entities"].select("entity_key", F.coalesce("name", "name_norm", F.lit("")).alias("name"))
    queries = keys.select("query_id").distinct()
    rel = r.join(named.toDF("src_key", "s"), "src_key").join(named.toDF("dst_key", "t"), "dst_key").select("src_key", "dst_key", "relation", "count", "confidence", F.coalesce("description", F.lit("")).alias("description"), F.col("s").alias("source"), F.col("t").alias("target"))
    found, texts = [], []
    if mode in ("local", "hybrid"):
        k = keys.select("query_id", "entity_key").distinct()
        near = rel.join(k, rel["src_key"] == k["entity_key"]).unionByName(rel.join(k, rel["dst_key"] == k["entity_key"])).select("query_id", "source", "relation", "target", "description").distinct()
        texts.append(_first(near, ["query_id"], [F.asc(x) for x in ("source", "relation", "target", "description")], edges_most).withColumn("o", F.lit(0)))
        edges = rel.select(F.concat_ws("--", "src_key", "relation", "dst_key").alias("edge_id"), F.col("src_key").alias("src"), F.col("dst_key").alias("dst"), F.col("relation").alias("kind"), "confidence", "count")
        edges = edges.unionByName(m.select(F.concat_ws("--", "chunk_key", F.lit("MENTIONS"), "entity_key").alias("edge_id"), F.col("chunk_key").alias("src"), F.col("entity_key").alias("dst"), F.lit("MENTIONS").alias("kind"), F.lit(1.0).alias("confidence"), "count"))
        edges = edges.withColumn("strength", G.edge_strength(F.col("confidence"), F.col("count")))
        names = named.unionByName(c.select(F.col("chunk_key").alias("entity_key"), F.lit("").alias("name")))
        trails = G.khop(edges, k.select(F.struct("query_id", "entity_key").alias("seed"), F.col("entity_key").alias("start")), hops, names, "kind")
        ends = trails.join(m.select("chunk_key", F.col("entity_key").alias("node")), "node").join(c.select("chunk_key", "source", "chunk_id"), "chunk_key")
        ends = ends.select(F.col("seed.query_id").alias("query_id"), "source", "chunk_id", "hops", F.array_min("strengths").alias("strength"), F.col("text").alias("path"))
        found.append(_first(ends, ["query_id"], [F.asc(x) for x in ("hops", "path", "source", "chunk_id")], most))
    if mode in ("global", "hybrid"):
        ordered = [F.desc("count"), F.asc("src_key"), F.asc("relation"), F.asc("dst_key")]
        best = rel.orderBy(*ordered).limit(top)
        texts.append(queries.crossJoin(F.broadcast(best)).select("query_id", "source", "relation", "target", "description", F.lit(1).alias("o")))  # at most ``top`` rows
        starts = rel.orderBy(*ordered).limit(top_chunks)
        ends = m.withColumnRenamed("count", "mentions").join(F.broadcast(starts), m["entity_key"] == starts["src_key"]).join(c.select("chunk_key", F.col("source").alias("file"), "chunk_id"), "chunk_key")
        path = F.concat(F.lit("("), "source", F.lit(") --["), "relation", F.lit("]--> ("), "target", F.lit(")"))
        ends = ends.select(F.col("file").alias("source"), "chunk_id", F.lit(1).alias("hops"), G.edge_strength(F.col("confidence"), F.col("count")).alias("strength"), path.alias("path"), "count")
        ends = ends.orderBy(F.desc("count"), "path", "source", "chunk_id").limit(most).drop("count")
        found.append(queries.crossJoin(F.broadcast(ends)))  # at most ``most`` rows
    rows = found[0] if len(found) == 1 else found[0].withColumn("o", F.lit(0)).unionByName(found[1].withColumn("o", F.lit(1)))
    rows = rows if "o" in rows.columns else rows.withColumn("o", F.lit(0))
    paths = F.array_sort(F.collect_list(F.struct("o", "hops", "path", F.round(G.hop_decay(F.col("hops")) * F.col("strength"), 6).alias("score"))))  # at most 2 * ``most`` of a query
    got = rows.groupBy("query_id", "source", "chunk_id").agg(paths.alias("p"))
    got = got.select("query_id", "source", "chunk_id", F.element_at("p", 1)["score"].alias("score"), F.element_at("p", 1)["hops"].alias("hops"), F.array_join(F.array_distinct(F.transform("p", lambda x: x["path"])), " | ").alias("path"))
    said = texts[0]
    for t in texts[1:]:
        said = said.unionByName(t)
    said = said.groupBy("query_id", "source", "relation", "target", "description").agg(F.min("o").alias("place"))
    return got, said


def _first(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
