"""Whole retrieval plans for many questions at once: search, relax, deduplicate, rerank, boost, cap, expand, assemble.

Inputs: ``base`` (id, vector, sparse and the filter fields), ``units`` (unit_id, sub, vector, sparse,
hints: a question's or an arm's query set), ``questions`` (unit_id, question) and ``chunks``. A
plan's hits are computed once and staged where more than one step reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.models import score_column
from veldra.operators import asking as A, ranking as R
from veldra.storage import stage

LEAST, K, BUDGET, SLOTS = 0.30, 10, 1500, 10
_CHUNK = ("source_file", "chunk_index", "text", "section", "page_no", "page_label", "is_table", "chunk_year", "doc_year", "doc_id", "summary")


def word_list(text: Column) -> Column:
    """The words of a question or text that count, each once, between blanks: read once, not for each pair."""
    return F.array_join(F.array_distinct(T.answer_tokens(F.coalesce(text, F.lit("")))), " ")


def lexical_logit(question: Column, text: Column) -> Column:
    """The default score of a pair of ``word_list``s: how many of the question's words are in the text; a null has none."""
    some, words = (F.length(question) > 0) & (F.length(text) > 0), F.split(question, " ")
    return F.when(some, 10 * (F.size(F.array_intersect(words, F.split(text, " "))) / F.size(words)) - 5).otherwise(-5.0)


def ranked(base: DataFrame, units: DataFrame, questions: DataFrame, chunks: DataFrame, scope: str = "single", graph: DataFrame | None = None, scorer: Callable[[list[str], list[str]], list[float]] | None = None, k: int = 20) -> DataFrame:
    """Hits of each unit with ``score, hits, graph_score, rerank, boosted`` and their chunks' columns, one row for each chunk.

    ``graph``: candidates to merge in. Where the scorer fails, the score of the search stands in for its own.
    """
    found = A.hit_counts(A.pool(base, units, k))
    if graph is not None:
        found = A.merge_graph(found, graph, chunks)
    else:
        found = found.withColumn("graph_score", F.lit(0.0))
    hints = units.filter("sub = 0").select("unit_id", "hints").dropDuplicates(["unit_id"])
    c, asked = chunks.select(F.col("chunk_id").alias("id"), *_CHUNK), questions.select("unit_id", "question")
    if scorer is None:
        asked = asked.select("unit_id", word_list(F.col("question")).alias("question"))
        c = c.join(found.select("id").distinct(), "id", "left_semi").withColumn("__words", word_list(F.col("text")))
    # The texts come last: only what is small is sent by question.
    h = found.join(asked, "unit_id", "left").join(hints, "unit_id", "left").join(c, "id")
    logit = lexical_logit(F.col("question"), F.col("__words")) if scorer is None else score_column(F.col("question"), F.col("text"), scorer)
    h = h.withColumn("rerank", F.coalesce(F.round(R.sigmoid(logit), 6), F.col("score")))
    low = F.lower(F.coalesce("text", F.lit("")))
    words, names = F.col("hints.keywords"), F.col("hints.filename_tokens")
    amount = R.boost(
        F.col("is_table"), F.array_contains("chunk_year", F.col("hints.doc_year")), F.contains(F.lower("section"), F.lower("hints.section")), None,
        F.exists(names, lambda t: F.contains(F.lower("source_file"), F.lower(t))), F.col("hits"), F.col("graph_score"), scope,
    )
    named = F.when(words.isNull(), 0.0).when(F.exists(words, lambda w: F.contains(low, F.lower(w))), R.BOOSTS["keyword"]).otherwise(R.BOOSTS["entity_penalty"] if scope in ("single", "few") else 0.0)
    return h.withColumn("boosted", F.round(F.col("rerank") + amount + named, 8)).drop("question", "hints", "level", "__words")


def with_neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``unit_id, id, score, expanded``: hits and the chunks beside them in their files, these with the score of the first hit less 0.05."""
    h = stage(hits.select("unit_id", "id", "source_file", "chunk_index", F.col("boosted").alias("score"), F.col("place").alias("rank")), "hits")
    near = R.neighbours(h, chunks, "unit_id").select("unit_id", F.col("chunk_id").alias("id"), "score", F.lit(True).alias("expanded"))
    return h.select("unit_id", "id", "score", F.lit(False).alias("expanded")).unionByName(near)


def single(base, units, questions, chunks, **kw) -> DataFrame:
    """One document or fact: threshold, cap, neighbours."""
    return with_neighbours(R.threshold_cap(ranked(base, units, questions, chunks, "single", **kw), "boosted", LEAST, K, "unit_id"), chunks)


def broad(base, units, questions, chunks, **kw) -> DataFrame:
    """An overview: no filter, diversity over documents, neighbours."""
    free = units.withColumn("hints", A.hints_filter())
    r = R.diversity_cap(ranked(base, free, questions, chunks, "broad", **kw), 6, 4, "unit_id", "source_file", "boosted")
    placed = r.withColumn("place", F.row_number().over(Window.partitionBy("unit_id").orderBy("doc_rank", "in_doc")).cast("int"))
    return with_neighbours(placed, chunks)


def arms(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units of the arms of comparisons: ``wanted`` has query_id and ``arms`` (label, year, filename_tokens), of which 4 count.

    Gives ``unit_id`` (query and label), ``query_id, label, slots`` and the query set with the arm's filter.
    """
    w = wanted.select("query_id", F.slice("arms", 1, 4).alias("arms")).filter("size(arms) > 0").select("query_id", F.size("arms").alias("n"), F.explode("arms").alias("arm"))
    w = w.select("query_id", F.col("arm.label").alias("label"), F.greatest(F.lit(1), F.floor(F.lit(SLOTS) / F.col("n"))).cast("int").alias("slots"), A.arm_filter(F.col("arm")).alias("arm_hints"))
    u = units.withColumnRenamed("unit_id", "query_id").drop("hints").join(w, "query_id")
    return u.select(F.concat_ws("\u0001", "query_id", "label").alias("unit_id"), "query_id", "label", "slots", "sub", "vector", "sparse", F.col("arm_hints").alias("hints"))


def few(base, units, wanted, questions, chunks, **kw) -> DataFrame:
    """``query_id, arm, id, place``: the best of each arm, as many as its slots; no threshold. Questions without arms are for ``single``."""
    a = arms(units, wanted)
    names = a.select("unit_id", "query_id", "label", "slots").dropDuplicates(["unit_id"])
    asked = names.join(questions.withColumnRenamed("unit_id", "query_id"), "query_id").select("unit_id", "question")
    r = ranked(base, a.drop("query_id", "label", "slots"), asked, chunks, "few", **kw).join(names, "unit_id")
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("boosted"), "id")).cast("int"))
    return r.filter(F.col("place") <= F.col("slots")).select("query_id", F.col("label").alias("arm"), "id", "place")


def page_of(label: Column, number: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) != "", label).when(number > 0, number.cast("string")).otherwise("Unknown")


def chunk_text(show_file: bool = True, expanded: Column | None = None, weak: Column | None = None) -> Column:
    """A chunk as a context shows it: file, page, section and sort in a line, then its text."""
    sort = F.when(F.coalesce("is_table", F.lit(False)), "[TABLE]").when(expanded if expanded is not None else F.lit(False), "[EXPANDED]").otherwise("[TEXT]")
    doubt = F.when(weak if weak is not None else F.lit(False), " [LOW CONFIDENCE]").otherwise("")
    section = F.when(F.coalesce("section", F.lit("")) != "", F.col("section")).otherwise("General")
    line = F.concat(F.lit("Page "), page_of(F.col("page_label"), F.col("page_no")), F.lit(" | "), section, F.lit(" "), sort, doubt)
    if show_file:
        line = F.concat(F.lit("File: "), F.coalesce("source_file", F.lit("")), F.lit(" | "), line)
    return F.concat(line, F.lit("\n"), T.strip(F.coalesce("text", F.lit(""))), F.lit("\n"))


def relationship_block(relations: DataFrame, by: str = "query_id") -> DataFrame:
    """``by, relationships``: lines of the relations found for each question, in their order."""
    or_name = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.col(c)).otherwise(name)
    line = F.concat(F.lit("- Relationship: ["), or_name("source", "Unknown"), F.lit("] -- "), or_name("relation", "RELATION"), F.lit(" --> ["), or_name("target", "Unknown"), F.lit("]"))
    line = F.concat(line, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n  Evidence: "), "description")).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"])
    return relations.groupBy(by).agg(F.concat(F.lit("=== RELATIONSHIP EVIDENCE ===\n"), F.array_join(lines, "\n"), F.lit("\n=== END OF RELATIONSHIP EVIDENCE ===")).alias("relationships"))


def assemble(hits: DataFrame, budget: int = BUDGET, by: str = "unit_id", relations: DataFrame | None = None) -> DataFrame:
    """``by, block, chunks_used, tokens, sources, sources_count, has_tables, not_found``: a context of each unit's hits.

    Texts equal but for case and outer blanks count once; tables first, then by place; what fits
    the budget, tables in any case; grouped by file in the order of its first chunk.
    """
    h = hits.withColumn("__h", F.md5(F.lower(T.strip(F.coalesce("text", F.lit(""))))))
    h = R.dedup_max(h, [by, "__h"], [F.asc("place"), F.asc("id")]).drop("__h").withColumn("tokens", F.coalesce(T.token_count(F.col("text")), F.lit(0)))
    h = h.withColumn("first", F.when(F.coalesce("is_table", F.lit(False)), 0).otherwise(1))
    h = R.token_budget(h, budget, [F.asc("first"), F.asc("place"), F.asc("id")], [by])
    h = h.withColumn("file_at", F.min(F.struct("first", "place")).over(Window.partitionBy(by, "source_file")))
    title = F.concat(F.coalesce("source_file", F.lit("")), F.when(F.coalesce("doc_year", F.lit("")) != "", F.concat(F.lit(" ("), "doc_year", F.lit(")"))).otherwise(""))
    h = h.withColumn("line", chunk_text()).withColumn("title", title)
    files = h.groupBy(by, "source_file").agg(
        F.min("file_at").alias("at"), F.min_by("title", F.struct("first", "place")).alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("first", "place", "line"))), lambda x: x["line"]).alias("lines"),
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.coalesce(F.bool_or("is_table"), F.lit(False)).alias("tables"),
    )
    part = F.concat(F.lit("\n--- DOCUMENT: "), "title", F.lit(" ---\n"), F.array_join("lines", "\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"])
    block = F.concat(F.lit("=== KNOWLEDGE BASE CONTEXT ===\n"), F.array_join(parts, "\n"), F.lit("\n=== END OF CONTEXT ==="))
    out = files.groupBy(by).agg(block.alias("block"), F.sum("n").alias("chunks_used"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("source_file")).alias("sources"), F.count("*").alias("sources_count"), F.bool_or("tables").alias("has_tables"))
    if relations is not None:
        out = out.join(relationship_block(relations, by), by, "left").withColumn("block", F.concat("block", F.coalesce(F.concat(F.lit("\n\n"), "relationships"), F.lit("")))).drop("relationships")
    return out.withColumn("not_found", F.lit(False))


NOT_FOUND = "No relevant matches found in the knowledge base."


def with_missing(assembled: DataFrame, asked: DataFrame, by: str = "unit_id") -> DataFrame:
    """The contexts with a row, too, for each question that has none."""
    j = asked.select(by).distinct().join(assembled, by, "left")
    return j.select(by, F.coalesce("block", F.lit(NOT_FOUND)).alias("block"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_used", "tokens")), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("sources_count", F.lit(0)).alias("sources_count"), F.coalesce("has_tables", F.lit(False)).alias("has_tables"), F.col("block").isNull().alias("not_found"))


def trace(base, units, questions, chunks) -> DataFrame:
    """``unit_id, level, searched, deduplicated, over_threshold, capped, final``: rows after each stage of ``single``."""
    pooled = stage(A.pool(base, units), "pool")
    start = pooled.groupBy("unit_id").agg(F.max("level").alias("level"), F.count("*").alias("searched"), F.count_distinct("id").alias("deduplicated"))
    r = stage(ranked(base, units, questions, chunks).select("unit_id", "id", "boosted", "source_file", "chunk_index"), "ranked")
    over = r.groupBy("unit_id").agg(F.count_if(F.col("boosted") >= LEAST).alias("over_threshold"))
    final = with_neighbours(R.threshold_cap(r, "boosted", LEAST, K, "unit_id"), chunks).groupBy("unit_id").agg(F.count_if(~F.col("expanded")).alias("capped"), F.count("*").alias("final"))
    return start.join(over, "unit_id", "left").join(final, "unit_id", "left").fillna(0)
