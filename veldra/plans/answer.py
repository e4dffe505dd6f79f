"""From hits to answers: context blocks of each structure, budgets, extractive answers, the ask and form pipelines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.operators import asking as A, prompts as P, ranking as R, state as S
from veldra.plans import retrieve as plans
from veldra.storage import stage


@dataclass(frozen=True)
class Settings:
    """What an engine is set to: weights of the legs, sizes, limits."""

    dense_weight: float = 0.70
    sparse_weight: float = 0.30
    search: int = 20
    capped: int = 10
    threshold: float = 0.30
    budget: int = 11_000
    min_overlap: float = 0.30
    validate: bool = False


ENGINE_A = Settings()
ENGINE_B = Settings(dense_weight=0.85, sparse_weight=0.15, search=13, capped=8)


def _lines(order: list[str], line: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])


def compare_block(hits: DataFrame, by: str = "unit_id", arm: str = "arm", place: str = "place") -> DataFrame:
    """``by, block``: chunks by arm, with the file and year of an arm's first chunk; arms in the order of their first."""
    h = hits.withColumn("__line", plans.chunk_text(False)).withColumn("__arm", F.when(F.coalesce(arm, F.lit("")) != "", F.col(arm)).otherwise("General"))
    head = F.concat(F.lit("\n━━━ "), F.upper("__arm"), F.lit(" ━━━\nSource: "), F.coalesce("source_file", F.lit("")), F.when(F.coalesce("doc_year", F.lit("")) != "", F.concat(F.lit("\nYear: "), "doc_year")).otherwise(""), F.lit("\n"))
    arms = h.withColumn("__head", head).groupBy(by, "__arm").agg(F.min(place).alias("at"), F.min_by("__head", place).alias("head"), _lines([place], F.col("__line")).alias("lines"))
    part = F.concat("head", F.lit("\n"), F.array_join("lines", "\n"))
    first = "=== COMPARISON CONTEXT ===\nEach section below represents one of the documents or entities being compared.\n\n"
    return arms.groupBy(by).agg(F.concat(F.lit(first), F.array_join(_lines(["at"], part), "\n"), F.lit("\n=== END OF COMPARISON CONTEXT ===")).alias("block"))


def synthesize_block(hits: DataFrame, by: str = "unit_id", place: str = "place", each: int = 2) -> DataFrame:
    """``by, block``: by document its summary and its first ``each`` chunks, documents in the order of their first chunk."""
    h = hits.withColumn("__doc", F.when(F.coalesce("doc_id", F.lit("")) != "", F.col("doc_id")).otherwise(F.col("source_file"))).withColumn("__line", plans.chunk_text(False))
    w = Window.partitionBy(by, "__doc").orderBy(place)
    h = h.withColumn("__n", F.row_number().over(w))
    summary = T.strip(F.coalesce("summary", F.lit("")))
    head = F.concat(F.lit("\n━━━ "), F.coalesce("source_file", F.lit("")), F.when(F.coalesce("doc_year", F.lit("")) != "", F.concat(F.lit(" ("), "doc_year", F.lit(")"))).otherwise(""), F.lit(" ━━━"), F.when(summary != "", F.concat(F.lit("\n[DOCUMENT SUMMARY]\n"), summary, F.lit("\n"))).otherwise(""))
    docs = h.filter(F.col("__n") <= each).withColumn("__head", head).groupBy(by, "__doc").agg(F.min(place).alias("at"), F.min_by("__head", place).alias("head"), _lines([place], F.col("__line")).alias("lines"))
    part = F.concat("head", F.lit("\n"), F.array_join("lines", "\n"))
    first = "=== SYNTHESIZED CONTEXT FROM MULTIPLE DOCUMENTS ===\nBelow are summaries and key excerpts from relevant documents.\n\n"
    return docs.groupBy(by).agg(F.concat(F.lit(first), F.array_join(_lines(["at"], part), "\n"), F.lit("\n=== END OF SYNTHESIZED CONTEXT ===")).alias("block"))


def budgeted(hits: DataFrame, structure: Column, budget: int, by: str = "unit_id", arm: str = "arm", order: tuple[str, ...] = ("place",)) -> DataFrame:
    """What fits the budget: of a comparison each arm has its equal part, other structures the whole."""
    h = hits.withColumn("__compare", F.coalesce(structure == "compare", F.lit(False))).withColumn("__arm", F.when(F.col("__compare"), F.col(arm)))
    n = h.groupBy(by).agg(F.greatest(F.count_distinct("__arm"), F.lit(1)).alias("__arms"))
    h = h.join(n, by)
    share = F.when(F.col("__compare"), F.floor(F.lit(budget) / F.col("__arms"))).otherwise(F.lit(budget))
    return R.token_budget(h, share, [F.asc(c) for c in order], [by, "__arm"]).drop("__compare", "__arm", "__arms")


def extractive_answer(hits: DataFrame, by: str = "unit_id", place: str = "place", most: int = 3) -> DataFrame:
    """``by, answer``: the first ``most`` chunks, shortened, each with its file and page."""
    page = F.when(F.coalesce("page_label", F.lit("")) != "", F.col("page_label")).otherwise(F.coalesce(F.col("page_no").cast("string"), F.lit("?")))
    line = F.concat(F.lit("- "), T.extract_answer(F.coalesce("text", F.lit(""))), F.lit(" [Source: "), F.coalesce("source_file", F.lit("Unknown")), F.lit(", Page "), page, F.lit("]"))
    h = hits.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(place))).filter(F.col("__n") <= most)
    return h.groupBy(by).agg(F.array_join(_lines(["__n"], line), "\n").alias("answer"))


def documents(hits: DataFrame, by: str = "unit_id") -> DataFrame:
    """Hits as documents for a program: ``by, place, page_content, metadata``."""
    meta = F.struct("id", "source_file", "chunk_index", "page_no", "page_label", "section", F.col("boosted").alias("retrieval_score"), "graph_score", "hits")
    return hits.select(by, "place", F.coalesce("text", F.lit("")).alias("page_content"), meta.alias("metadata"))


def ask(base: DataFrame, units: DataFrame, questions: DataFrame, chunks: DataFrame, model: Callable[[str], str] | None = None, history: DataFrame | None = None, settings: Settings = ENGINE_A) -> DataFrame:
    """``unit_id, answer, reason, confidence, sources, not_found, cache_key``: retrieval, context, answer and its checks.

    Without a model, or where it fails, the answer is made of the first chunks.
    """
    r = plans.ranked(base, units, questions, chunks, "single", k=settings.search)
    # Read for the context, the extract and the strength: staged, so that it is searched and ranked once.
    capped = stage(R.threshold_cap(r, "boosted", settings.threshold, settings.capped, "unit_id"), "capped")
    context = plans.with_missing(plans.assemble(capped, settings.budget), questions)
    j = context.join(questions.select("unit_id", "question"), "unit_id").join(extractive_answer(capped).withColumnRenamed("answer", "extract"), "unit_id", "left")
    j = j.join(capped.filter("place <= 3").groupBy("unit_id").agg(F.avg("boosted").alias("strength"), F.array_sort(F.collect_list("id")).alias("ids")), "unit_id", "left")
    talk = F.lit("") if history is None else F.col("history")
    j = j if history is None else j.join(history, "unit_id", "left")
    said = P.ask(P.generator_prompt(F.col("question"), F.col("block"), F.lit("direct"), talk), model) if model else F.lit("")
    j = j.withColumn("answer", F.coalesce(F.nullif(said, F.lit("")), "extract", F.lit("I cannot answer this based on the provided documents.")))
    overlap = T.overlap(T.answer_tokens(T.truncate_tokens(F.col("answer"), 400), 3), T.answer_tokens(F.col("block"), 3))
    fallback = F.lower("answer").contains("i cannot answer")
    reason = F.when(fallback, "empty_or_fallback").when(overlap < settings.min_overlap, "low_overlap").when(T.unseen_numbers(F.col("answer"), F.col("block")), "unseen_numbers").otherwise("passed")
    j = j.withColumn("reason", reason if settings.validate else F.lit("disabled"))
    sure = (0.55 * F.coalesce("strength", F.lit(0.0)) + 0.45 * overlap) * F.when(F.col("reason").isin("passed", "disabled", "empty_or_fallback"), 1.0).otherwise(0.55)
    key = T.answer_key(F.col("question"), F.lit(""), talk, F.lit(False), F.coalesce("ids", F.array().cast("array<string>")))
    return j.select("unit_id", "answer", "reason", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 3).alias("confidence"), "sources", "not_found", key.alias("cache_key"))


def extract_forms(texts: DataFrame, state: DataFrame, fields: DataFrame, model: Callable[[str], str], fallback: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(form values, progress) after a model was asked for the fields each session still lacks.

    ``texts``: session, text; ``state``: session, field, value; ``fields``: field. The model answers
    with JSON of fields and values; what is there already stays, placeholders fill nothing.
    """
    real = S.fill_form(state.withColumn("seq", F.lit(0)), "session", "field", "value", F.col("seq"))
    missing = texts.select("session").distinct().crossJoin(F.broadcast(fields.select("field").distinct().agg(F.collect_set("field").alias("all")))).join(real.groupBy("session").agg(F.collect_set("field").alias("own")), "session", "left")  # one row of fields
    wanted = missing.select("session", F.array_sort(F.array_except("all", F.coalesce("own", F.array().cast("array<string>")))).alias("wanted"))
    prompt = F.concat(F.lit("Give the values of these fields as a JSON object: "), F.array_join("wanted", ", "), F.lit("\n"), F.coalesce("text", F.lit("")))
    asked = texts.join(wanted, "session").filter("size(wanted) > 0")
    answer = P.first_answer(prompt, model, *([fallback] if fallback else []))
    got = asked.select("session", "wanted", F.explode(F.from_json(T.json_salvage(answer)["json"], "map<string,string>")).alias("field", "value")).filter(F.array_contains("wanted", F.col("field")))
    found = got.groupBy("session", "field").agg(F.min("value").alias("value"))
    merged = S.merge_form(state, found, "session", "field", "value")
    return merged, S.form_progress(S.fill_form(merged.withColumn("seq", F.lit(0)), "session", "field", "value", F.col("seq")), fields, "session", "field")


def by_length(df: DataFrame, size: str = "token_count", parts: int | None = None) -> DataFrame:
    """Rows in batches of like length, for models that pad; the key restores any order."""
    return (df.repartition(parts) if parts else df).sortWithinPartitions(F.coalesce(size, F.lit(0)))


def search_documents(docs: DataFrame, phrase: str, key: str = "doc_id", text: str = "text", name: str | None = None, crop: int = 180, most: int = 400) -> DataFrame:
    """``key, hits, snippets``: how often a phrase occurs without regard to case, one more if the name holds it, and the paragraphs that hold it.

    Paragraphs over ``most`` characters are cut ``crop`` around the first hit; equal snippets count once.
    """
    low = phrase.lower()
    c, n = F.lower(F.coalesce(text, F.lit(""))), F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("\\Q" + low + "\\E"))
    named = F.when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(low)), 1).otherwise(0) if name else F.lit(0)
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.contains(F.lower(p), F.lit(low)))

    def cut(p: Column) -> Column:
        at = F.instr(F.lower(p), F.lit(low))
        begin = F.greatest(at - crop, F.lit(1))
        return F.when(F.length(p) <= most, T.strip(p)).otherwise(F.concat(F.lit("..."), F.substr(p, begin, at - begin + len(low) + crop), F.lit("...")))

    return docs.filter(F.contains(c, F.lit(low)) | (named > 0)).select(key, (n + named).cast("long").alias("hits"), F.array_distinct(F.transform(parts, cut)).alias("snippets"))


def pooled_arms(base: DataFrame, units: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pools of all arms of comparisons in one table, with ``query_id, label``."""
    a = plans.arms(units, wanted)
    return A.pool(base, a.drop("query_id", "label", "slots")).join(a.select("unit_id", "query_id", "label").dropDuplicates(["unit_id"]), "unit_id")
