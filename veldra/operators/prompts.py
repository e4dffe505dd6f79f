"""Prompts as columns, models as injected functions, and their answers read with defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from veldra.functions import text as T

#: Characters of a text that a graph prompt shows.
SHOWN = 5000
_LINES = "\n"


def fill(template: str, **values: Column) -> Column:
    """A template with ``{{name}}`` places filled from columns; null values and unknown names are empty."""
    import re

    parts = re.split(r"\{\{(\w+)\}\}", template)
    cols = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("") for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols) if cols else F.lit("")


CLEANER = _LINES.join((
    "Analyse the question for a document search and answer with one JSON object.",
    "improved_query: the question, complete and free of typing errors.",
    "target_scope: single (one document), few (a comparison) or broad.",
    "answer_structure: direct, compare or synthesize.",
    "specificity: low, medium or high.",
    "filter_hints: doc_year, section, keywords, filename_tokens, source_file, only where the question names them.",
    "comparison_arms: for few, up to 4 objects of label, year, filename_tokens.",
    "subqueries: up to {{most}} objects of query, each a part of the question.",
    "Question: {{question}}",
))
GENERATOR = _LINES.join((
    "Answer the question from the context alone, in the form: {{structure}}.",
    "After each statement name its place as [file, Page n]. If the context has no answer, say: I cannot answer this based on the provided documents.",
    "Conversation so far:",
    "{{history}}",
    "Context:",
    "{{context}}",
    "Question: {{question}}",
))
GRAPH = _LINES.join((
    "List the entities and relationships of the text as a JSON object with entities (name, type in capitals, description, aliases, effective_date, citation_text) and relationships (source, relation in capitals, target, confidence from 0 to 1, evidence quoted from the text, description, keywords).",
    "Preferred types: {{types}}",
    "Text {{key}}:",
    "{{text}}",
))
GLEANING = _LINES.join(("Below is a text and what was found in it. List, in the same form, only the entities and relationships that were missed.", "Found: {{found}}", "Text {{key}}:", "{{text}}"))
REPAIR = _LINES.join(("The following was to be JSON of entities and relationships. Give it back as valid JSON, nothing else.", "{{answer}}"))
QUERY_ENTITIES = _LINES.join(("List the entities that the question names as a JSON object with entities (name, type in capitals).", "Question: {{question}}"))


def cleaner_prompt(question: Column, most: int = 5) -> Column:
    return fill(CLEANER, question=question, most=F.lit(most))


def generator_prompt(question: Column, context: Column, structure: Column, history: Column) -> Column:
    return fill(GENERATOR, question=question, context=context, structure=structure, history=history)


def graph_prompt(key: Column, text: Column, types: Column) -> Column:
    return fill(GRAPH, key=key, text=F.left(text, F.lit(SHOWN)), types=types)


def batch_prompt(rows: Column, types: Column) -> Column:
    """One prompt for an array of struct(key, text): the answers are to be an object by key."""
    texts = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("Text "), r["key"], F.lit(":\n"), F.left(r["text"], F.lit(SHOWN)))), "\n\n")
    return fill(GRAPH.replace("as a JSON object with", "of each text as a JSON object by the text's key, each with").replace("Text {{key}}:\n{{text}}", "{{texts}}"), texts=texts, types=types)


def gleaning_prompt(key: Column, text: Column, found: Column) -> Column:
    return fill(GLEANING, key=key, text=F.left(text, F.lit(SHOWN)), found=found)


def ask(prompt: Column, model: Callable[[str], str], retries: int = 1) -> Column:
    """A model's answer to each prompt; '' where it fails ``retries`` times more, or the prompt is null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for p in batch:
                answer = ""
                for _ in range(retries + 1 if p is not None else 0):
                    try:
                        answer = str(model(p))
                        break
                    except Exception:  # noqa: BLE001
                        continue
                out.append(answer)
            yield pd.Series(out, dtype="object")

    return run(prompt)


def first_answer(prompt: Column, *models: Callable[[str], str]) -> Column:
    """The first answer that isn't empty, of several models in turn."""
    return F.coalesce(*(F.nullif(ask(prompt, m), F.lit("")) for m in models), F.lit(""))


CLEANED = (
    "struct<improved_query:string,detected_language:string,target_scope:string,answer_structure:string,specificity:string,"
    "filter_hints:struct<doc_year:string,section:string,keywords:array<string>,filename_tokens:array<string>,source_file:string,source:string>,"
    "comparison_arms:array<struct<label:string,year:string,filename_tokens:array<string>>>,subqueries:array<struct<query:string>>>"
)


def cleaned_query(question: Column, answer: Column) -> Column:
    """A cleaner's answer as a struct; what it lacks, or all of it if it is no JSON, has its default (broad, direct, low, no hints).

    Thoughts between think tags are cut and fences taken off first; of the arms 4 are kept, as the rule says.
    """
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?(</think>|$)", "")
    got = F.from_json(T.json_salvage(plain)["json"], CLEANED)

    def or_default(field: str, value: Column) -> Column:
        return F.coalesce(got[field], value).alias(field)

    none_arms = F.array().cast("array<struct<label:string,year:string,filename_tokens:array<string>>>")
    return F.struct(
        question.alias("original_query"), or_default("improved_query", question), or_default("detected_language", F.lit("english")), or_default("target_scope", F.lit("broad")),
        or_default("answer_structure", F.lit("direct")), or_default("specificity", F.lit("low")), got["filter_hints"].alias("filter_hints"),
        F.slice(F.coalesce(got["comparison_arms"], none_arms), 1, 4).alias("comparison_arms"), or_default("subqueries", F.array().cast("array<struct<query:string>>")),
    )


def query_entities(question: Column, most: int = 8) -> Column:
    """Names in a question, by rule: ``section n``, then words that aren't too general, each once."""
    sections = F.transform(F.regexp_extract_all(question, F.lit(r"(?i)\b(section\s+\d+[a-z]?)\b"), F.lit(1)), T.normalize_name)
    words = F.transform(F.regexp_extract_all(question, F.lit(r"([A-Za-z][A-Za-z0-9&.\-]{2,})"), F.lit(1)), T.normalize_name)
    words = F.filter(words, lambda t: (t != "") & ~t.isin(*T.GENERIC_QUERY_TERMS))
    return F.slice(F.array_distinct(F.concat(sections, words)), 1, most)
