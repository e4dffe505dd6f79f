"""Text functions over the documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veldra.functions import text as T
from veldra.operators import prompts as P
from veldra.tables import chunks, table


def _docs(make):
    """A query of one value per document."""
    return lambda spark, d: table(spark, d, "documents").select("doc_id", make(F.col("text")).alias("value"))


def _chunks(make):
    return lambda spark, d: chunks(spark, d).select("chunk_id", make(F.col("text")).alias("value"))


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


QUERIES = {
    "token_count": _docs(T.token_count),
    "truncate_tokens": _docs(lambda c: T.truncate_tokens(c, 50)),
    "extract_years": _docs(lambda c: _joined(T.years(c))),
    "chunk_keywords": _chunks(lambda c: _joined(T.keywords(c))),
    "sanitize_whitespace": _docs(T.sanitize_whitespace),
    "clean_noise": _docs(T.clean_noise),
    "embeddable_filter": lambda spark, d: table(spark, d, "chunks").filter(T.embeddable(F.col("text"), F.col("is_table"))).select("chunk_id").distinct(),
    "graph_eligible": _docs(lambda c: F.coalesce(T.graph_eligible(c), F.lit(False))),
    "fingerprint": _docs(T.fingerprint),
    "shingles": _docs(lambda c: F.md5(F.array_join(T.shingles(c), "|"))),
    "heading_level": lambda spark, d: table(spark, d, "blocks").distinct().filter("block_type = 'heading'").select("doc_id", "block_index", T.heading_level(F.col("content")).alias("level")),
    "sentence_split": _docs(lambda c: _joined(T.sentences(c))),
    "normalize_name": lambda spark, d: table(spark, d, "g_entity").select("entity_key", T.normalize_name(F.col("name")).alias("value")).distinct(),
    "filename_tokens": lambda spark, d: table(spark, d, "documents_meta").select("doc_id", _joined(T.filename_tokens(F.col("file_name"))).alias("value")).distinct(),
    "chunk_ids": lambda spark, d: chunks(spark, d).select("chunk_id", F.substring(F.md5(F.concat(F.coalesce("doc_id", F.lit("")), F.coalesce(F.col("chunk_index").cast("string"), F.lit("")))), 1, 12).alias("value")),
    "doc_ids": lambda spark, d: table(spark, d, "documents_meta").distinct().select("doc_id", F.substring(F.md5(F.concat(F.coalesce("file_name", F.lit("")), F.coalesce(F.round("file_size_kb", 2).cast("decimal(18,2)").cast("string"), F.lit("")))), 1, 12).alias("value")),
    "point_ids": lambda spark, d: chunks(spark, d).select("chunk_id", T.uuid5(F.concat_ws("::", F.coalesce("source_file", F.lit("")), F.coalesce(F.col("chunk_index").cast("string"), F.lit("")))).alias("value")),
    "cache_key": lambda spark, d: chunks(spark, d).select("chunk_id", T.answer_key(F.col("text"), F.col("section"), F.col("summary"), F.col("is_table"), F.array("chunk_id", "doc_id")).alias("value")),
    "description_merge": lambda spark, d: table(spark, d, "g_entity").dropDuplicates(["entity_key"]).select("entity_key", T.merge_descriptions(F.col("description"), F.col("citation_text")).alias("value")),
    "markdown_cleaning": lambda spark, d: table(spark, d, "blocks").distinct().select("doc_id", "block_index", T.clean_markdown(F.col("content")).alias("value")),
    "session_title": lambda spark, d: table(spark, d, "history").select("message_id", T.session_title(F.col("content")).alias("value")).distinct(),
    "extractive_answer": _docs(T.extract_answer),
    "summary_excerpt": _docs(lambda c: F.when(F.length(c) <= 5000, c).otherwise(F.concat(F.substring(c, 1, 3500), F.lit("\n...\n"), F.substr(c, F.floor(F.length(c) / 2).cast("int") + 1, F.lit(1500))))),
    "prefix_passage": _docs(lambda c: F.concat(F.lit("passage: "), c)),
    "query_entities": lambda spark, d: table(spark, d, "benchmark").select("item_id", _joined(P.query_entities(F.col("text"))).alias("value")),
}

_S = r"[ \t\n\r\f\x0B]"
_W = rf"regexp_extract_all({{c}}, '([^ \t\n\r\f\x0B]+)', 1)"
_T = "regexp_extract_all({c}, '([A-Za-z0-9_]+)', 1)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _doc_sql(value: str) -> str:
    return f"SELECT doc_id, {value} AS value FROM documents"


def normalize_sql(c: str) -> str:
    c = _strip(rf"regexp_replace(lower(coalesce({c}, '')), '^(the|ld\.|hon''ble|learned|mr\.|ms\.)\s+', '')")
    c = f"replace({c}, '&', ' and ')"
    c = rf"regexp_replace({c}, '(^|[^a-z0-9_])sec\.?\s+', '\1section ', 'g')"
    c = rf"regexp_replace({c}, '(^|[^a-z0-9_])s\.\s*([0-9]+)', '\1section \2', 'g')"
    return f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"


_NOISE = "text"
for _p, _flags in ((r"[\x{0900}-\x{097F}]+", "g"), (r"(?im)^page\s+[0-9]+\s+of\s+[0-9]+$", "g"), (r"(?im)^[0-9]+\s*\|\s*page$", "g"), (r"(?im)^-\s*[0-9]+\s*-$", "g"), (r"(?im)^(confidential|draft|internal use only|proprietary)[^\n]*$", "g"), (r"(?im)^([A-Z]{4,}[ \t]*){2,}$", "g"), (r"(?m)^[ \t]*[0-9]+[ \t]*$", "g")):
    _NOISE = f"regexp_replace({_NOISE}, '{_p}', '', '{_flags}')"

# The signs of entities with their word boundaries spelt out: here a boundary is one of ASCII words only, in the rule one of all letters.
_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_SIGNALS = (_L + "[A-Z]{2,}" + _R, "(?i)" + _L + r"Section\s+[0-9]+", "(?i)" + _L + r"Rule\s+[0-9]+", "(?i)" + _L + r"Act,?\s*[0-9]{4}" + _R, _L + r"[A-Z][a-z]+\s+[A-Z][a-z]+" + _R)

SQL = {
    "token_count": _doc_sql(f"len({_W.format(c='text')})"),
    "truncate_tokens": _doc_sql(f"array_to_string(({_W.format(c='text')})[1:50], ' ')"),
    "extract_years": _doc_sql(f"array_to_string(list_sort(list_distinct(list_filter({_T.format(c='text')}, lambda t: regexp_full_match(t, '(19|20)[0-9]{{2}}')))), '|')"),
    "chunk_keywords": f"SELECT chunk_id, array_to_string((list_sort(list_distinct(list_filter({_T.format(c='lower(text)')}, lambda t: regexp_full_match(t, '[a-z]{{3,}}') AND NOT list_contains({_list(T.KEYWORD_STOP_WORDS)}, t)))))[1:25], '|') AS value FROM (SELECT DISTINCT * FROM chunks)",
    "sanitize_whitespace": _doc_sql(_strip(f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '(?is)Signature Not Verified.*?(?:Reason:|Date:).*?[0-9]{{4}}[^\\n]*', '', 'g'), '(?is)Digitally signed by.*?(?:Date:|Reason:).*?[0-9]{{4}}[^\\n]*', '', 'g'), chr(10)), lambda x: {_strip('CASE WHEN contains(x, chr(124)) THEN x ELSE regexp_replace(x, chr(32) || chr(123) || chr(51) || chr(44) || chr(125), chr(32), chr(103)) END')}), chr(10))")),
    "clean_noise": _doc_sql(_strip(f"regexp_replace({_NOISE}, '\\n{{3,}}', chr(10) || chr(10), 'g')")),
    "embeddable_filter": f"""
SELECT DISTINCT chunk_id FROM (SELECT chunk_id, is_table, {_strip('text')} AS s FROM chunks)
WHERE coalesce(is_table, false) OR (len(list_filter(string_split(s, chr(10)), lambda x: {_strip('x')} <> '' AND NOT starts_with({_strip('x')}, '#'))) > 0
  AND CASE WHEN regexp_matches(s, '(?i)[0-9]+|rs\\.?|inr|₹|crore|lakh') THEN length(s) >= 20 ELSE len({_W.format(c='s')}) >= 10 AND length(s) >= 50 END)""",
    "graph_eligible": "SELECT doc_id, value FROM (SELECT doc_id, text IS NOT NULL AND length(s) >= 180 AND (" + " OR ".join(f"regexp_matches(s, '{p}')" for p in _SIGNALS) + ") AS value, text FROM (SELECT doc_id, text, " + _strip("text") + " AS s FROM documents))",
    "fingerprint": _doc_sql(f"""md5(array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '([0-9]+)', 1),
  list_transform(list_filter({_T.format(c='text')}, lambda t: regexp_full_match(t, '(19|20)[0-9]{{2}}')), lambda t: t[1:2])),
  (regexp_extract_all(text, '([A-Z][a-z]+(?:[ \\t\\n\\r]+[A-Z][a-z]+)*)', 1))[1:5]))), '|'))[1:8]"""),
    "shingles": _doc_sql("md5(array_to_string(list_sort(list_distinct(list_transform(range(1, length(text) - 4), lambda i: substr(text, i, 6)))), '|'))"),
    "heading_level": rf"""
WITH b AS (SELECT DISTINCT doc_id, block_index, {_strip('content')} AS c FROM blocks WHERE block_type = 'heading')
SELECT doc_id, block_index, (CASE
  WHEN regexp_matches(c, '^[0-9]+(\.[0-9]+)+\.?\s') THEN len(string_split(regexp_extract(c, '^([0-9]+(\.[0-9]+)+)', 1), '.'))
  WHEN regexp_matches(c, '^[0-9]+\.?\s') THEN 1 WHEN regexp_matches(lower(c), '^(chapter|part)') THEN 1
  WHEN regexp_matches(lower(c), '^section\s+[0-9]') THEN len(string_split(regexp_extract(lower(c), '^section\s+([0-9]+(\.[0-9]+)*)', 1), '.')) + 1
  WHEN starts_with(lower(c), 'section') THEN 2 WHEN regexp_matches(lower(c), '^(sub-section|subsection)') THEN 3
  WHEN regexp_matches(lower(c), '^(annex|appendix)') THEN 1 WHEN regexp_matches(c, '^(?i:IX|IV|V?I{{0,3}})\.?\s') THEN 1 ELSE 2 END)::INT AS level FROM b""",
    "sentence_split": _doc_sql(f"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.?!]){_S}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> ''), '|')"),
    "normalize_name": f"SELECT DISTINCT entity_key, {normalize_sql('name')} AS value FROM g_entity",
    "filename_tokens": r"SELECT DISTINCT doc_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(file_name, '^.*/', ''), '(.)\.[^.]*$', '\1')), '[_\-\s]+'), lambda t: t <> ''), '|') AS value FROM documents_meta",
    "chunk_ids": "SELECT chunk_id, md5(coalesce(doc_id, '') || coalesce(chunk_index::VARCHAR, ''))[1:12] AS value FROM (SELECT DISTINCT * FROM chunks)",
    "doc_ids": "SELECT doc_id, md5(coalesce(file_name, '') || coalesce(round(file_size_kb, 2)::DECIMAL(18,2)::VARCHAR, ''))[1:12] AS value FROM (SELECT DISTINCT * FROM documents_meta)",
    "description_merge": "SELECT entity_key, CASE WHEN coalesce(d, '') = '' THEN coalesce(c, '') WHEN coalesce(c, '') = '' THEN d WHEN sd = sc THEN d WHEN contains(sc, sd) THEN c WHEN contains(sd, sc) THEN d ELSE d || ' ' || c END AS value FROM (SELECT DISTINCT ON (entity_key) entity_key, description AS d, citation_text AS c, " + _strip("lower(description)") + " AS sd, " + _strip("lower(citation_text)") + " AS sc FROM g_entity)",
    "markdown_cleaning": "SELECT doc_id, block_index, " + _strip(r"regexp_replace(regexp_replace(coalesce(content, ''), '(?m)^[•-][ \t\n\r\f\x0B]*', '- ', 'g'), '[ \t]+', ' ', 'g')") + " AS value FROM (SELECT DISTINCT * FROM blocks)",
    "cache_key": "SELECT chunk_id, sha256(coalesce(lower(trim(text)), '') || '||' || coalesce(section, '') || '||' || coalesce(summary, '') || '||' || coalesce(is_table, false)::VARCHAR || '||' || concat_ws(',', chunk_id, doc_id)) AS value FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)",
    "session_title": "SELECT DISTINCT message_id, CASE WHEN length(content) > 30 THEN left(content, 30) || '...' ELSE content END AS value FROM history",
    "extractive_answer": _doc_sql(f"CASE WHEN length(array_to_string({_W.format(c='text')}, ' ')) > 800 THEN left(array_to_string({_W.format(c='text')}, ' '), 800) || '...' ELSE array_to_string({_W.format(c='text')}, ' ') END"),
    "summary_excerpt": _doc_sql("CASE WHEN length(text) <= 5000 THEN text ELSE left(text, 3500) || chr(10) || '...' || chr(10) || substr(text, (length(text) // 2) + 1, 1500) END"),
    "prefix_passage": _doc_sql("'passage: ' || text"),
    "query_entities": rf"""
WITH t AS (SELECT item_id, 0 AS o, unnest(regexp_extract_all(text, '(?i)\b(section\s+[0-9]+[a-z]?)\b', 1)) AS w, generate_subscripts(regexp_extract_all(text, '(?i)\b(section\s+[0-9]+[a-z]?)\b', 1), 1) AS i FROM benchmark
  UNION ALL SELECT item_id, 1, unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9&.\-]{{2,}})', 1)), generate_subscripts(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9&.\-]{{2,}})', 1), 1) FROM benchmark),
n AS (SELECT item_id, {normalize_sql('w')} AS v, min(o * 100000 + i) AS i, min(o) AS o FROM t GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM n WHERE o = 0 OR (v <> '' AND NOT list_contains({_list(T.GENERIC_QUERY_TERMS)}, v)))
SELECT item_id, coalesce((SELECT string_agg(v, '|' ORDER BY i) FROM f WHERE f.item_id = b.item_id AND r <= 8), '') AS value FROM benchmark b""",
}
