"""Checks of answers, search in documents, addresses, and rollups of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.models import embed_column
from veldra.operators import search as S
from veldra.queries.ranking import _ANSWER
from veldra.queries.sessions import _H, _O, ORDER, history
from veldra.sources import files, web
from veldra.streaming import rollups
from veldra.tables import table


def answers(spark, d) -> DataFrame:
    """Each answer with the message before it as the question and the messages before that, up to five, as its context."""
    h = history(spark, d).filter("role in ('user', 'assistant')")
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    texts = F.collect_list(F.coalesce("content", F.lit(""))).over(w.rowsBetween(-6, -1))
    h = h.withColumn("question", F.coalesce(F.lag("content").over(w), F.lit(""))).withColumn("context", F.array_join(texts, "\n"))
    return h.filter("role = 'assistant'").select("session_id", "message_id", F.coalesce("content", F.lit("")).alias("answer"), "question", "context")


def _overlap():
    return T.overlap(T.answer_tokens(T.truncate_tokens(F.col("answer"), 400), 3), T.answer_tokens(F.col("context"), 3))


def _query_overlap():
    """Part of the question's longer words that are in the context; 1 for a question without any."""
    q = T.answer_tokens(F.col("question"), 3)
    return F.when(F.size(q) == 0, 1.0).otherwise(T.overlap(q, T.answer_tokens(F.col("context"), 3)))


#: The least overlap of an answer with its context: a fixed value.
LEAST_OVERLAP = 0.30
#: Forms of a citation: a source with a chunk or page, or a file with a page number. Fixed values.
_CITED = r"\[Source:\s*[^,\]]+,\s*(?:Chunk|Page|page):?\s*[^\]]+\]|\[[^\]]+,\s*[Pp]age\s*~?[0-9]+[^\]]*\]"


def _fallback():
    return (T.strip(F.col("answer")) == "") | F.lower("answer").rlike("i cannot answer|no relevant information|couldn't find specific information")


def citations():
    """The part of the lines that say something that have a citation; 0 without such lines.

    Headings, lines of under eight words, and lines of up to twelve that end with a colon say nothing.
    """
    lines = F.filter(F.transform(F.split("answer", "\n"), T.strip), lambda x: ~F.startswith(x, F.lit("#")) & (F.size(T.words(x)) >= 8) & ~(F.endswith(x, F.lit(":")) & (F.size(T.words(x)) <= 12)))
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.size(F.filter(lines, lambda x: x.rlike(_CITED))) / F.size(lines))


def _reason():
    return F.when(_fallback(), "empty_or_fallback").when(F.col("overlap") < LEAST_OVERLAP, "low_overlap").when(F.col("unseen"), "unseen_numbers").when(citations() < 0.8, "citation_format").otherwise("passed")


def _confidence(passed):
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.55 * F.col("strength") + 0.45 * F.col("overlap")) * F.when(passed, 1.0).otherwise(0.55))), 3)


def judged(spark, d) -> DataFrame:
    """Answers with overlap, unseen numbers, retrieval strength (here the question's overlap with the context) and the first rule they break."""
    a = answers(spark, d).withColumn("overlap", _overlap()).withColumn("unseen", T.unseen_numbers(F.col("answer"), F.col("context"))).withColumn("strength", _query_overlap())
    return a.withColumn("reason", _reason())


def verdict(spark, d):
    """The first rule an answer breaks: overlap, then numbers, then citations."""
    return judged(spark, d).select("session_id", "message_id", "reason")


def cited(spark, d):
    """Answers with citations put behind their lines by turns, to have all forms of them."""
    a = answers(spark, d)
    mark = F.element_at(F.array(*map(F.lit, (" [Source: a.pdf, Chunk: 3]", " [b.pdf, Page 2]", " [c.pdf, page ~7 ff]", ":", ""))), (F.pmod("message_id", F.lit(5)) + 1).cast("int"))
    return a.withColumn("answer", F.concat("answer", mark)).select("session_id", "message_id", F.round(citations(), 6).alias("coverage"))


def document_search(spark, d):
    """Case-insensitive hits of a phrase by document, with the first paragraph that holds it."""
    low = F.lower("text")
    paragraphs = F.filter(F.split("text", "\n\n"), lambda p: F.contains(F.lower(p), F.lit("purchase order")))
    return table(spark, d, "documents").filter(F.contains(low, F.lit("purchase order"))).select("doc_id", F.regexp_count(low, F.lit("purchase order")).cast("long").alias("hits"), F.md5(F.coalesce(F.try_element_at(paragraphs, F.lit(1)), F.lit(""))).alias("snippet_hash"))


def urls(spark, d):
    """Addresses made of the file paths, safe and unsafe ones."""
    m = table(spark, d, "documents_meta").distinct()
    host = F.element_at(F.array(*map(F.lit, ("example.org", "localhost", "10.0.0.7", "192.168.1.1", "172.20.0.1", "8.8.8.8", ""))), F.pmod(F.length("file_name"), F.lit(7)) + 1)
    scheme = F.when(F.col("has_tables"), "https").when(F.col("file_type").isNull(), "ftp").otherwise("http")
    u = m.select("doc_id", F.concat(scheme, F.lit("://"), host, F.lit("/"), F.coalesce("file_name", F.lit(""))).alias("url"))
    return u.select("doc_id", web.url_reason(F.col("url")).alias("reason"))


def live(spark, d):
    """Search over texts embedded on the fly by the default embedder."""
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), embed_column(F.col("text")).alias("vector"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), embed_column(F.col("text")).alias("vector"))
    return S.dense_topk(b, q, 5)


WORDS = (("arrears", "https://example.org/a"), ("enterprise", "https://example.org/b"), ("purchase order", "https://example.org/c"), ("arrears", "https://example.org/d"))


def triggers(spark, d):
    """Addresses whose keyword stands in an item as words of its own, in the order of the mapping."""
    m = spark.createDataFrame([(w, u, i) for i, (w, u) in enumerate(WORDS)], "keyword string, url string, place int")
    return files.triggered_urls(table(spark, d, "benchmark"), m).select("item_id", "url", "place")


QUERIES = {
    "token_overlap": lambda spark, d: answers(spark, d).select("session_id", "message_id", F.round(_overlap(), 6).alias("overlap")),
    "query_overlap": lambda spark, d: answers(spark, d).select("session_id", "message_id", F.round(_query_overlap(), 6).alias("overlap")),
    "unseen_numbers": lambda spark, d: answers(spark, d).select("session_id", "message_id", T.unseen_numbers(F.col("answer"), F.col("context")).alias("unseen")),
    "citation_coverage": cited,
    "validate_answer": verdict,
    "answer_confidence": lambda spark, d: judged(spark, d).select("session_id", "message_id", _confidence(F.col("reason").isin("empty_or_fallback", "passed")).alias("confidence")),
    "document_search": document_search,
    "keyword_trigger": triggers,
    "url_safety": urls,
    "live_topk": live,
    "html_to_text": lambda spark, d: table(spark, d, "documents").select("doc_id", web.html_to_text("text").alias("text")),
    "event_windows": lambda spark, d: rollups.tumbling(table(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", "value"),
    "event_sessions": lambda spark, d: rollups.user_sessions(table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events")),
}

_A = f"""{_H}, l AS (SELECT *, coalesce(lag(content) OVER w, '') AS question, list(coalesce(content, '')) OVER (PARTITION BY session_id ORDER BY {_O} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before FROM ua WINDOW w AS (PARTITION BY session_id ORDER BY {_O})),
a AS (SELECT session_id, message_id, coalesce(content, '') AS answer, question, coalesce(array_to_string(before, chr(10)), '') AS context FROM l WHERE role = 'assistant')"""
_TRUNC = r"array_to_string((regexp_extract_all(answer, '([^ \t\n\r\f\x0B]+)', 1))[1:400], ' ')"
_A3, _C3 = (f"list_filter({_ANSWER.format(c=c)}, lambda t: length(t) >= 3)" for c in (_TRUNC, "context"))
_OV = "CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x) END"
_OVS = f"o AS (SELECT *, {_A3} AS x, {_C3} AS y FROM a), v AS (SELECT *, {_OV} AS overlap FROM o)"
_NUM = r"list_distinct(list_transform(regexp_extract_all(regexp_replace({c}, '[\p{{L}}०-९]', 'z', 'g'), '\b([0-9][0-9,]*(?:\.[0-9]+)?)\b', 1), lambda n: replace(n, ',', '')))"
_UN = f"len(list_filter({_NUM.format(c='answer')}, lambda n: floor(n::DOUBLE) > 3 AND NOT list_contains({_NUM.format(c='context')}, n))) > 0"
_ST = r"regexp_replace({c}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
_LN = rf"list_filter(list_transform(string_split(answer, chr(10)), lambda x: {_ST.format(c='x')}), lambda x: NOT starts_with(x, '#') AND len(regexp_extract_all(x, '([^ \t\n\r\f\x0B]+)', 1)) >= 8 AND NOT (ends_with(x, ':') AND len(regexp_extract_all(x, '([^ \t\n\r\f\x0B]+)', 1)) <= 12))"
_CITE_1, _CITE_2 = r"\[Source:\s*[^,\]]+,\s*(Chunk|Page|page):?\s*[^\]]+\]", r"\[[^\]]+,\s*(Page|page)\s*~?[0-9]+[^\]]*\]"
_CI = f"CASE WHEN len({_LN}) = 0 THEN 0 ELSE len(list_filter({_LN}, lambda z: regexp_matches(z, '{_CITE_1}') OR regexp_matches(z, '{_CITE_2}'))) / len({_LN}) END"
_Q3 = f"list_filter({_ANSWER.format(c='question')}, lambda t: length(t) >= 3)"
_ST_SQL = f"CASE WHEN len({_Q3}) = 0 THEN 1.0::DOUBLE WHEN len(y) = 0 THEN 0 ELSE len(list_intersect({_Q3}, y)) / len({_Q3}) END"
_JUDGED = f"""{_A}, {_OVS}, r AS (SELECT *, {_ST_SQL} AS strength, CASE WHEN {_ST.format(c='answer')} = '' OR regexp_matches(lower(answer), 'i cannot answer|no relevant information|couldn''t find specific information') THEN 'empty_or_fallback'
  WHEN overlap < 0.30 THEN 'low_overlap' WHEN {_UN} THEN 'unseen_numbers' WHEN {_CI} < 0.8 THEN 'citation_format' ELSE 'passed' END AS reason FROM v)"""

SQL = {
    "token_overlap": f"WITH {_A}, {_OVS} SELECT session_id, message_id, round(overlap, 6) AS overlap FROM v",
    "query_overlap": f"WITH {_A}, {_OVS} SELECT session_id, message_id, round({_ST_SQL}, 6) AS overlap FROM v",
    "unseen_numbers": f"WITH {_A} SELECT session_id, message_id, {_UN} AS unseen FROM a",
    "citation_coverage": f"WITH {_A.replace('a AS (SELECT session_id', 'a0 AS (SELECT session_id')}, a AS (SELECT * EXCLUDE (answer), answer || [' [Source: a.pdf, Chunk: 3]', ' [b.pdf, Page 2]', ' [c.pdf, page ~7 ff]', ':', ''][message_id % 5 + 1] AS answer FROM a0) SELECT session_id, message_id, round({_CI}, 6) AS coverage FROM a",
    "validate_answer": f"WITH {_JUDGED} SELECT session_id, message_id, reason FROM r",
    "answer_confidence": f"WITH {_JUDGED} SELECT session_id, message_id, round(greatest(0, least(1.0::DOUBLE, (0.55::DOUBLE * strength + 0.45::DOUBLE * overlap) * CASE WHEN reason IN ('empty_or_fallback', 'passed') THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END)), 3) AS confidence FROM r",
    "document_search": "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'purchase order', ''))) // 14)::BIGINT AS hits, md5(coalesce(list_filter(string_split(text, chr(10) || chr(10)), lambda p: contains(lower(p), 'purchase order'))[1], '')) AS snippet_hash FROM documents WHERE contains(lower(text), 'purchase order')",
    "keyword_trigger": "SELECT item_id, url, min(place)::INT AS place FROM benchmark, (VALUES " + ", ".join(f"('{w}', '{u}', {i})" for i, (w, u) in enumerate(WORDS)) + ") v(w, url, place) WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '($|[^a-z0-9_])') GROUP BY ALL",
    "url_safety": r"""WITH m AS (SELECT DISTINCT * FROM documents_meta), u AS (SELECT doc_id, CASE WHEN has_tables THEN 'https' WHEN file_type IS NULL THEN 'ftp' ELSE 'http' END AS scheme, ['example.org', 'localhost', '10.0.0.7', '192.168.1.1', '172.20.0.1', '8.8.8.8', ''][length(file_name) % 7 + 1] AS host FROM m)
SELECT doc_id, CASE WHEN scheme = 'ftp' THEN 'scheme' WHEN host = '' THEN 'host' WHEN host IN ('localhost', '10.0.0.7', '192.168.1.1', '172.20.0.1') THEN 'private' ELSE 'ok' END AS reason FROM u""",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS s FROM events) SELECT user_id, sum(s)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY user_id",
}
