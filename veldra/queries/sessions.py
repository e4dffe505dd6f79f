"""Sessions, keyed state and forms, over the chat history and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.operators import state as S
from veldra.tables import chunks, table

ORDER = ["timestamp", "message_id"]


def history(spark, d) -> DataFrame:
    h = table(spark, d, "history").filter("session_id is not null").distinct()
    low = F.lower(F.trim("role"))
    return h.withColumn("role", F.when(low.isin("user", "human", "customer"), "user").when(low.isin("assistant", "ai", "bot", "model"), "assistant").otherwise(low))


def formatted(spark, d):
    h = history(spark, d).filter("role in ('user', 'assistant')")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("content", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(*ORDER, line.alias("line"))))
    return S.last_n(h, "session_id", ORDER, 6).groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def sessions(spark, d):
    h = history(spark, d)
    title = F.min_by(F.when(F.col("role") == "user", T.session_title(F.col("content"))), F.when(F.col("role") == "user", F.struct(*ORDER)))
    return h.groupBy("session_id").agg(title.alias("title"), F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("updated"), F.count("*").alias("messages"))


def events(spark, d) -> DataFrame:
    return table(spark, d, "events")


def seq():
    """Order of the events."""
    return F.struct("ts", "event_id")


def form(spark, d):
    value = F.when(F.col("value") < 20, "n/a").when(F.col("value") < 40, " ").otherwise(F.format_string("v%d", F.floor("value")))
    return S.fill_form(events(spark, d).withColumn("v", value), "user_id", "event_type", "v", seq())


def updates(spark, d):
    """Each user's first event, partially overwritten by the last one."""
    e = events(spark, d).select("user_id", "event_type", F.when(F.col("value") >= 50, F.round("value", 4)).alias("value"), seq().alias("seq"))
    first = e.groupBy("user_id").agg(F.min_by("event_type", "seq").alias("event_type"), F.min_by("value", "seq").alias("value"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", "seq").alias("event_type"), F.max_by("value", "seq").alias("value")).filter("user_id % 3 = 0")
    return S.partial_update(first, last, "user_id")


def template(spark, d):
    """A template filled with each user's values; unknown keys become empty."""
    f = form(spark, d).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    out = F.lit("click={{click}};view={{view}};other={{nothing}}")
    for key in ("click", "view", "nothing"):
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(F.element_at("m", key), F.lit("")))
    return f.select("user_id", out.alias("text"))


def salvage(spark, d):
    """Events' JSON as a model might answer it: bare, fenced, in a sentence, in a list, broken or missing."""
    k = F.pmod("event_id", F.lit(6))
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("It is "), "props", F.lit(" I think"))).when(k == 3, F.concat(F.lit("a list ["), "props", F.lit("] end"))).when(k == 4, F.concat(F.lit("broken {"), "props")).otherwise("")
    s = T.json_salvage(text)
    return events(spark, d).select("event_id", s["mode"].alias("mode"), F.get_json_object(F.when(s["mode"] != "array", s["json"]), "$.k").alias("k"))


def cached(spark, d, part: int) -> DataFrame:
    """Answers by key, of the even or the odd events: the last one of a key."""
    e = events(spark, d).filter(F.pmod("event_id", F.lit(2)) == part).withColumn("answer", F.concat_ws("-", "event_type", "event_id"))
    return S.latest(e, "user_id", "answer", seq()).select(F.col("user_id").alias("key"), "answer")


def form_merge(spark, d):
    """Values of the first half of the events, then those of the second half for what is still empty."""
    value = F.when(F.col("value") < 20, "n/a").when(F.col("value") < 40, " ").otherwise(F.format_string("v%d", F.floor("value")))
    e = events(spark, d).withColumn("v", value)
    first = e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min_by("v", seq()).alias("v"))
    return S.merge_form(first, S.fill_form(e.filter("event_id % 2 = 1"), "user_id", "event_type", "v", seq()), "user_id", "event_type", "v")


def replaced(spark, d):
    """Files of each seventh name with one new chunk in the place of the old ones, the year carried over from the first old one."""
    c = chunks(spark, d).filter("source_file is not null").select("chunk_id", "source_file", "chunk_index", "text", "doc_year")
    gone = c.filter("length(source_file) % 7 = 0")
    years = gone.groupBy("source_file").agg(F.min("doc_year").alias("doc_year"))
    new = gone.select("source_file").distinct().select(F.concat(F.lit("new:"), "source_file").alias("chunk_id"), "source_file", F.lit(0).alias("chunk_index"), F.lit("edited").alias("text"))
    return S.replace_document(c, new, years, carry=("doc_year",)).select("chunk_id", "source_file", "chunk_index", "doc_year")


def cascade(spark, d):
    """Messages left after the sessions of under four messages go with all they hold."""
    h = history(spark, d)
    s = h.groupBy("session_id").agg(F.count("*").alias("n"))
    left, messages = S.cascade(s, h, s.filter("n < 4"))
    return messages.join(left.select("session_id", "n"), "session_id").select("session_id", "message_id", "n")


def renamed(spark, d):
    """Sessions with their title, a new one for those that have an answer of over 400 characters, and sessions made for users without one."""
    s = sessions(spark, d).select("session_id", "title")
    names = history(spark, d).filter("role = 'assistant' and length(content) > 400").select("session_id", F.lit("Long answer").alias("title"))
    made = table(spark, d, "customer").filter("c_custkey <= 5").select(F.concat(F.lit("c"), "c_custkey").alias("session_id"), F.lit("New chat").alias("title"))
    return S.rename(S.create_sessions(s, made), names)


def users(spark, d):
    """Customers as users; those of nation 1 to be added again under other names, of which only new ones are taken, then found by name."""
    c = table(spark, d, "customer").select(F.concat("c_name", F.lit("@example.org")).alias("email"), F.col("c_name").alias("username"), "c_nationkey")
    old = c.filter("c_nationkey % 2 = 0").select("email", "username")
    new = c.filter("c_nationkey % 3 = 0").select(F.upper("email").alias("email"), F.concat("username", F.when(F.col("c_nationkey") % 2 == 0, F.lit("x")).otherwise(F.lit(""))).alias("username"))
    return old.unionByName(S.create_users(old, new)).select("email", "username")


def uploads(spark, d):
    """Files of the metadata with the time of the last parse, or else a time of their own."""
    f = table(spark, d, "documents_meta").distinct().select("doc_id", "file_name", F.lit("1970-01-01").alias("modified"))
    r = table(spark, d, "parse_results").distinct().filter("success").select("file_name", F.concat(F.lit("t"), F.col("total_pages").cast("string")).alias("upload_time"))
    return S.upload_times(f, r).select("doc_id", "uploaded")


QUERIES = {
    "turn_pairs": lambda spark, d: S.turn_pairs(history(spark, d).filter("role in ('user', 'assistant')"), "session_id", "role", "content", ORDER).select("session_id", "message_id", F.col("content").alias("question"), "answer"),
    "recent_history": lambda spark, d: S.last_n(history(spark, d), "session_id", ORDER, 6).select("session_id", "place", "message_id"),
    "chat_history": lambda spark, d: S.last_n(history(spark, d), "session_id", ORDER, 50, oldest=True).select("session_id", "place", "message_id"),
    "format_history": formatted,
    "session_rollup": sessions,
    "user_sessions": lambda spark, d: sessions(spark, d).select("session_id", "updated").transform(lambda t: S.sessions_of(t, "default_user")),
    "metadata_history": lambda spark, d: S.upsert_history(events(spark, d), "user_id", F.col("event_type"), seq()),
    "latest_value": lambda spark, d: S.latest(events(spark, d).withColumn("value", F.round("value", 4)), "user_id", "value", seq()),
    "partial_update": updates,
    "delete_source": lambda spark, d: S.delete_keys(chunks(spark, d), table(spark, d, "documents_meta").filter("page_count is null or page_count = 0"), "doc_id").select("chunk_id"),
    "form_state_merge": form,
    "form_progress": lambda spark, d: S.form_progress(form(spark, d), events(spark, d), "user_id", "event_type"),
    "template_fill": template,
    "json_salvage": salvage,
    "registry_cleanup": lambda spark, d: table(spark, d, "documents_meta").distinct().select("doc_id", F.when(F.col("parse_success").isNull(), "processing").when(F.col("parse_success"), "ingested").otherwise("failed").alias("s")).select("doc_id", F.when(F.col("s") == "processing", "failed").otherwise(F.col("s")).alias("status")),
    "documents_newest_first": lambda spark, d: S.newest(table(spark, d, "documents").select("doc_id", "ingestion_date"), "ingestion_date", "doc_id").select("doc_id", F.row_number().over(Window.partitionBy(F.to_date("ingestion_date")).orderBy(F.desc("ingestion_date"), "doc_id")).cast("int").alias("place_of_day")),
    "cache_put": lambda spark, d: S.put(cached(spark, d, 0), cached(spark, d, 1), "key").groupBy("key", "answer").count().select("key", "answer"),
    "cache_clear": lambda spark, d: S.cleared(cached(spark, d, 0)).agg(F.count("*").alias("rows")),
    "form_merge": form_merge,
    "replace_document": replaced,
    "session_cascade": cascade,
    "session_rename": renamed,
    "user_registry": users,
    "upload_times": uploads,
    "metadata_get": lambda spark, d: table(spark, d, "documents_meta").distinct().filter(F.lower("file_type") == "pdf").select("doc_id", "file_name"),
    "metadata_delete": lambda spark, d: S.delete_keys(table(spark, d, "documents_meta").distinct(), table(spark, d, "parse_results").filter("not success"), "doc_id").select("doc_id"),
    "documents_by_date": lambda spark, d: table(spark, d, "documents").groupBy(F.date_format("ingestion_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("documents")),
}

_H = """h AS (SELECT * EXCLUDE (role), CASE WHEN lower(trim(role)) IN ('user', 'human', 'customer') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' ELSE lower(trim(role)) END AS role
  FROM (SELECT DISTINCT * FROM history WHERE session_id IS NOT NULL)), ua AS (SELECT * FROM h WHERE role IN ('user', 'assistant'))"""
_O = "timestamp NULLS FIRST, message_id"
_F = """v AS (SELECT *, CASE WHEN value < 20 THEN 'n/a' WHEN value < 40 THEN ' ' ELSE 'v' || floor(value)::BIGINT END AS v FROM events),
f AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, v FROM v WHERE trim(v) NOT IN ('n/a', '') ORDER BY user_id, event_type, ts, event_id)"""
_FIRST = "(SELECT DISTINCT ON (user_id) user_id, event_type, CASE WHEN value >= 50 THEN round(value, 4) END AS value FROM events ORDER BY user_id, ts {o}, event_id {o})"

SQL = {
    "turn_pairs": f"WITH {_H}, l AS (SELECT *, lead(role) OVER w AS r2, lead(content) OVER w AS c2 FROM ua WINDOW w AS (PARTITION BY session_id ORDER BY {_O})) SELECT session_id, message_id, content AS question, CASE WHEN r2 = 'assistant' THEN coalesce(c2, '') ELSE '' END AS answer FROM l WHERE role = 'user'",
    "recent_history": f"WITH {_H}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC NULLS LAST, message_id DESC) AS n FROM h) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY {_O})::INT AS place, message_id FROM l WHERE n <= 6",
    "chat_history": f"WITH {_H} SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY {_O})::INT AS place, message_id FROM h) WHERE place <= 50",
    "format_history": f"WITH {_H}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC NULLS LAST, message_id DESC) AS n FROM ua) SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(content, ''), chr(10) ORDER BY {_O}) AS history FROM l WHERE n <= 6 GROUP BY session_id",
    "session_rollup": f"""WITH {_H}, t AS (SELECT DISTINCT ON (session_id) session_id, CASE WHEN length(content) > 30 THEN left(content, 30) || '...' ELSE content END AS title FROM h WHERE role = 'user' ORDER BY session_id, {_O})
SELECT g.session_id, t.title, strftime(g.a, '%Y-%m-%d %H:%M:%S') AS created, strftime(g.b, '%Y-%m-%d %H:%M:%S') AS updated, g.n AS messages FROM (SELECT session_id, min(timestamp) AS a, max(timestamp) AS b, count(*) AS n FROM h GROUP BY 1) g LEFT JOIN t USING (session_id)""",
    "user_sessions": f"WITH {_H} SELECT session_id, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS updated FROM h GROUP BY session_id ORDER BY updated DESC, session_id",
    "metadata_history": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS version, count(*) - 1 AS update_count, string_agg(event_type, ',' ORDER BY ts, event_id) AS history FROM events GROUP BY user_id",
    "latest_value": "SELECT DISTINCT ON (user_id) user_id, round(value, 4) AS value FROM events ORDER BY user_id, ts DESC, event_id DESC",
    "partial_update": f"SELECT a.user_id, coalesce(b.event_type, a.event_type) AS event_type, coalesce(b.value, a.value) AS value FROM {_FIRST.format(o='')} a LEFT JOIN (SELECT * FROM {_FIRST.format(o='DESC')} WHERE user_id % 3 = 0) b USING (user_id)",
    "delete_source": "SELECT DISTINCT chunk_id FROM chunks WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents_meta WHERE coalesce(page_count, 0) = 0 AND doc_id IS NOT NULL)",
    "form_state_merge": f"WITH {_F} SELECT * FROM f",
    "form_progress": f"WITH {_F}, k AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM f) SELECT u.user_id, count(f.v) AS filled, coalesce(string_agg(k.event_type, ',' ORDER BY k.event_type) FILTER (f.v IS NULL), '') AS missing, round(100 * count(f.v) / count(*), 1) AS percent FROM u CROSS JOIN k LEFT JOIN f ON f.user_id = u.user_id AND f.event_type = k.event_type GROUP BY u.user_id",
    "template_fill": f"WITH {_F} SELECT user_id, 'click=' || coalesce(max(v) FILTER (event_type = 'click'), '') || ';view=' || coalesce(max(v) FILTER (event_type = 'view'), '') || ';other=' AS text FROM f GROUP BY user_id",
    "json_salvage": "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'empty' WHEN event_id % 6 = 4 THEN CASE WHEN props IS NULL THEN 'empty' ELSE 'invalid' END WHEN props IS NULL THEN 'empty' ELSE ['direct', 'fenced', 'salvaged', 'array'][event_id % 6 + 1] END AS mode, CASE WHEN event_id % 6 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events",
    "documents_newest_first": "SELECT doc_id, row_number() OVER (PARTITION BY ingestion_date::DATE ORDER BY ingestion_date DESC, doc_id)::INT AS place_of_day FROM documents",
    "cache_put": "SELECT user_id AS key, event_type || '-' || event_id AS answer FROM (SELECT DISTINCT ON (user_id) * FROM events ORDER BY user_id, event_id % 2 DESC, ts DESC, event_id DESC)",
    "cache_clear": "SELECT 0::BIGINT AS rows",
    "form_merge": """WITH v AS (SELECT *, CASE WHEN value < 20 THEN 'n/a' WHEN value < 40 THEN ' ' ELSE 'v' || floor(value)::BIGINT END AS v FROM events),
o AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, v FROM v WHERE event_id % 2 = 0 ORDER BY user_id, event_type, ts, event_id), n AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, v FROM v WHERE event_id % 2 = 1 AND trim(v) NOT IN ('n/a', '') ORDER BY user_id, event_type, ts, event_id),
j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, o.v AS ov, n.v AS nv FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type)
SELECT user_id, event_type, CASE WHEN coalesce(trim(ov), '') IN ('n/a', '') AND nv IS NOT NULL THEN nv ELSE coalesce(ov, '') END AS v, coalesce(trim(ov), '') IN ('n/a', '') AND nv IS NOT NULL AS filled FROM j""",
    "replace_document": """WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks) SELECT chunk_id, source_file, chunk_index, doc_year FROM c WHERE length(source_file) % 7 <> 0
UNION ALL SELECT 'new:' || source_file, source_file, 0, min(doc_year) FROM c WHERE length(source_file) % 7 = 0 GROUP BY source_file""",
    "session_cascade": f"WITH {_H}, n AS (SELECT session_id, count(*) AS n FROM h GROUP BY 1) SELECT session_id, message_id, n FROM h JOIN n USING (session_id) WHERE n >= 4",
    "session_rename": f"""WITH {_H}, t AS (SELECT DISTINCT ON (session_id) session_id, CASE WHEN length(content) > 30 THEN left(content, 30) || '...' ELSE content END AS title FROM h WHERE role = 'user' ORDER BY session_id, {_O}), l AS (SELECT DISTINCT session_id FROM h WHERE role = 'assistant' AND length(content) > 400)
SELECT s.session_id, CASE WHEN l.session_id IS NOT NULL THEN 'Long answer' ELSE t.title END AS title FROM (SELECT DISTINCT session_id FROM h) s LEFT JOIN t USING (session_id) LEFT JOIN l ON l.session_id = s.session_id UNION ALL SELECT 'c' || c_custkey, 'New chat' FROM customer WHERE c_custkey <= 5""",
    "user_registry": "SELECT c_name || '@example.org' AS email, c_name AS username FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT upper(c_name || '@example.org'), c_name FROM customer WHERE c_nationkey % 3 = 0 AND c_nationkey % 2 = 1",
    "upload_times": "SELECT m.doc_id, coalesce(t.u, '1970-01-01') AS uploaded FROM (SELECT DISTINCT * FROM documents_meta) m LEFT JOIN (SELECT file_name, max('t' || total_pages) AS u FROM parse_results WHERE success GROUP BY 1) t USING (file_name)",
    "metadata_get": "SELECT doc_id, file_name FROM (SELECT DISTINCT * FROM documents_meta) WHERE lower(file_type) = 'pdf'",
    "metadata_delete": "SELECT doc_id FROM (SELECT DISTINCT * FROM documents_meta) WHERE doc_id NOT IN (SELECT doc_id FROM parse_results WHERE NOT success AND doc_id IS NOT NULL)",
    "registry_cleanup": "SELECT doc_id, CASE WHEN parse_success THEN 'ingested' ELSE 'failed' END AS status FROM (SELECT DISTINCT * FROM documents_meta)",
    "documents_by_date": "SELECT strftime(ingestion_date, '%Y-%m-%d') AS day, count(*) AS documents FROM documents GROUP BY 1",
}
