"""Questions made of chunks, retrieved for by whole plans: filters, query sets, relaxation, arms, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veldra.functions import text as T
from veldra.operators import asking as A, prompts as P, ranking as R
from veldra.plans import answer as W, retrieve as plans
from veldra.queries.ranking import _ANSWER
from veldra.queries.search import C, QUERY_FILTER, QUERY_SQL
from veldra.tables import chunks, table

YEARS = ("2018", "2019")


def base(spark, d) -> DataFrame:
    return chunks(spark, d).select(F.col("chunk_id").alias("id"), F.col("dense").alias("vector"), "sparse", *A.FIELDS)


def units(spark, d) -> DataFrame:
    """Each query chunk with the chunk after it as its sub-query; the filter is its year and section."""
    c = chunks(spark, d)
    q = c.filter(QUERY_FILTER)
    hints = A.hints_filter(doc_year=F.col("doc_year"), section=F.col("section"))
    own = q.select(F.col("chunk_id").alias("unit_id"), F.lit(0).alias("sub"), F.col("dense").alias("vector"), "sparse", hints.alias("hints"))
    after = q.select(F.col("chunk_id").alias("unit_id"), "source_file", (F.col("chunk_index") + 1).alias("chunk_index"), hints.alias("hints"))
    nxt = after.join(c.select("source_file", "chunk_index", F.col("dense").alias("vector"), "sparse"), ["source_file", "chunk_index"])
    return own.unionByName(nxt.select("unit_id", F.lit(1).alias("sub"), "vector", "sparse", "hints"))


def questions(spark, d) -> DataFrame:
    return chunks(spark, d).filter(QUERY_FILTER).select(F.col("chunk_id").alias("unit_id"), F.col("text").alias("question"))


def wanted_arms(spark, d) -> DataFrame:
    """A comparison of the question's year with two others."""
    label = F.array_distinct(F.filter(F.array(F.when(F.trim("doc_year") != "", F.col("doc_year")), *map(F.lit, YEARS)), lambda y: y.isNotNull()))
    arm = F.transform(label, lambda y: F.struct(y.alias("label"), y.alias("year"), F.array().cast("array<string>").alias("filename_tokens")))
    return chunks(spark, d).filter(QUERY_FILTER).select(F.col("chunk_id").alias("query_id"), arm.alias("arms"))


def _plan(plan, spark, d, **kw):
    return plan(base(spark, d), units(spark, d), questions(spark, d), chunks(spark, d), **kw)


def single(spark, d):
    return _plan(plans.single, spark, d)


def few(spark, d):
    return plans.few(base(spark, d), units(spark, d), wanted_arms(spark, d), questions(spark, d), chunks(spark, d))


def assembled(spark, d):
    r = R.threshold_cap(_plan(plans.ranked, spark, d), "boosted", plans.LEAST, plans.K, "unit_id")
    a = plans.with_missing(plans.assemble(r), questions(spark, d))
    return a.select("unit_id", F.md5("block").alias("block"), "chunks_used", "tokens", F.array_join("sources", ",").alias("sources"), "sources_count", "has_tables", "not_found")


def filter_levels(spark, d):
    """The levels of each question's filter, as text."""
    h = units(spark, d).filter("sub = 0").select("unit_id", F.posexplode(A.levels(F.col("hints"))).alias("level", "h"))
    return h.select("unit_id", F.col("level").cast("int"), F.coalesce("h.doc_year", F.lit("-")).alias("doc_year"), F.coalesce("h.section", F.lit("-")).alias("section"))


def query_sets(spark, d):
    """Items as questions with their first two sentences as sub-queries."""
    s = T.sentences(F.col("text"))
    subs = F.transform(F.slice(s, 1, 2), lambda q: F.struct(q.alias("query"), F.lit(1.0).alias("weight")))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(A.query_set(F.col("text"), subs)).alias("sub", "q")).select("item_id", "sub", F.md5("q").alias("query_hash"))


def subquery_scoring(spark, d):
    """Each tenth embedding as a question, the nine after it as its sub-queries; those at 0.05 or over."""
    e = table(spark, d, "embeddings").withColumn("q", F.floor(F.col("vec_id") / 10) * 10)
    subs = e.filter("vec_id <> q").groupBy("q").agg(F.collect_list(F.struct(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))).alias("subs"))
    one = e.filter("vec_id = q").select("q", "embedding").join(subs, "q")
    return A.score_subqueries(one, "embedding", "subs", 0.05).select("q", F.posexplode("subqueries").alias("place", "s")).select("q", "place", F.col("s.query").alias("vec_id"), F.col("s.weight").alias("weight"))


def point_lookup(spark, d):
    """Chunks by file and id, the file in the column of before for half of them."""
    c = chunks(spark, d)
    old = F.length(F.coalesce("text", F.lit(""))) % 2 == 0
    stored = c.select("chunk_id", F.when(~old, F.col("source_file")).alias("source_file"), F.when(old, F.col("source_file")).alias("source"))
    return A.lookup(stored, c.filter("chunk_index = 0").select("source_file", "chunk_id")).select("source_file", "chunk_id")


def payload(spark, d):
    """Chunks with defaults for what is null."""
    return A.payload(chunks(spark, d).drop("summary")).select("chunk_id", "source_file", F.md5("text").alias("text_hash"), "page_no", "page_label", "section", "is_table", "token_count", "summary", F.size("keywords").alias("keywords"))


def graph_merge(spark, d):
    """Hits of the pool with candidates from a walk over a question's file: each third chunk from it on."""
    c = chunks(spark, d)
    q = c.filter(QUERY_FILTER).select(F.col("chunk_id").alias("unit_id"), "source_file", F.col("chunk_index").alias("q"))
    g = q.join(c.select("source_file", F.col("chunk_id").alias("id"), "chunk_index"), "source_file").filter("chunk_index between q and q + 30 and chunk_index % 3 = 0")
    g = g.select("unit_id", "source_file", "id", F.round(2 / (1 + F.col("chunk_index") - F.col("q")), 6).alias("graph_score"), F.lit(1).alias("graph_hops"), F.lit("").alias("graph_path"))
    return A.merge_graph(A.hit_counts(A.pool(base(spark, d), units(spark, d))), g, c).select("unit_id", "id", "score", "hits", "graph_score", "channel")


def cleaned(spark, d):
    """Answers of a cleaner, some whole, some fenced, some broken, read with their defaults."""
    b = table(spark, d, "benchmark")
    good = F.to_json(F.struct(F.substring("text", 1, 40).alias("improved_query"), F.lit("few").alias("target_scope"), F.array(F.struct(F.lit("a").alias("label"), F.lit("2018").alias("year"))).alias("comparison_arms")))
    kind = F.pmod("item_id", F.lit(4))
    answer = F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("<think>so {</think>```json\n"), good, F.lit("\n```"))).when(kind == 2, "no idea").otherwise(F.lit(None))
    x = P.cleaned_query(F.col("text"), answer)
    return b.select("item_id", x.alias("x")).select("item_id", F.md5("x.improved_query").alias("improved"), "x.target_scope", "x.answer_structure", "x.specificity", F.size("x.comparison_arms").alias("arms"))


def prompts(spark, d):
    """Prompts of all kinds for each item, by hash."""
    t, i = F.col("text"), F.col("item_id").cast("string")
    return table(spark, d, "benchmark").select("item_id", F.md5(P.cleaner_prompt(t)).alias("cleaner"), F.md5(P.generator_prompt(t, F.lit("c"), F.lit("direct"), F.lit(None))).alias("generator"), F.md5(P.graph_prompt(i, t, F.lit("ACT"))).alias("graph"), F.md5(P.gleaning_prompt(i, t, F.lit("{}"))).alias("gleaning"))


def capped(spark, d) -> DataFrame:
    return R.threshold_cap(_plan(plans.ranked, spark, d), "boosted", plans.LEAST, plans.K, "unit_id")


def budget_dispatch(spark, d):
    """Hits within a budget, of half of the questions as comparisons of sections."""
    h = capped(spark, d).withColumn("tokens", F.coalesce(T.token_count(F.col("text")), F.lit(0))).withColumn("arm", F.coalesce("section", F.lit("")))
    structure = F.when(F.substring("unit_id", 1, 1) < "8", "compare").otherwise("direct")
    return W.budgeted(h, structure, 600).select("unit_id", "id", F.col("running_tokens").alias("running"))


def forms(spark, d):
    """Forms of users filled by a rule that stands for a model: it knows two fields, one of them as a placeholder."""
    c = table(spark, d, "customer").filter("c_custkey <= 200")
    texts = c.select(F.col("c_custkey").cast("string").alias("session"), F.col("c_name").alias("text"))
    state = c.select(F.col("c_custkey").cast("string").alias("session"), F.lit("name").alias("field"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("n/a").alias("value"))
    fields = spark.createDataFrame([("name",), ("segment",), ("city",)], "field string")
    return W.extract_forms(texts, state, fields, lambda p: '{"name": "asked", "segment": "s", "city": "not available", "other": "x"}' if "city" in p else "")[1]


QUERIES = {
    "context_compare": lambda spark, d: W.compare_block(capped(spark, d).withColumn("arm", F.col("section"))).select("unit_id", F.md5("block").alias("block")),
    "context_synthesize": lambda spark, d: W.synthesize_block(capped(spark, d)).select("unit_id", F.md5("block").alias("block")),
    "extractive_answers": lambda spark, d: W.extractive_answer(capped(spark, d)).select("unit_id", F.md5("answer").alias("answer")),
    "budget_dispatch": budget_dispatch,
    "ask": lambda spark, d: _plan(W.ask, spark, d).select("unit_id", F.md5("answer").alias("answer"), "reason", "confidence", "not_found", "cache_key"),
    "retrieved_documents": lambda spark, d: W.documents(capped(spark, d)).select("unit_id", "place", F.md5("page_content").alias("content"), F.col("metadata.id").alias("id")),
    "pool_of_arms": lambda spark, d: W.pooled_arms(base(spark, d), units(spark, d), wanted_arms(spark, d)).select("query_id", "label", "sub", "id", "score"),
    "form_extraction": forms,
    "length_batches": lambda spark, d: W.by_length(chunks(spark, d).select("chunk_id", F.coalesce("token_count", F.lit(0)).alias("token_count"))),
    "phrase_search": lambda spark, d: W.search_documents(table(spark, d, "documents"), "Purchase Order", name="source").select("doc_id", "hits", F.size("snippets").alias("snippets"), F.md5(F.array_join("snippets", "|")).alias("snippet_hash")),
    "retrieve_single": single,
    "retrieve_few": few,
    "retrieve_broad": lambda spark, d: _plan(plans.broad, spark, d),
    "assemble_context": assembled,
    "query_trace": lambda spark, d: _plan(plans.trace, spark, d),
    "retrieval_pool": lambda spark, d: A.pool(base(spark, d), units(spark, d)),
    "pool_hit_counts": lambda spark, d: A.hit_counts(A.pool(base(spark, d), units(spark, d))),
    "graph_merge": graph_merge,
    "filter_levels": filter_levels,
    "query_set": query_sets,
    "subquery_scoring": subquery_scoring,
    "point_lookup": point_lookup,
    "payload_defaults": payload,
    "cleaned_query": cleaned,
    "prompts": prompts,
}

_POOL = f"""{C},
cq AS (SELECT chunk_id AS unit_id, source_file, chunk_index, text, CASE WHEN trim(doc_year) <> '' THEN doc_year END AS hy, CASE WHEN trim(section) <> '' THEN section END AS hs FROM c WHERE {QUERY_SQL}),
un AS (SELECT cq.unit_id, 0 AS sub, c.dense, c.sparse, hy, hs FROM cq JOIN c ON c.chunk_id = cq.unit_id
  UNION ALL SELECT cq.unit_id, 1, c.dense, c.sparse, hy, hs FROM cq JOIN c ON c.source_file = cq.source_file AND c.chunk_index = cq.chunk_index + 1)"""
_ARMS = """,
ar AS (SELECT unit_id AS query_id, unnest(list_distinct(list_filter([hy, '2018', '2019'], lambda y: y IS NOT NULL))) AS arm, len(list_distinct(list_filter([hy, '2018', '2019'], lambda y: y IS NOT NULL))) AS n FROM cq)"""
_V = "len(dense) = {n} AND list_sum(list_transform(dense, lambda y: y::DOUBLE * y)) > 0"


def pool_sql(units: str = "un") -> str:
    dims = " UNION ALL ".join(
        f"SELECT q.unit_id, q.sub, v.chunk_id AS id, round(array_cosine_similarity(q.dense::DOUBLE[{n}], v.dense::DOUBLE[{n}]), 6) AS score, q.hy, q.hs, v.doc_year, v.section FROM (SELECT * FROM {units} WHERE {_V.format(n=n)}) q CROSS JOIN (SELECT * FROM c WHERE {_V.format(n=n)}) v" for n in (64, 32)
    )
    fit = "CASE lev WHEN 0 THEN (hy IS NULL OR coalesce(doc_year = hy, false)) AND (hs IS NULL OR coalesce(section = hs, false)) WHEN 1 THEN hs IS NULL OR hy IS NULL OR coalesce(doc_year = hy, false) ELSE true END AND (lev = 0 OR hy IS NOT NULL OR hs IS NOT NULL)"
    return f"""pd AS ({dims}),
dl AS (SELECT unit_id, lev, sub, id, score FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, lev, sub ORDER BY score DESC, id) AS r FROM pd, (VALUES (0), (1), (2)) l(lev) WHERE {fit}) WHERE r <= 60),
pt AS (SELECT chunk_id, doc_year, section, unnest(map_keys(sparse)) AS term, unnest(map_values(sparse))::DOUBLE AS w FROM c),
qt AS (SELECT unit_id, sub, hy, hs, unnest(map_keys(sparse)) AS term, unnest(map_values(sparse))::DOUBLE AS w FROM {units}),
ps AS (SELECT qt.unit_id, qt.sub, pt.chunk_id AS id, any_value(qt.hy) AS hy, any_value(qt.hs) AS hs, any_value(pt.doc_year) AS doc_year, any_value(pt.section) AS section, round(sum(qt.w * pt.w), 6) AS score FROM qt JOIN pt USING (term) GROUP BY 1, 2, 3),
sl AS (SELECT unit_id, lev, sub, id, score FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, lev, sub ORDER BY score DESC, id) AS r FROM ps, (VALUES (0), (1), (2)) l(lev) WHERE {fit}) WHERE r <= 40),
fj AS (SELECT coalesce(dl.unit_id, sl.unit_id) AS unit_id, coalesce(dl.lev, sl.lev) AS lev, coalesce(dl.sub, sl.sub) AS sub, coalesce(dl.id, sl.id) AS id, coalesce(dl.score, 0) AS d, coalesce(sl.score, 0) AS s FROM dl FULL JOIN sl ON dl.unit_id = sl.unit_id AND dl.lev = sl.lev AND dl.sub = sl.sub AND dl.id = sl.id),
fw AS (SELECT *, min(d) OVER q AS d0, max(d) OVER q AS d1, min(s) OVER q AS s0, max(s) OVER q AS s1 FROM fj WINDOW q AS (PARTITION BY unit_id, lev, sub)),
fs AS (SELECT unit_id, lev, sub, id, round(0.7 * CASE WHEN d1 = d0 THEN 0 ELSE (d - d0) / (d1 - d0) END + 0.3 * CASE WHEN s1 = s0 THEN 0 ELSE (s - s0) / (s1 - s0) END, 8) AS score FROM fw),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, lev, sub ORDER BY score DESC, id) AS r FROM fs) WHERE r <= 20),
fc AS (SELECT u.unit_id, coalesce((SELECT min(lev) FROM (SELECT lev, count(*) AS n FROM ft WHERE ft.unit_id = u.unit_id GROUP BY lev) WHERE n >= 6), CASE WHEN u.hy IS NULL AND u.hs IS NULL THEN 0 ELSE 2 END) AS lev FROM (SELECT DISTINCT unit_id, hy, hs FROM {units}) u),
po AS (SELECT ft.* FROM ft JOIN fc ON ft.unit_id = fc.unit_id AND ft.lev = fc.lev),
hc AS (SELECT unit_id, lev, id, max(score) AS score, count(*) AS hits FROM po GROUP BY ALL)"""


_P = f"{_POOL}, {pool_sql()}"
_FREE = f"{_POOL}, uf AS (SELECT unit_id, sub, dense, sparse, NULL::VARCHAR AS hy, NULL::VARCHAR AS hs FROM un), {pool_sql('uf')}"
_FEW = f"{_POOL}{_ARMS}, ua AS (SELECT un.unit_id || chr(1) || ar.arm AS unit_id, sub, dense, sparse, ar.arm AS hy, NULL::VARCHAR AS hs FROM un JOIN ar ON ar.query_id = un.unit_id), {pool_sql('ua')}"


def ranked_sql(query: str = "hc.unit_id", year: str = "q.hy", section: str = "q.hs") -> str:
    """SQL of ranked hits, rk, after the pool."""
    return f"""rt AS (SELECT hc.*, q.hy AS qy, c.source_file, c.chunk_index, c.text, c.section, c.page_no, c.page_label, c.is_table, c.chunk_year, c.doc_year, {year} AS hy, {section} AS hs, {_ANSWER.format(c='q.text')} AS qw, {_ANSWER.format(c='c.text')} AS cw
  FROM hc JOIN c ON c.chunk_id = hc.id JOIN cq q ON q.unit_id = {query}),
rk AS (SELECT *, round(round(1 / (1 + exp(-(10 * CASE WHEN len(qw) = 0 OR len(cw) = 0 THEN 0 ELSE len(list_intersect(qw, cw)) / len(qw) END - 5))), 6)
  + CASE WHEN coalesce(is_table, false) THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN coalesce(list_contains(chunk_year, hy), false) THEN 0.03::DOUBLE ELSE 0 END
  + CASE WHEN coalesce(contains(lower(section), lower(hs)), false) THEN 0.02::DOUBLE ELSE 0 END + (hits - 1) * 0.01::DOUBLE, 8) AS boosted FROM rt)"""


_NEAR = """nw AS (SELECT unit_id, source_file, chunk_index + o AS ci, id AS anchor, boosted, place FROM pl, (VALUES (-1), (1)) v(o)),
nf AS (SELECT nw.unit_id, c.chunk_id AS id, boosted, row_number() OVER (PARTITION BY nw.unit_id, c.chunk_id ORDER BY nw.place, nw.anchor) AS n FROM nw JOIN c ON c.source_file = nw.source_file AND c.chunk_index = nw.ci
  WHERE NOT EXISTS (FROM pl WHERE pl.unit_id = nw.unit_id AND pl.id = c.chunk_id)),
fi AS (SELECT unit_id, id, boosted AS score, false AS expanded FROM pl UNION ALL SELECT unit_id, id, round(boosted - 0.05, 8), true FROM nf WHERE n = 1)"""
_CAP = f"pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY boosted DESC, id)::INT AS place FROM rk WHERE boosted >= {plans.LEAST}) WHERE place <= {plans.K})"
_SINGLE = f"{_P}, {ranked_sql()}, {_CAP}"
_STRIPPED = r"regexp_replace({c}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
_TOKENS = r"coalesce(len(regexp_extract_all(text, '([^ \t\n\r\f\x0B]+)', 1)), 0)"
_LINE = f"""'File: ' || coalesce(source_file, '') || ' | Page ' || CASE WHEN coalesce(page_label, '') <> '' THEN page_label WHEN page_no > 0 THEN page_no::VARCHAR ELSE 'Unknown' END || ' | ' || CASE WHEN coalesce(section, '') <> '' THEN section ELSE 'General' END
  || CASE WHEN coalesce(is_table, false) THEN ' [TABLE]' ELSE ' [TEXT]' END || chr(10) || {_STRIPPED.format(c="coalesce(text, '')")} || chr(10)"""

_CHUNK_LINE = _LINE.replace("'File: ' || coalesce(source_file, '') || ' | Page ' ||", "'Page ' ||")
_CAPPED = _SINGLE.replace("c.doc_year, q.hy AS hy", "c.doc_year, c.doc_id, c.summary, q.hy AS hy")
_YEARED = "CASE WHEN coalesce(doc_year, '') <> '' THEN {a} || doc_year{b} ELSE '' END"
_SUMMARY = _STRIPPED.format(c="coalesce(summary, '')")

SQL = {
    "context_compare": f"""WITH {_CAPPED}, a AS (SELECT unit_id, CASE WHEN coalesce(section, '') <> '' THEN section ELSE 'General' END AS arm, min(place) AS p, arg_min('Source: ' || coalesce(source_file, '') || {_YEARED.format(a="chr(10) || 'Year: '", b="")}, place) AS head, string_agg({_CHUNK_LINE}, chr(10) ORDER BY place) AS lines FROM pl GROUP BY 1, 2)
SELECT unit_id, md5('=== COMPARISON CONTEXT ===' || chr(10) || 'Each section below represents one of the documents or entities being compared.' || chr(10) || chr(10) || string_agg(chr(10) || '━━━ ' || upper(arm) || ' ━━━' || chr(10) || head || chr(10) || chr(10) || lines, chr(10) ORDER BY p) || chr(10) || '=== END OF COMPARISON CONTEXT ===') AS block FROM a GROUP BY 1""",
    "context_synthesize": f"""WITH {_CAPPED}, n AS (SELECT *, CASE WHEN coalesce(doc_id, '') <> '' THEN doc_id ELSE source_file END AS doc FROM pl), k AS (SELECT *, row_number() OVER (PARTITION BY unit_id, doc ORDER BY place) AS r FROM n),
a AS (SELECT unit_id, doc, min(place) AS p, arg_min(coalesce(source_file, '') || {_YEARED.format(a="' ('", b=" || ')'")} || ' ━━━' || CASE WHEN {_SUMMARY} <> '' THEN chr(10) || '[DOCUMENT SUMMARY]' || chr(10) || {_SUMMARY} || chr(10) ELSE '' END, place) AS head, string_agg({_CHUNK_LINE}, chr(10) ORDER BY place) AS lines FROM k WHERE r <= 2 GROUP BY 1, 2)
SELECT unit_id, md5('=== SYNTHESIZED CONTEXT FROM MULTIPLE DOCUMENTS ===' || chr(10) || 'Below are summaries and key excerpts from relevant documents.' || chr(10) || chr(10) || string_agg(chr(10) || '━━━ ' || head || chr(10) || lines, chr(10) ORDER BY p) || chr(10) || '=== END OF SYNTHESIZED CONTEXT ===') AS block FROM a GROUP BY 1""",
    "extractive_answers": f"""WITH {_CAPPED}, w AS (SELECT *, array_to_string(regexp_extract_all(coalesce(text, ''), '([^ \\t\\n\\r\\f\\x0B]+)', 1), ' ') AS t FROM pl WHERE place <= 3)
SELECT unit_id, md5(string_agg('- ' || CASE WHEN length(t) > 800 THEN left(t, 800) || '...' ELSE t END || ' [Source: ' || coalesce(source_file, 'Unknown') || ', Page ' || CASE WHEN coalesce(page_label, '') <> '' THEN page_label ELSE coalesce(page_no::VARCHAR, '?') END || ']', chr(10) ORDER BY place)) AS answer FROM w GROUP BY 1""",
    "budget_dispatch": f"""WITH {_SINGLE}, h AS (SELECT *, {_TOKENS} AS tokens, CASE WHEN unit_id[1] < '8' THEN coalesce(section, '') END AS arm FROM pl), n AS (SELECT unit_id, greatest(count(DISTINCT arm), 1) AS n FROM h GROUP BY 1),
b AS (SELECT h.*, CASE WHEN unit_id[1] < '8' THEN 600 // n ELSE 600 END AS most, sum(tokens) OVER (PARTITION BY unit_id, arm ORDER BY place) AS running FROM h JOIN n USING (unit_id)),
s AS (SELECT *, max(CASE WHEN NOT coalesce(is_table, false) AND running > most THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id, arm ORDER BY place) AS stop FROM b) SELECT unit_id, id, running::BIGINT AS running FROM s WHERE stop = 0""",
    "retrieved_documents": f"WITH {_SINGLE} SELECT unit_id, place, md5(coalesce(text, '')) AS content, id FROM pl",
    "pool_of_arms": f"WITH {_FEW} SELECT split_part(unit_id, chr(1), 1) AS query_id, split_part(unit_id, chr(1), 2) AS label, sub::INT AS sub, id, score FROM po",
    "form_extraction": "SELECT c_custkey::VARCHAR AS session, 2::BIGINT AS filled, 'city' AS missing, 66.7::DOUBLE AS percent FROM customer WHERE c_custkey <= 200",
    "length_batches": f"WITH {C} SELECT chunk_id, coalesce(token_count, 0) AS token_count FROM c",
    "phrase_search": r"""WITH h AS (SELECT doc_id, source, text, lower(coalesce(text, '')) AS l, contains(lower(coalesce(source, '')), 'purchase order') AS named FROM documents),
p AS (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: contains(lower(x), 'purchase order')) AS ps FROM h WHERE contains(l, 'purchase order') OR named),
s AS (SELECT doc_id, ((length(l) - length(replace(l, 'purchase order', ''))) // 14 + named::INT)::BIGINT AS hits, list_transform(ps, lambda x: CASE WHEN length(x) <= 400 THEN regexp_replace(x, '^[ 	

]+|[ 	

]+$', '', 'g') ELSE '...' || substr(x, greatest(instr(lower(x), 'purchase order') - 180, 1), instr(lower(x), 'purchase order') - greatest(instr(lower(x), 'purchase order') - 180, 1) + 14 + 180) || '...' END) AS t FROM p),
u AS (SELECT doc_id, hits, t, list_filter(t, lambda x, i: list_position(t, x) = i) AS d FROM s)
SELECT doc_id, hits, len(d)::INT AS snippets, md5(array_to_string(d, '|')) AS snippet_hash FROM u""",
    "retrieve_single": f"WITH {_SINGLE}, {_NEAR} SELECT * FROM fi",
    "retrieve_few": f"""WITH {_FEW}, {ranked_sql("split_part(hc.unit_id, chr(1), 1)", "split_part(hc.unit_id, chr(1), 2)", "NULL::VARCHAR")}
SELECT query_id, arm, id, place FROM (SELECT split_part(unit_id, chr(1), 1) AS query_id, split_part(unit_id, chr(1), 2) AS arm, id, row_number() OVER (PARTITION BY unit_id ORDER BY boosted DESC, id)::INT AS place FROM rk) x
JOIN (SELECT DISTINCT query_id, n FROM ar) USING (query_id) WHERE place <= greatest(1, 10 // n)""",
    "retrieve_broad": f"""WITH {_FREE}, {ranked_sql(year="NULL::VARCHAR", section="NULL::VARCHAR")},
bb AS (SELECT *, max(boosted) OVER (PARTITION BY unit_id, source_file) AS best, row_number() OVER (PARTITION BY unit_id, source_file ORDER BY boosted DESC, id) AS in_doc FROM rk),
bd AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY unit_id ORDER BY best DESC, source_file) AS doc_rank FROM bb) WHERE doc_rank <= 6 AND in_doc <= 4),
pl AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY doc_rank, in_doc)::INT AS place FROM bd), {_NEAR} SELECT * FROM fi""",
    "assemble_context": f"""WITH {_SINGLE}, ad AS (SELECT *, {_TOKENS} AS tokens, CASE WHEN coalesce(is_table, false) THEN 0 ELSE 1 END AS first FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, md5(lower({_STRIPPED.format(c="coalesce(text, '')")})) ORDER BY place, id) AS dn FROM pl) WHERE dn = 1),
ab AS (SELECT *, sum(tokens) OVER (PARTITION BY unit_id ORDER BY first, place, id) AS running FROM ad),
ak AS (SELECT * FROM (SELECT *, max(CASE WHEN first = 1 AND running > {plans.BUDGET} THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY first, place, id) AS stop FROM ab) WHERE stop = 0),
af AS (SELECT unit_id, source_file, min(first * 1000 + place) AS file_at, arg_min(coalesce(source_file, '') || CASE WHEN coalesce(doc_year, '') <> '' THEN ' (' || doc_year || ')' ELSE '' END, first * 1000 + place) AS title,
  string_agg({_LINE}, chr(10) ORDER BY first, place) AS lines, count(*) AS n, sum(tokens) AS tokens, coalesce(bool_or(is_table), false) AS tables FROM ak GROUP BY unit_id, source_file),
ag AS (SELECT unit_id, '=== KNOWLEDGE BASE CONTEXT ===' || chr(10) || string_agg(chr(10) || '--- DOCUMENT: ' || title || ' ---' || chr(10) || lines, chr(10) ORDER BY file_at) || chr(10) || '=== END OF CONTEXT ===' AS block, sum(n) AS chunks_used, sum(tokens) AS tokens,
  string_agg(source_file, ',' ORDER BY source_file) AS sources, count(*) AS sources_count, bool_or(tables) AS has_tables FROM af GROUP BY unit_id)
SELECT cq.unit_id, md5(coalesce(block, '{plans.NOT_FOUND}')) AS block, coalesce(chunks_used, 0)::BIGINT AS chunks_used, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(sources, '') AS sources, coalesce(sources_count, 0) AS sources_count, coalesce(has_tables, false) AS has_tables, block IS NULL AS not_found FROM cq LEFT JOIN ag USING (unit_id)""",
    "query_trace": f"""WITH {_SINGLE}, {_NEAR}, a AS (SELECT unit_id, max(lev)::INT AS level, count(*) AS searched, count(DISTINCT id) AS deduplicated FROM po GROUP BY 1), b AS (SELECT unit_id, count(*) FILTER (boosted >= {plans.LEAST}) AS over_threshold FROM rk GROUP BY 1),
e AS (SELECT unit_id, count(*) FILTER (NOT expanded) AS capped, count(*) AS final FROM fi GROUP BY 1)
SELECT a.*, coalesce(over_threshold, 0) AS over_threshold, coalesce(capped, 0) AS capped, coalesce(final, 0) AS final FROM a LEFT JOIN b USING (unit_id) LEFT JOIN e USING (unit_id)""",
    "retrieval_pool": f"WITH {_P} SELECT unit_id, lev::INT AS level, sub::INT AS sub, id, score FROM po",
    "pool_hit_counts": f"WITH {_P} SELECT unit_id, lev::INT AS level, id, score, hits FROM hc",
    "graph_merge": f"""WITH {_P}, g AS (SELECT unit_id, chunk_id AS id, least(1.0::DOUBLE, round(2 / (1 + c.chunk_index - cq.chunk_index), 6)) AS g FROM cq JOIN c USING (source_file) WHERE c.chunk_index BETWEEN cq.chunk_index AND cq.chunk_index + 30 AND c.chunk_index % 3 = 0)
SELECT coalesce(hc.unit_id, g.unit_id) AS unit_id, coalesce(hc.id, g.id) AS id, coalesce(hc.score, 0) AS score, coalesce(hits, 1) AS hits, coalesce(g, 0) AS graph_score, CASE WHEN hc.id IS NULL THEN 'graph' WHEN g.id IS NULL THEN 'hybrid' ELSE 'hybrid_graph' END AS channel
FROM hc FULL JOIN g ON hc.unit_id = g.unit_id AND hc.id = g.id""",
    "filter_levels": f"""WITH {_POOL} SELECT unit_id, lev::INT AS level, coalesce(CASE WHEN lev = 0 OR (lev = 1 AND hs IS NOT NULL) THEN hy END, '-') AS doc_year, coalesce(CASE WHEN lev = 0 THEN hs END, '-') AS section FROM cq, (VALUES (0), (1), (2)) l(lev) WHERE lev = 0 OR hy IS NOT NULL OR hs IS NOT NULL""",
    "subquery_scoring": """WITH s AS (SELECT q.vec_id AS q, e.vec_id, round(array_cosine_similarity(q.embedding::DOUBLE[64], e.embedding::DOUBLE[64]), 4) AS weight FROM embeddings q JOIN embeddings e ON e.vec_id // 10 = q.vec_id // 10 AND e.vec_id <> q.vec_id WHERE q.vec_id % 10 = 0)
SELECT q, (row_number() OVER (PARTITION BY q ORDER BY weight DESC, vec_id) - 1)::INT AS place, vec_id, weight FROM s WHERE weight >= 0.05""",
    "point_lookup": f"WITH {C} SELECT source_file, chunk_id FROM c WHERE chunk_index = 0 AND source_file IS NOT NULL",
    "payload_defaults": f"WITH {C} SELECT chunk_id, coalesce(source_file, '') AS source_file, md5(coalesce(text, '')) AS text_hash, coalesce(page_no, 0) AS page_no, coalesce(page_label, '') AS page_label, coalesce(section, '') AS section, coalesce(is_table, false) AS is_table, coalesce(token_count, 0) AS token_count, '' AS summary, coalesce(len(keywords), 0)::INT AS keywords FROM c",
    "cleaned_query": "SELECT item_id, md5(CASE WHEN item_id % 4 < 2 THEN left(text, 40) ELSE text END) AS improved, CASE WHEN item_id % 4 < 2 THEN 'few' ELSE 'broad' END AS target_scope, 'direct' AS answer_structure, 'low' AS specificity, (item_id % 4 < 2)::INT AS arms FROM benchmark",
}
