"""Ranking, deduplication, budgets and context over the hits of the hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.operators import layout as L, ranking as R, search as S
from veldra.operators.pairs import equal_blocks
from veldra.queries import search as Q
from veldra.storage import stage
from veldra.tables import chunks, table

YEAR, SECTION, KEYWORD, NAME = "2018", "background", "solar brackets", "orders"
BUDGET = 1500
_COLS = ["query_id", "id", "rank", "score", "source_file", "chunk_index", "text", "section", "page_label", "is_table", "chunk_year", "tokens"]


def hits(spark, d) -> DataFrame:
    """Hits of the hybrid search with their chunks' columns."""
    c = chunks(spark, d).withColumn("tokens", F.coalesce(T.token_count(F.col("text")), F.lit(0)))
    return Q.hits(spark, d).select("query_id", "id", "rank", "score").join(c.withColumnRenamed("chunk_id", "id"), "id").select(*_COLS)


def boosted(spark, d) -> DataFrame:
    h = hits(spark, d)
    amount = R.boost(
        F.col("is_table"),
        F.array_contains("chunk_year", YEAR),
        F.contains(F.lower("section"), F.lit(SECTION)),
        F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(KEYWORD)),
        F.contains(F.lower("source_file"), F.lit(NAME)),
        F.lit(1),
        F.lit(0.0),
    )
    return h.withColumn("boosted", F.round(F.col("score") + amount, 8))


def budget(spark, d, by=("query_id",), share=1):
    return R.token_budget(hits(spark, d).withColumn("arm", F.pmod("rank", F.lit(2))), BUDGET // share, [F.asc("rank")], list(by))


def rerank(spark, d):
    """The default logit is the lexical overlap of query and hit."""
    q = chunks(spark, d).select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query_text"))
    h = hits(spark, d).join(q, "query_id")
    logit = 10 * T.overlap(T.answer_tokens(F.coalesce("query_text", F.lit(""))), T.answer_tokens(F.coalesce("text", F.lit("")))) - 5
    return h.select("query_id", "id", F.round(R.sigmoid(logit), 6).alias("rerank_score"))


def exact_dedup(spark, d):
    c = chunks(spark, d).filter("text is not null").withColumn("h", F.md5(F.lower(F.regexp_replace(T.strip(F.col("text")), r"[ \t\n\r\f\x0B]+", " "))))
    return R.dedup_max(c, ["h"], [F.asc("source_file"), F.asc("chunk_index"), F.asc("chunk_id")]).select("chunk_id")


def context_block(spark, d, each: int | None = None):
    """Hits in the order of rank as one block of tagged texts for each query."""
    h = hits(spark, d)
    if each:
        h = h.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source_file").orderBy("rank"))).filter(F.col("n") <= each)
    line = F.concat(F.lit("[Source: "), "source_file", F.lit(", Page "), F.coalesce("page_label", F.lit("?")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))
    return h.groupBy("query_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")).alias("block"))


def compare_block(spark, d):
    """As the plain block, one for each arm."""
    line = F.concat(F.lit("[Source: "), "source_file", F.lit("]\n"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))
    return hits(spark, d).groupBy("query_id", F.pmod("rank", F.lit(2)).cast("int").alias("arm")).agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")).alias("block"))


def arm_slots(spark, d):
    """Hits by arm, here their section: the slots of a query are shared out equally, at least one to each arm."""
    h = hits(spark, d).drop("rank").withColumn("arm", F.coalesce("section", F.lit("")))
    n = h.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.lit(10) / F.count_distinct("arm"))).alias("slots"))
    top = S.top(h, ["query_id", "arm"], [F.desc("score"), F.asc("id")], 10).join(n, "query_id")
    return top.filter("rank <= slots").select("query_id", "arm", "id", "rank")


def near_dup(spark, d):
    """Pairs of one fingerprint whose character shingles are alike in 0.85 of all.

    Texts over 500 characters have shingles of 12, shorter ones of 6; the two kinds have
    none in common. Texts equal but for case and white space are one class and give one
    row with the class; shingles are made for pairs of classes only, so that texts alone are shuffled.
    """
    t = F.lower(F.regexp_replace(T.strip(F.col("text")), r"[ \t\n\r\f\x0B]+", " "))
    c = chunks(spark, d).select("chunk_id", t.alias("t"), T.fingerprint(F.col("text")).alias("f"), T.shingle_size(F.col("text")).alias("n")).filter("length(t) >= 6")
    c = c.groupBy("f", "n", "t").agg(F.min("chunk_id").alias("chunk_id"))
    pairs = equal_blocks(c, ["f", "n"], "chunk_id", ["t"]).select("a", "b", "n", F.col("t_a").alias("one"), F.col("t_b").alias("two"))

    def shingles(t: str, n: int) -> set[str]:
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, last = [], None
            for r in batch.itertuples(index=False):
                if r.a != last:  # a text's pairs mostly come in a row
                    last, own = r.a, shingles(r.one, r.n)
                other = shingles(r.two, r.n)
                common = len(own & other)
                similarity = round(common / max(len(own) + len(other) - common, 1), 6)
                if similarity >= 0.85:
                    out.append((r.a, r.b, similarity))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return pairs.mapInPandas(verify, "a string, b string, similarity double")


def near_classes(spark, d):
    """The class of each chunk: the least chunk of those whose text is equal but for case and white space."""
    t = F.lower(F.regexp_replace(T.strip(F.col("text")), r"[ \t\n\r\f\x0B]+", " "))
    c = chunks(spark, d).select("chunk_id", F.md5(t).alias("h"), T.fingerprint(F.col("text")).alias("f"), T.shingle_size(F.col("text")).alias("n"), F.length(t).alias("l")).filter("l >= 6")
    return c.withColumn("class", F.min("chunk_id").over(Window.partitionBy("h", "f", "n"))).select("chunk_id", "class")


def containment(spark, d):
    """Blocks of a scanned page that stay when repeated texts and those that hold nearly all of an earlier one go; each block comes again with a letter more."""
    b = table(spark, d, "blocks").distinct().filter("content is not null").select("doc_id", "page_no", "block_index", "content")
    again = b.select("doc_id", "page_no", (F.col("block_index") + 100_000).alias("block_index"), F.concat("content", F.when(F.pmod("block_index", F.lit(2)) == 0, F.lit(" x")).otherwise(F.lit("  "))).alias("content"))
    return L.dedup_texts(b.unionByName(again), ["doc_id", "page_no"], "block_index", "content").select("doc_id", "page_no", "block_index")


QUERIES = {
    "hit_counts": lambda spark, d: hits(spark, d).groupBy("source_file", "chunk_index").agg(F.count("*").alias("hits")),
    "dedup_max_score": lambda spark, d: R.dedup_max(hits(spark, d), ["id"], [F.desc("score"), F.asc("query_id")]).select("id", "query_id", "score"),
    "exact_dedup": exact_dedup,
    "context_dedup": lambda spark, d: R.dedup_max(hits(spark, d).withColumn("h", F.md5(F.lower(T.strip(F.coalesce("text", F.lit("")))))), ["query_id", "h"], [F.asc("rank")]).select("query_id", "id"),
    "near_dup_pairs": near_dup,
    "near_dup_classes": near_classes,
    "containment_dedup": containment,
    "rerank_sigmoid": rerank,
    "score_boosts": lambda spark, d: boosted(spark, d).select("query_id", "id", "boosted"),
    "threshold_cap": lambda spark, d: R.threshold_cap(hits(spark, d), "score", 0.30, 10).select("query_id", "id", "place"),
    "diversity_cap": lambda spark, d: R.diversity_cap(hits(spark, d), 6, 4).select("query_id", "id", "doc_rank", "in_doc"),
    "arm_slots": arm_slots,
    "token_budget": lambda spark, d: budget(spark, d).select("query_id", "id", F.col("running_tokens").alias("running")),
    "token_budget_arms": lambda spark, d: budget(spark, d, ("query_id", "arm"), 2).select("query_id", F.col("arm").cast("int"), "id", F.col("running_tokens").alias("running")),
    "priority_order": lambda spark, d: hits(spark, d).select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.coalesce("is_table", F.lit(False)), 0).otherwise(1), F.desc("score"), "id")).cast("int").alias("place")),
    "source_rollup": lambda spark, d: R.source_rollup(hits(spark, d), ["query_id"]),
    "retrieval_strength": lambda spark, d: hits(spark, d).filter("rank <= 3").groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("strength")),
    "context_summary": lambda spark, d: hits(spark, d).groupBy("query_id").agg(F.coalesce(F.bool_or("is_table"), F.lit(False)).alias("has_tables"), F.bool_or(F.col("score") < 0.35).alias("has_weak_match"), F.count("*").alias("chunks_used"), F.count_distinct("source_file").alias("sources_count")),
    "context_block_direct": context_block,
    "context_block_synthesize": lambda spark, d: context_block(spark, d, 2),
    "context_block_compare": compare_block,
    "neighbor_expansion": lambda spark, d: R.neighbours(stage(hits(spark, d), "hits"), chunks(spark, d)),
}

H = f"""{Q.fused()},
x AS (SELECT h.query_id, h.id, h.rank, h.score, c.source_file, c.chunk_index, c.text, c.section, c.page_label, c.is_table, c.chunk_year,
  coalesce(len(regexp_extract_all(c.text, '([^ \\t\\n\\r\\f\\x0B]+)', 1)), 0) AS tokens FROM h JOIN c ON c.chunk_id = h.id)"""
_STRIP = r"regexp_replace({c}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
_ANSWER = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '([A-Za-z0-9_]+)', 1), lambda t: length(t) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.ANSWER_STOP_WORDS) + "], t)))"
BOOST_SQL = f"""(CASE WHEN coalesce(is_table, false) THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN coalesce(list_contains(chunk_year, '{YEAR}'), false) THEN 0.03::DOUBLE ELSE 0 END
 + CASE WHEN coalesce(contains(lower(section), '{SECTION}'), false) THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN coalesce(contains(lower(source_file), '{NAME}'), false) THEN 0.03::DOUBLE ELSE 0 END
 + CASE WHEN contains(lower(coalesce(text, '')), '{KEYWORD}') THEN 0.02::DOUBLE ELSE -0.01::DOUBLE END)"""


def _budget(part: str, budget: int) -> str:
    return f"""WITH {H}, y AS (SELECT *, (rank % 2)::INT AS arm FROM x),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY {part} ORDER BY rank) AS running FROM y),
s AS (SELECT *, max(CASE WHEN NOT coalesce(is_table, false) AND running > {budget} THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY rank) AS stop FROM b)
SELECT {part}, id, running::BIGINT AS running FROM s WHERE stop = 0"""


def _block(line: str, extra: str = "", group: str = "query_id", src: str = "x") -> str:
    return f"SELECT {group}{extra}, md5(string_agg({line}, chr(10) || chr(10) ORDER BY rank)) AS block FROM {src} GROUP BY ALL"


_LINE = "'[Source: ' || source_file || ', Page ' || coalesce(page_label, '?') || ']' || chr(10) || coalesce(text, '')"
_FP = r"""md5(array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '([0-9]+)', 1),
  list_transform(list_filter(regexp_extract_all(text, '([A-Za-z0-9_]+)', 1), lambda t: regexp_full_match(t, '(19|20)[0-9]{2}')), lambda t: t[1:2])),
  (regexp_extract_all(text, '([A-Z][a-z]+(?:[ \t\n\r]+[A-Z][a-z]+)*)', 1))[1:5]))), '|'))[1:8]"""
_PAGE_ORDER = "CASE WHEN regexp_full_match(replace(page_label, '~', ''), '[0-9]{1,9}') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(replace(page_label, '~', ''), '[0-9]{1,9}') THEN replace(page_label, '~', '')::INT ELSE 0 END, page_label"

SQL = {
    "hit_counts": f"WITH {H} SELECT source_file, chunk_index, count(*) AS hits FROM x GROUP BY ALL",
    "dedup_max_score": f"WITH {H} SELECT DISTINCT ON (id) id, query_id, score FROM x ORDER BY id, score DESC, query_id",
    "exact_dedup": f"WITH {Q.C} SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower(regexp_replace({_STRIP.format(c='text')}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) ORDER BY source_file NULLS FIRST, chunk_index NULLS FIRST, chunk_id) AS n FROM c WHERE text IS NOT NULL) WHERE n = 1",
    "context_dedup": f"WITH {H} SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, md5(lower({_STRIP.format(c=chr(99) + 'oalesce(text, chr(32))')})) ORDER BY rank) AS n FROM x) WHERE n = 1",
    "near_dup_pairs": f"""WITH {Q.C}, l AS (SELECT chunk_id, {_FP} AS f, CASE WHEN length(text) > 500 THEN 12 ELSE 6 END AS n, lower(regexp_replace({_STRIP.format(c='text')}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM c),
k AS (SELECT f, n, t, min(chunk_id) AS chunk_id FROM l WHERE length(t) >= 6 GROUP BY ALL),
s AS (SELECT chunk_id, f, n, list_distinct(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) AS s FROM k WHERE (f, n) IN (SELECT (f, n) FROM k GROUP BY f, n HAVING count(*) > 1)),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS u FROM s a JOIN s b ON a.f = b.f AND a.n = b.n AND a.chunk_id < b.chunk_id)
SELECT a, b, round(i / greatest(u - i, 1), 6) AS similarity FROM p WHERE round(i / greatest(u - i, 1), 6) >= 0.85""",
    "near_dup_classes": f"""WITH {Q.C}, l AS (SELECT chunk_id, {_FP} AS f, CASE WHEN length(text) > 500 THEN 12 ELSE 6 END AS n, lower(regexp_replace({_STRIP.format(c='text')}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM c)
SELECT chunk_id, min(chunk_id) OVER (PARTITION BY f, n, t) AS class FROM l WHERE length(t) >= 6""",
    "rerank_sigmoid": f"""WITH {H}, t AS (SELECT x.query_id, x.id, {_ANSWER.format(c='q.text')} AS q, {_ANSWER.format(c='x.text')} AS a FROM x JOIN c q ON q.chunk_id = x.query_id)
SELECT query_id, id, round(1 / (1 + exp(-(10 * CASE WHEN len(q) = 0 OR len(a) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END - 5))), 6) AS rerank_score FROM t""",
    "score_boosts": f"WITH {H} SELECT query_id, id, round(score + {BOOST_SQL}, 8) AS boosted FROM x",
    "threshold_cap": f"WITH {H} SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS place FROM x WHERE score >= 0.3) WHERE place <= 10",
    "diversity_cap": f"""WITH {H}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id, source_file) AS best, row_number() OVER (PARTITION BY query_id, source_file ORDER BY score DESC, id)::INT AS in_doc FROM x)
SELECT query_id, id, doc_rank, in_doc FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, source_file)::INT AS doc_rank FROM b) WHERE doc_rank <= 6 AND in_doc <= 4""",
    "arm_slots": f"WITH {H}, a AS (SELECT *, coalesce(section, '') AS arm FROM x), n AS (SELECT query_id, greatest(1, 10 // count(DISTINCT arm)) AS slots FROM a GROUP BY 1) SELECT query_id, arm, id, rank FROM (SELECT query_id, arm, id, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, id)::INT AS rank FROM a) JOIN n USING (query_id) WHERE rank <= slots",
    "token_budget": _budget("query_id", BUDGET),
    "token_budget_arms": _budget("query_id, arm", BUDGET // 2),
    "priority_order": f"WITH {H} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN coalesce(is_table, false) THEN 0 ELSE 1 END, score DESC, id)::INT AS place FROM x",
    "source_rollup": f"""WITH {H}, pg AS (SELECT DISTINCT query_id, source_file, page_label FROM x WHERE coalesce(page_label, '') <> ''),
l AS (SELECT query_id, source_file, string_agg(page_label, ',' ORDER BY {_PAGE_ORDER}) AS pages FROM pg GROUP BY ALL)
SELECT n.query_id, n.source_file, coalesce(l.pages, '') AS pages, n.chunks FROM (SELECT query_id, source_file, count(*) AS chunks FROM x GROUP BY ALL) n LEFT JOIN l ON n.query_id = l.query_id AND n.source_file = l.source_file""",
    "retrieval_strength": f"WITH {H} SELECT query_id, round(avg(score), 6) AS strength FROM x WHERE rank <= 3 GROUP BY ALL",
    "context_summary": f"WITH {H} SELECT query_id, coalesce(bool_or(is_table), false) AS has_tables, bool_or(score < 0.35) AS has_weak_match, count(*) AS chunks_used, count(DISTINCT source_file) AS sources_count FROM x GROUP BY ALL",
    "context_block_direct": f"WITH {H} " + _block(_LINE),
    "context_block_synthesize": f"WITH {H}, y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) AS n FROM x) WHERE n <= 2) " + _block(_LINE, src="y"),
    "context_block_compare": f"WITH {H} " + _block("'[Source: ' || source_file || ']' || chr(10) || coalesce(text, '')", ", (rank % 2)::INT AS arm"),
    "neighbor_expansion": f"""WITH {H}, w AS (SELECT query_id, source_file, chunk_index + o AS ci, id AS anchor, score, rank FROM x, (VALUES (-1), (1)) v(o)),
f AS (SELECT w.query_id, c.chunk_id, w.score, w.anchor, row_number() OVER (PARTITION BY w.query_id, c.chunk_id ORDER BY w.rank, w.anchor) AS n FROM w JOIN c ON c.source_file = w.source_file AND c.chunk_index = w.ci
  WHERE NOT EXISTS (FROM x WHERE x.query_id = w.query_id AND x.id = c.chunk_id))
SELECT query_id, chunk_id, round(score - 0.05, 8) AS score, anchor FROM f WHERE n = 1""",
}
