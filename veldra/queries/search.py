"""Search over the chunks' own vectors and over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veldra.functions import text as T, vectors as V
from veldra.operators import search as S
from veldra.tables import chunks, table

#: Chunks that serve as queries, all others being searched as well: those whose id, read as a number, is divisible by 100.
QUERY_FILTER = "cast(conv(substring(chunk_id, 1, 8), 16, 10) as bigint) % 100 = 0"
QUERY_SQL = "('0x' || chunk_id[1:8])::BIGINT % 100 = 0"


def base(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select(F.col("chunk_id").alias("id"), F.col("dense").alias("vector"), "sparse")


def query_set(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter(QUERY_FILTER).select(F.col("chunk_id").alias("query_id"), F.col("dense").alias("vector"), "sparse")


def dense(spark, d):
    """Cosine search on the embeddings: each hundredth as a query against all."""
    e = table(spark, d, "embeddings")
    return S.dense_topk(e, e.filter("vec_id % 100 = 0"), 10, "vec_id", "embedding", "vec_id").select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def hits(spark, d, k: int = 20, **kw) -> DataFrame:
    return S.hybrid(base(spark, d), query_set(spark, d), k, **kw)


def relaxation(spark, d):
    """Filters dropped one after another until six chunks match: (keyword, year), (year), none."""
    c = chunks(spark, d)
    levels = [S.metadata_filter({"doc_year": "2018", "section": "Background"}), S.metadata_filter({"doc_year": "2018"}), F.lit(True)]
    flags = c.select("chunk_id", *(f.alias(f"m{i}") for i, f in enumerate(levels)))
    counts = flags.agg(*(F.count_if(f"m{i}").alias(f"n{i}") for i in range(3)))
    level = F.when(F.col("n0") >= 6, 0).when(F.col("n1") >= 6, 1).otherwise(2)
    both = flags.crossJoin(F.broadcast(counts)).withColumn("level", level)  # one row of counts
    return both.filter(F.when(F.col("level") == 0, F.col("m0")).when(F.col("level") == 1, F.col("m1")).otherwise(F.col("m2"))).select("chunk_id", F.col("level").cast("int"))


def semantic_cache(spark, d):
    """For each query vector the earliest earlier one with a cosine of at least 0.95; chunks with whole vectors, in the order of their number."""
    v = chunks(spark, d).filter("size(dense) = 64").select(F.conv(F.substring("chunk_id", 1, 8), 16, 10).cast("bigint").alias("n"), F.col("dense").alias("v"))
    v = v.groupBy("n").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.count("*").alias("c")).filter("c = 1")
    return S.earliest_alike(v, v.filter("n % 10 = 0"), 0.95, "n", "v", "n")


QUERIES = {
    "dense_topk": dense,
    "cosine": lambda spark, d: (lambda e: e.alias("a").join(e.alias("b"), F.expr("a.vec_id + 1 = b.vec_id")).select(F.col("a.vec_id").alias("vec_id"), F.round(V.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine")))(table(spark, d, "embeddings")),
    "l2_normalize": lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x")),
    "semantic_cache_hits": semantic_cache,
    "chunk_dense_topk": lambda spark, d: S.dense_topk(base(spark, d), query_set(spark, d), 60),
    "sparse_topk": lambda spark, d: S.sparse_topk(base(spark, d), query_set(spark, d), 40),
    "minmax_normalize": lambda spark, d: (lambda s: s.select("query_id", "id", F.round(S.minmax(s, "score"), 6).alias("score")))(S.sparse_topk(base(spark, d), query_set(spark, d), 40)),
    "hybrid_search": hits,
    "hybrid_search_b": lambda spark, d: hits(spark, d, 13, dense_times=5, sparse_times=2, dense_weight=0.85, sparse_weight=0.15),
    "bm25_weights": lambda spark, d: S.bm25_weights(table(spark, d, "documents"), "doc_id", T.tokens(F.lower("text"))),
    "bm25_idf_weights": lambda spark, d: S.bm25_weights(table(spark, d, "documents"), "doc_id", T.tokens(F.lower("text")), idf=True),
    "metadata_filter": lambda spark, d: chunks(spark, d).filter(S.metadata_filter({"has_tables": True, "chunk_year": ["2018", "2019"], "keywords": ["solar brackets"]})).select("chunk_id"),
    "year_or_filter": lambda spark, d: chunks(spark, d).filter(S.year_or_filter("2018")).select("chunk_id"),
    "filename_or_filter": lambda spark, d: chunks(spark, d).filter(S.filename_or_filter(["orders", "order", "circular"])).select("chunk_id"),
    "filter_relaxation": relaxation,
}

C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_VALID = "len(dense) = {n} AND list_sum(list_transform(dense, lambda y: y::DOUBLE * y)) > 0"


def legs(dense_k: int = 60, sparse_k: int = 40) -> str:
    """SQL of both legs: dl and sl, with c before them."""
    dims = " UNION ALL ".join(f"SELECT q.chunk_id AS query_id, v.chunk_id AS id, round(array_cosine_similarity(q.dense::DOUBLE[{n}], v.dense::DOUBLE[{n}]), 6) AS score FROM (SELECT * FROM c WHERE {_VALID.format(n=n)} AND {QUERY_SQL}) q CROSS JOIN (SELECT * FROM c WHERE {_VALID.format(n=n)}) v" for n in (64, 32))
    return f"""{C},
da AS ({dims}),
dl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM da) WHERE rank <= {dense_k}),
p AS (SELECT chunk_id, chunk_index, unnest(map_keys(sparse)) AS term, unnest(map_values(sparse))::DOUBLE AS w FROM c),
sa AS (SELECT q.chunk_id AS query_id, v.chunk_id AS id, round(sum(q.w * v.w), 6) AS score FROM (SELECT * FROM p WHERE {QUERY_SQL}) q JOIN p v ON q.term = v.term GROUP BY ALL),
sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sa) WHERE rank <= {sparse_k})"""


def fused(k: int = 20, dense_k: int = 60, sparse_k: int = 40, wd: float = 0.7, ws: float = 0.3) -> str:
    return f"""{legs(dense_k, sparse_k)},
fj AS (SELECT coalesce(dl.query_id, sl.query_id) AS query_id, coalesce(dl.id, sl.id) AS id, coalesce(dl.score, 0) AS dense_score, coalesce(sl.score, 0) AS sparse_score
  FROM dl FULL JOIN sl ON dl.query_id = sl.query_id AND dl.id = sl.id),
fw AS (SELECT *, min(dense_score) OVER q AS d0, max(dense_score) OVER q AS d1, min(sparse_score) OVER q AS s0, max(sparse_score) OVER q AS s1 FROM fj WINDOW q AS (PARTITION BY query_id)),
fs AS (SELECT query_id, id, dense_score, sparse_score, round({wd} * CASE WHEN d1 = d0 THEN 0 ELSE (dense_score - d0) / (d1 - d0) END + {ws} * CASE WHEN s1 = s0 THEN 0 ELSE (sparse_score - s0) / (s1 - s0) END, 8) AS score FROM fw),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fs) WHERE rank <= {k})"""


_BM25 = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([A-Za-z0-9_]+)', 1) AS w FROM documents),
m AS (SELECT avg(len(w)) AS mean, count(*) AS n FROM t),
f AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM f GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)
SELECT doc_id AS id, term, round(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean)){idf}, 6) AS weight FROM tf JOIN df USING (term) CROSS JOIN m"""
_E = "round(array_cosine_similarity(q.embedding::DOUBLE[64], e.embedding::DOUBLE[64]), 6)"
_EK = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_E} AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= "

SQL = {
    "dense_topk": _EK + "10",
    "cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id",
    "l2_normalize": "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS i, round(unnest(embedding)::DOUBLE / n, 6) AS x FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))) AS n FROM embeddings)",
    "semantic_cache_hits": f"WITH {C}, w AS (SELECT ('0x' || chunk_id[1:8])::BIGINT AS n, any_value(dense) AS v FROM c WHERE {_VALID.format(n=64)} GROUP BY 1 HAVING count(*) = 1) SELECT q.n AS query_id, min(e.n) AS hit FROM w q JOIN w e ON e.n < q.n WHERE q.n % 10 = 0 AND round(array_cosine_similarity(q.v::DOUBLE[64], e.v::DOUBLE[64]), 6) >= 0.95 GROUP BY 1",
    "chunk_dense_topk": f"WITH {legs()} SELECT query_id, id, score, rank::INT AS rank FROM dl",
    "sparse_topk": f"WITH {legs()} SELECT query_id, id, score, rank::INT AS rank FROM sl",
    "minmax_normalize": f"WITH {legs()} SELECT query_id, id, round(CASE WHEN max(score) OVER q = min(score) OVER q THEN 0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END, 6) AS score FROM sl WINDOW q AS (PARTITION BY query_id)",
    "hybrid_search": f"WITH {fused()} SELECT * FROM h",
    "hybrid_search_b": f"WITH {fused(13, 65, 26, 0.85, 0.15)} SELECT * FROM h",
    "bm25_weights": _BM25.format(idf=""),
    "bm25_idf_weights": _BM25.format(idf=" * ln(1 + (n - df + 0.5) / (df + 0.5))"),
    "metadata_filter": f"WITH {C} SELECT chunk_id FROM c WHERE has_tables AND (list_contains(chunk_year, '2018') OR list_contains(chunk_year, '2019') OR list_contains(keywords, 'solar brackets'))",
    "year_or_filter": f"WITH {C} SELECT chunk_id FROM c WHERE coalesce(doc_year = '2018', false) OR coalesce(list_contains(chunk_year, '2018'), false)",
    "filename_or_filter": f"WITH {C} SELECT chunk_id FROM c WHERE coalesce(list_has_any(filename_tokens, ['orders', 'order', 'circular']), false)",
    "filter_relaxation": f"""WITH {C}, f AS (SELECT chunk_id, coalesce(doc_year = '2018' AND section = 'Background', false) AS m0, coalesce(doc_year = '2018', false) AS m1 FROM c),
l AS (SELECT (CASE WHEN count(*) FILTER (m0) >= 6 THEN 0 WHEN count(*) FILTER (m1) >= 6 THEN 1 ELSE 2 END)::INT AS level FROM f)
SELECT chunk_id, level FROM f, l WHERE CASE level WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE true END""",
}
