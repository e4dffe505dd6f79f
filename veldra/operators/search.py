"""Dense, sparse and hybrid search of many queries at once, and metadata filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries sent to the executors at once, the most that is broadcast; more take more passes.
QUERIES_PER_PASS = 2_000


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).filter(F.col("rank") <= k)


def _scored(base: DataFrame, queries: DataFrame, choose: Callable[[np.ndarray, list, pa.Array], tuple[np.ndarray, np.ndarray]], id_col: str, vector_col: str, query_col: str) -> DataFrame:
    """``query_id, id, score`` of the (query, row) that ``choose`` takes from a batch's scores, query ids and row ids."""
    q_type = to_arrow_type(queries.schema[query_col].dataType)
    kinds = dict(base.dtypes)[id_col], dict(queries.dtypes)[query_col]
    wanted = queries.select(F.col(query_col).alias("q"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size("v") > 0) & F.exists("v", lambda x: x != 0)).distinct()
    total = wanted.count()
    passes = max(1, -(-total // QUERIES_PER_PASS))
    rows = base.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size("v") > 0) & F.exists("v", lambda x: x != 0))
    parts = []
    for p in range(passes):
        block = (wanted if passes == 1 else wanted.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)).orderBy("q").toPandas()
        by_dim: dict[int, tuple[list, np.ndarray]] = {}
        for dim in sorted(set(block["v"].map(len))):
            own = block[block["v"].map(len) == dim]
            x = np.array(own["v"].tolist(), np.float64).reshape(-1, dim)
            by_dim[dim] = own["q"].tolist(), x / np.linalg.norm(x, axis=1, keepdims=True)

        def search(batches: Iterator[pa.RecordBatch], by_dim: dict = by_dim) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("v")
                sizes = np.diff(lists.offsets.to_numpy())
                for dim, (ids, q) in by_dim.items():
                    at = np.flatnonzero(sizes == dim)
                    if not len(at):
                        continue
                    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    good = np.isfinite(length[:, 0])
                    at, x = at[good], x[good] / length[good]
                    score = np.round(q @ x.T, 6)
                    if not len(at):
                        continue
                    row, col = choose(score, ids, batch.column("id").take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row], q_type), batch.column("id").take(pa.array(at[col])), pa.array(score[row, col])], ["query_id", "id", "score"])

        parts.append(rows.mapInArrow(search, f"query_id {kinds[1]}, id {kinds[0]}, score double"))
    return reduce(DataFrame.unionByName, parts)


def dense_topk(base: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id") -> DataFrame:
    """``query_id, id, score, rank``: the k rows of ``base`` with the highest cosine for each query.

    Exact. The queries are sent in blocks; every task keeps the k best of its rows for
    each, so only those are shuffled. Vectors that are null, empty, all zero or of another
    length than a block's queries don't take part. Scores have 6 decimals, ties go by id.
    """

    def best(score: np.ndarray, ids: list, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = min(k, score.shape[1])
        # Everything from the n-th best score on: ties are settled by id later.
        least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
        return np.nonzero(score >= least[:, None])

    return top(_scored(base, queries, best, id_col, vector_col, query_col), ["query_id"], [F.desc("score"), F.asc("id")], k)


def earliest_alike(base: DataFrame, queries: DataFrame, least: float, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id") -> DataFrame:
    """``query_id, hit``: for each query the least id below its own of which the cosine is ``least`` or more.

    Exact, however many rows are alike: every task keeps the least id of a batch for each query.
    """

    def first(score: np.ndarray, ids: list, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = own.to_numpy(zero_copy_only=False)
        order = np.argsort(own, kind="stable")
        good = (score >= least) & (own < np.array(ids, own.dtype)[:, None])
        row = np.flatnonzero(good.any(axis=1))
        return row, order[good[row][:, order].argmax(axis=1)]

    return _scored(base, queries, first, id_col, vector_col, query_col).groupBy("query_id").agg(F.min("id").alias("hit"))


class SparseQueries:
    """A block of sparse queries by term, and their dot products with rows."""

    def __init__(self, vectors: list[dict]) -> None:
        self.n = len(vectors)
        query = np.repeat(np.arange(self.n), [len(v) for v in vectors]) if self.n else np.zeros(0, np.int64)
        term = np.array([t for v in vectors for t in v], np.int64)
        weight = np.array([w for v in vectors for w in v.values()], np.float64)
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.terms, self.begin = np.unique(term[order], return_index=True)
        self.begin = np.append(self.begin, len(term))

    def scores(self, maps: pa.MapArray, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of the queries by row, 6 decimals, -inf without a common term), for runs of rows."""
        offsets = maps.offsets.to_numpy()
        keys, items = maps.keys.to_numpy(zero_copy_only=False).astype(np.int64), maps.items.to_numpy(zero_copy_only=False).astype(np.float64)
        step = max(1, most // max(self.n, 1))
        for lo in range(0, len(maps), step):
            hi = min(lo + step, len(maps))
            own = slice(offsets[lo], offsets[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            yield lo, np.round(self.products(row, keys[own], items[own], hi - lo), 6)

    def products(self, row: np.ndarray, keys: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
        """Dot products of the queries by row with n rows given as (row, term, weight); -inf without a common term."""
        at = np.searchsorted(self.terms, keys)
        at[at == len(self.terms)] = 0
        good = self.terms[at] == keys if len(self.terms) else np.zeros(len(at), bool)
        row, at, w = row[good], at[good], items[good]
        count = self.begin[at + 1] - self.begin[at]
        posting = np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cell = self.query[posting] * n + np.repeat(row, count)
        total = np.bincount(cell, self.weight[posting] * np.repeat(w, count), self.n * n).astype(np.float64, copy=False)  # whole numbers if empty
        if (self.weight > 0).all() and (w > 0).all():
            total[total == 0] = -np.inf
        else:
            met = np.zeros(self.n * n, bool)
            met[cell] = True
            total[~met] = -np.inf
        return total.reshape(self.n, n)


def best_cells(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's k highest finite scores, and of all that equal the k-th: ties are settled by id later."""
    n = min(k, score.shape[1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
    return np.nonzero((score >= least[:, None]) & np.isfinite(score))


def best_rounded(score: np.ndarray, k: int, width: int = 16, slack: float = 1e-6, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score in 6 decimals) of the same cells by the rounded scores; only what may be among them is rounded and sorted.

    The k-th highest of the maxima of runs of rows is no higher than the k-th highest score.
    ``exact`` gives the scores of cells where ``score`` is only within half of ``slack`` of them.
    """
    n = score.shape[1]
    if n >= 2 * k * width:
        whole = n // width * width
        top = score[:, :whole].reshape(len(score), -1, width).max(axis=2)
        low = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k] - slack
        r, c = np.nonzero(score >= np.maximum(low, np.finfo(score.dtype).min)[:, None])
    elif n > 2 * k:
        low = np.partition(score, n - k, axis=1)[:, n - k] - slack
        r, c = np.nonzero(score >= np.maximum(low, np.finfo(score.dtype).min)[:, None])
    else:
        r, c = np.nonzero(np.isfinite(score))
    v = np.round(score[r, c] if exact is None else exact(r, c), 6)
    order = np.lexsort((-v, r))
    r, c, v = r[order], c[order], v[order]
    begin = np.searchsorted(r, np.arange(len(score) + 1))
    kth = np.minimum(begin[:-1] + k, begin[1:]) - 1
    least = np.full(len(score), np.inf)
    some = begin[1:] > begin[:-1]
    least[some] = v[kth[some]]
    good = v >= least[r]
    return r[good], c[good], v[good]


def sparse_topk(base: DataFrame, queries: DataFrame, k: int, id_col: str = "id", sparse_col: str = "sparse", query_col: str = "query_id") -> DataFrame:
    """``query_id, id, score, rank``: the k rows with the highest dot product of sparse vectors.

    Exact. The queries are sent in blocks, by term; every task adds up its rows' products and
    keeps the k best for each query, so a term in very many rows is no hot key and no
    posting is shuffled. Rows without a common term aren't found. Null vectors take no part.
    """
    q_type = to_arrow_type(queries.schema[query_col].dataType)
    kinds = dict(base.dtypes)[id_col], dict(queries.dtypes)[query_col]
    wanted = queries.select(F.col(query_col).alias("q"), F.map_entries(F.col(sparse_col).cast("map<bigint,double>")).alias("s")).filter(F.col("q").isNotNull() & F.col("s").isNotNull()).dropDuplicates(["q"])
    passes = max(1, -(-wanted.count() // QUERIES_PER_PASS))
    rows = base.select(F.col(id_col).alias("id"), F.col(sparse_col).cast("map<bigint,double>").alias("s")).filter("s is not null")
    parts = []
    for p in range(passes):
        own = wanted.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).orderBy("q").collect()
        ids, block = [r["q"] for r in own], SparseQueries([{e["key"]: e["value"] for e in r["s"]} for r in own])

        def search(batches: Iterator[pa.RecordBatch], ids: list = ids, block: SparseQueries = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, score in block.scores(batch.column("s")):
                    row, col = best_cells(score, k)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row], q_type), batch.column("id").take(pa.array(lo + col)), pa.array(score[row, col])], ["query_id", "id", "score"])

        parts.append(rows.mapInArrow(search, f"query_id {kinds[1]}, id {kinds[0]}, score double"))
    return top(reduce(DataFrame.unionByName, parts), ["query_id"], [F.desc("score"), F.asc("id")], k)


def minmax(df: DataFrame, col: str, by: str = "query_id") -> Column:
    """The column scaled to 0..1 within its group; 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high == low, 0.0).otherwise((F.col(col) - low) / (high - low))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 0.70, sparse_weight: float = 0.30) -> DataFrame:
    """``query_id, id, dense_score, sparse_score, score, rank``: a full outer join of both legs, a missing score counting 0."""
    both = dense.select("query_id", "id", F.col("score").alias("dense_score")).join(sparse.select("query_id", "id", F.col("score").alias("sparse_score")), ["query_id", "id"], "full_outer").fillna(0.0)
    both = both.withColumn("d", minmax(both, "dense_score")).withColumn("s", minmax(both, "sparse_score"))
    both = both.withColumn("score", F.round(dense_weight * F.col("d") + sparse_weight * F.col("s"), 8)).drop("d", "s")
    return top(both, ["query_id"], [F.desc("score"), F.asc("id")], k)


def hybrid(base: DataFrame, queries: DataFrame, k: int = 20, dense_times: int = 3, sparse_times: int = 2, dense_weight: float = 0.70, sparse_weight: float = 0.30) -> DataFrame:
    """Dense and sparse search, fused. ``base``: id, vector, sparse; ``queries``: query_id, vector, sparse."""
    return fuse(dense_topk(base, queries, dense_times * k), sparse_topk(base, queries, sparse_times * k), k, dense_weight, sparse_weight)


def metadata_filter(hints: dict, array_fields: frozenset[str] = frozenset({"chunk_year", "filename_tokens", "keywords"})) -> Column:
    """Scalars must all hold; all listed values together form one group of which one must hold.

    On an array field, to equal means to be contained; ``source`` means ``source_file``.
    """

    def equals(field: str, value) -> Column:
        field = "source_file" if field == "source" else field
        return F.coalesce(F.array_contains(field, value) if field in array_fields else F.col(field) == value, F.lit(False))

    scalars = [equals(f, v) for f, v in hints.items() if not isinstance(v, list)]
    listed = [equals(f, x) for f, v in hints.items() if isinstance(v, list) for x in v]
    out = reduce(Column.__and__, scalars, F.lit(True))
    return out & reduce(Column.__or__, listed) if listed else out


def year_or_filter(year: str) -> Column:
    """The document's year or one of the chunk's."""
    return F.coalesce(F.col("doc_year") == year, F.lit(False)) | F.coalesce(F.array_contains("chunk_year", year), F.lit(False))


def filename_or_filter(tokens: list[str]) -> Column:
    """Any of some file-name tokens."""
    return F.coalesce(F.arrays_overlap("filename_tokens", F.array(*map(F.lit, tokens))), F.lit(False))


def bm25_weights(docs: DataFrame, id_col: str, tokens: Column, k1: float = 1.2, b: float = 0.75, idf: bool = False) -> DataFrame:
    """``id, term, weight``: saturated term frequencies, with inverse document frequencies if wanted."""
    listed = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    lengths = listed.select(F.avg(F.size("tokens")).alias("mean"), F.count("*").alias("n"))
    tf = listed.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    out = tf.crossJoin(F.broadcast(lengths))  # one row
    if idf:
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        weight = weight * F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        out = out.join(df, "term")
    return out.select("id", "term", F.round(weight, 6).alias("weight"))
