"""Retrieval for many analysed questions at once: query sets, filters by hints, relaxation, pools, hit counts.

A *unit* is what is retrieved for: a question, or one arm of a comparison. Its query set
are rows ``unit_id, sub, vector, sparse``, its filter the struct ``hints``: ``doc_year,
section, keywords, filename_tokens, source_file``, nulls asking for nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veldra.functions import text as T, vectors as V
from veldra.operators import search as S
from veldra.storage import keep, shared_dir, stage

HINTS = "struct<doc_year:string,section:string,keywords:array<string>,filename_tokens:array<string>,source_file:string>"
_SCALARS, _LISTS = ("doc_year", "section", "source_file"), ("keywords", "filename_tokens")
LEAST_ROWS = 6
#: The most levels that a filter has.
LEVELS = 3
#: Queries of a task; rows that it searches at once, and scores that it holds at once; queries side by side.
QUERIES_AT_ONCE, ROWS_AT_ONCE, CELLS_AT_ONCE, SIDE = 1_000, 65_536, 1_000_000, 256
#: Bytes of a part of the staged rows that is read or passed over as a whole.
PART_BYTES = 4 << 20
#: Terms that are columns of a product of matrices: at most so many, each in this share of the pairs of queries and rows.
HOT_TERMS, HOT_SHARE = 64, 0.002
FIELDS = ("doc_year", "section", "source_file", "keywords", "filename_tokens")


def _some(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _some_list(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def token_hints(c: Column) -> Column:
    """File-name tokens in lower case, those with blanks parted."""
    return _some_list(F.flatten(F.transform(c, lambda t: T.words(F.lower(t)))))


def hints_filter(doc_year: Column | None = None, section: Column | None = None, keywords: Column | None = None, filename_tokens: Column | None = None, source_file: Column | None = None, source: Column | None = None) -> Column:
    """Hints of a question as a filter; empty ones ask for nothing, ``source`` means the file."""
    text, many = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    return F.struct(
        (_some(doc_year) if doc_year is not None else text).alias("doc_year"),
        (_some(section) if section is not None else text).alias("section"),
        (_some_list(keywords) if keywords is not None else many).alias("keywords"),
        (token_hints(filename_tokens) if filename_tokens is not None else many).alias("filename_tokens"),
        F.coalesce(*(_some(c) for c in (source_file, source) if c is not None), text).alias("source_file"),
    ).cast(HINTS)


def arm_filter(arm: Column) -> Column:
    """Filter of an arm ``struct<label, year, filename_tokens>``."""
    return hints_filter(doc_year=arm["year"], filename_tokens=arm["filename_tokens"])


def levels(h: Column) -> Column:
    """The filter, then with the first of section, keywords, file-name tokens, year dropped, then none; a filter of nothing alone."""
    section, words, names = h["section"].isNotNull(), h["keywords"].isNotNull(), h["filename_tokens"].isNotNull()
    dated = h["doc_year"].isNotNull()
    one = F.struct(
        F.when(section | words | names, h["doc_year"]).alias("doc_year"),
        F.lit(None).cast("string").alias("section"),
        F.when(section, h["keywords"]).alias("keywords"),
        F.when(section | words, h["filename_tokens"]).alias("filename_tokens"),
        F.when(section | words | names | dated, h["source_file"]).alias("source_file"),
    ).cast(HINTS)
    none = hints_filter()
    return F.when(section | words | names | dated | h["source_file"].isNotNull(), F.array(h.cast(HINTS), one, none)).otherwise(F.array(none))


def matches(h: Column, row: Column | None = None) -> Column:
    """Whether a row (columns ``FIELDS``) fits a filter: all single values, and one of all listed ones together."""
    at = (lambda f: row[f]) if row is not None else F.col
    single = [h[f].isNull() | F.coalesce(at(f) == h[f], F.lit(False)) for f in _SCALARS]
    listed = [F.coalesce(F.arrays_overlap(at(f), h[f]), F.lit(False)) for f in _LISTS]
    none = h["keywords"].isNull() & h["filename_tokens"].isNull()
    return single[0] & single[1] & single[2] & (none | listed[0] | listed[1])


def query_set(improved: Column, subqueries: Column) -> Column:
    """The question, then its sub-queries, each text once, in order."""
    return F.array_distinct(F.concat(F.array(improved), F.filter(F.coalesce(F.transform(subqueries, lambda s: s["query"]), F.array().cast("array<string>")), lambda q: q.isNotNull())))


def score_subqueries(df: DataFrame, vector: str, subqueries: str, least: float = 0.60) -> DataFrame:
    """``subqueries`` (array of struct query, vector) as ``all_subqueries`` with their cosine to the question in 4 decimals, best first, and ``subqueries`` of those at ``least`` or over."""
    scored = F.transform(subqueries, lambda s: F.struct((-F.round(V.cosine(F.col(vector), s["vector"]), 4)).alias("w"), s["query"].alias("query")))
    best = F.transform(F.array_sort(scored), lambda s: F.struct(s["query"].alias("query"), (-s["w"]).alias("weight")))
    return df.withColumn("all_subqueries", best).withColumn("subqueries", F.filter("all_subqueries", lambda s: s["weight"] >= least))


class _Filters:
    """The distinct filters of a block of queries, and the rows of a batch that fit each."""

    def __init__(self, block: pd.DataFrame) -> None:
        found: dict[tuple, list[int]] = {}
        for i, h in enumerate(zip(*(block[f] for f in FIELDS))):
            single = tuple(None if v is None or v != v else v for v in h[: len(_SCALARS)])
            listed = tuple(tuple(v) if v is not None and len(v) else () for v in h[len(_SCALARS) :])
            found.setdefault((single, listed), []).append(i)
        self.queries = [(h, np.array(own)) for h, own in found.items()]
        self.listed = any(any(listed) for (_, listed), _ in self.queries)
        self.fields = FIELDS if self.listed else _SCALARS

    def wanted(self) -> dict[str, list[str]]:
        """The values of the fields for which every filter asks for one: no other rows fit any."""
        values = {f: {single[i] for (single, _), _ in self.queries} for i, f in enumerate(_SCALARS)}
        return {f: sorted(v) for f, v in values.items() if v and None not in v}

    def fitting(self, rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the filter, rows) for each that some rows fit: all single values, and one of all listed ones together."""
        codes, known = {}, {}
        for f in _SCALARS:
            codes[f], values = pd.factorize(rows[f])
            known[f] = {v: i for i, v in enumerate(values)}
        holders: dict[str, dict[str, list[int]]] = {f: {} for f in _LISTS}
        for f in _LISTS if self.listed else ():
            for i, values in enumerate(rows[f]):
                for v in values if values is not None else ():
                    holders[f].setdefault(v, []).append(i)
        for number, ((single, listed), _) in enumerate(self.queries):
            ok = np.ones(len(rows), bool)
            for f, value in zip(_SCALARS, single):
                if value is not None:
                    ok &= codes[f] == known[f].get(value, -2)
            if any(listed):
                some = np.zeros(len(rows), bool)
                for f, values in zip(_LISTS, listed):
                    for v in values:
                        some[holders[f].get(v, [])] = True
                ok &= some
            at = np.flatnonzero(ok)
            if len(at):
                yield number, at


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``ROWS_AT_ONCE`` rows, so that each filter meets many rows at once."""
    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


class Rows:
    """Rows to search (id, vector, sparse and ``FIELDS``), staged in the order of their years, sections and files.

    The tasks read them from the shared folder themselves, only the parts in which rows may fit their filters.
    """

    def __init__(self, base: DataFrame) -> None:
        spark = base.sparkSession
        self.id = base.schema["id"]
        self.path = f"{shared_dir(spark)}/veldra-pool-rows-{uuid.uuid4().hex}"
        keep(spark, self.path)
        rows = base.select("id", "vector", "sparse", *(F.col(f).cast("string").alias(f) for f in _SCALARS), *_LISTS)
        rows = rows.repartitionByRange(*_SCALARS, F.xxhash64("id")).sortWithinPartitions(*_SCALARS)
        rows.write.option("parquet.block.size", PART_BYTES).parquet(self.path)

    def read(self, columns: list[str], wanted: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if f.base_name.endswith(".parquet"))
        fit = None
        for f, values in wanted.items():
            # The range lets whole parts be passed over by their least and greatest values.
            own = (ds.field(f) >= values[0]) & (ds.field(f) <= values[-1])
            own = own & ds.field(f).isin(values) if len(values) > 1 else own
            fit = own if fit is None else fit & own
        if files:
            yield from ds.dataset(files, filesystem=fs, format="parquet").to_batches(columns=columns, filter=fit, use_threads=False, batch_readahead=1, fragment_readahead=1)


class _Best:
    """The rows with the k highest scores (6 decimals) of each of n queries, and all that equal the k-th, as more rows come."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf)
        self.held, self.new, self.cut_at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0, 0

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        score = np.round(score, 6)
        good = np.isfinite(score) & (score >= self.least[query])
        self.held.append((query[good], row[good], score[good]))
        self.new += int(good.sum())
        if self.new > self.cut_at:
            self.cut()

    def cut(self) -> None:
        q, row, v = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((-v, q))
        q, row, v = q[order], row[order], v[order]
        begin = np.searchsorted(q, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.least[full] = v[begin[full] + self.k - 1]
        good = v >= self.least[q]
        self.held = [(q[good], row[good], v[good])]
        # Thresholds rise only by a cut: one is worth while for as many again as half of what is asked for.
        self.new, self.cut_at = 0, self.n * self.k // 2

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.cut()
        return self.held[0]


def _tiles(queries: int, rows: int) -> Iterator[slice]:
    """Runs of the rows: a short one first, which sets thresholds."""
    step = max(1, CELLS_AT_ONCE // max(queries, 1))
    lo, hi = 0, max(1, step // 4)
    while lo < rows:
        yield slice(lo, min(hi, rows))
        lo, hi = hi, hi + step


class _Dense:
    """The most similar rows of a block of queries: products in single precision, what may be among the best in double."""

    def __init__(self, block: pa.Table, filters: _Filters, k: int) -> None:
        self.k = k
        lists = _one(block["v"])
        sizes = np.diff(lists.offsets.to_numpy())
        self.blocks: dict[int, list[tuple[np.ndarray, int, np.ndarray, np.ndarray, _Best]]] = {}
        for number, (_, own) in enumerate(filters.queries):
            for n in np.unique(sizes[own]).tolist():
                at = own[sizes[own] == n]
                x, good = _scaled(lists, at, n)
                at = at[good]
                for lo in range(0, len(at), SIDE):
                    q = x[lo : lo + SIDE]
                    self.blocks.setdefault(number, []).append((at[lo : lo + SIDE], n, q, q.astype(np.float32), _Best(len(q), k)))
        self.dims = {n for own in self.blocks.values() for _, n, *_ in own}

    def load(self, run: pa.Table, first: int) -> None:
        lists = _one(run["vector"])
        sizes = np.diff(lists.offsets.to_numpy())
        self.rows = {}
        for n in self.dims:
            at = np.flatnonzero(sizes == n)
            x, good = _scaled(lists, at, n)
            place = np.full(len(lists), -1)
            place[at[good]] = np.arange(good.sum())
            self.rows[n] = place, at[good] + first, x, x.astype(np.float32)

    def search(self, number: int, fit: np.ndarray) -> None:
        near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for _, n, q, q32, best in self.blocks.get(number, ()):
            place, rows, x, x32 = self.rows[n]
            if n not in near:
                at = place[fit]
                at = at[at >= 0]
                near[n] = at, x32[at]
            at, own = near[n]
            # A product of unit vectors in single precision is off by less than (n + 2) * 6e-8.
            slack = 2.4e-7 * (n + 2) + 1e-6
            for tile in _tiles(len(q), len(at)):
                score, some = q32 @ own[tile].T, at[tile]
                exact = lambda r, c: np.einsum("ij,ij->i", q[r], x[some[c]])  # noqa: B023, E731
                if np.isneginf(best.least).any():
                    r, c, v = S.best_rounded(score, self.k, slack=slack, exact=exact)
                else:
                    r, c = np.nonzero(score >= (best.least - slack).astype(np.float32)[:, None])
                    v = exact(r, c)
                best.add(r, rows[some[c]], v)


class _Postings:
    """(term, query, weight) of a block of queries by the number of the term."""

    def __init__(self, term: np.ndarray, query: np.ndarray, weight: np.ndarray, terms: int) -> None:
        order = np.argsort(term, kind="stable")
        self.term, self.query, self.weight = term[order], query[order], weight[order]
        self.count = np.bincount(term, minlength=terms)
        self.begin = np.cumsum(self.count) - self.count

    def of(self, queries: np.ndarray) -> _Postings:
        """Those of the queries for which the array is true."""
        some = queries[self.query]
        return _Postings(self.term[some], self.query[some], self.weight[some], len(self.count))

    def cells(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(query * n + row, product) of every term that a query and a row have in common."""
        some = self.count[term] > 0
        row, term, weight = row[some], term[some], weight[some]
        count = self.count[term]
        at = np.repeat(self.begin[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.query[at] * n + np.repeat(row, count), self.weight[at] * np.repeat(weight, count)


class _Sparse:
    """The rows with the highest dot products of a block of sparse queries.

    Until a query has k rows it meets its rows by their common terms, in double precision. From then on the
    terms that many of the queries and rows have are columns of a product of matrices in single precision,
    the other terms are added to it, and what may be among the best is worked out in double.
    """

    def __init__(self, block: pa.Table, filters: _Filters, k: int) -> None:
        offsets, keys, items = _entries(_one(block["s"]))
        self.terms = np.unique(keys)
        term, query = np.searchsorted(self.terms, keys), np.repeat(np.arange(len(block)), np.diff(offsets))
        self.blocks: dict[int, list[tuple[np.ndarray, _Postings, np.ndarray, _Best]]] = {}
        place = np.full(len(block), -1)
        for number, (_, own) in enumerate(filters.queries):
            for lo in range(0, len(own), SIDE):
                at = own[lo : lo + SIDE]
                place[:] = -1
                place[at] = np.arange(len(at))
                some = place[query] >= 0
                p = _Postings(term[some], place[query[some]], items[some], len(self.terms))
                size = np.sqrt(np.bincount(p.query, p.weight**2, len(at)))
                slack = 2.4e-7 * (np.bincount(p.query, minlength=len(at)) + 2) * size
                self.blocks.setdefault(number, []).append((at, p, slack, _Best(len(at), k)))

    def load(self, run: pa.Table, first: int) -> None:
        offsets, keys, items = _entries(_one(run["sparse"]))
        row, n, self.first = np.repeat(np.arange(len(run)), np.diff(offsets)), len(run), first
        term = np.searchsorted(self.terms, keys)
        term[term == len(self.terms)] = 0
        some = self.terms[term] == keys if len(self.terms) else np.zeros(len(keys), bool)
        self.term, self.weight, row = term[some], items[some], row[some]
        size = np.bincount(row, minlength=n)
        self.size, self.offset = size, np.cumsum(size) - size

    def search(self, number: int, fit: np.ndarray) -> None:
        row, term, weight = self._of(fit)
        begin = np.searchsorted(row, np.arange(len(fit) + 1))
        length = np.sqrt(np.bincount(row, weight**2, len(fit)).max(initial=0))
        met = np.bincount(term, minlength=len(self.terms))
        hot = None
        for at, p, slack, best in self.blocks.get(number, ()):
            # Numbers that single precision can't hold go the exact way only.
            tame = np.isfinite(length) and length < 1e15 and bool((slack < 1e15).all())
            far = slack * length + 1e-6 if tame else np.full(len(at), np.inf)
            for tile in _tiles(len(at), len(fit)):
                n, own = tile.stop - tile.start, slice(begin[tile.start], begin[tile.stop])
                r, t, w = row[own] - tile.start, term[own], weight[own]
                few = ~(best.least > 2 * far)
                if few.any():
                    cell, v = (p if few.all() else p.of(few)).cells(r, t, w, n)
                    cell, inverse = np.unique(cell, return_inverse=True)
                    few_q, few_row, v = cell // n, fit[tile.start + cell % n] + self.first, np.bincount(inverse, v, len(cell)).astype(np.float64, copy=False)
                    if few.all():
                        best.add(few_q, few_row, v)
                        continue
                if hot is None:
                    hot = self._hot(number, met, len(fit), row, term, weight)
                column, base = hot
                wide = column[p.term] >= 0
                q32 = np.zeros((len(at), base.shape[1]), np.float32)
                q32[p.query[wide], column[p.term[wide]]] = p.weight[wide]
                score = q32 @ base[tile].T
                rest = column[t] < 0
                cell, product = p.cells(r[rest], t[rest], w[rest], n)
                np.add.at(score.reshape(-1), cell, product.astype(np.float32))
                q, c = np.nonzero(score >= np.where(few, np.inf, best.least - far).astype(np.float32)[:, None])
                if few.any():
                    best.add(few_q, few_row, v)
                best.add(q, fit[tile.start + c] + self.first, self._exact(p, len(at), q, fit[tile.start + c]))

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the rows, term, weight) of the terms of these rows."""
        size = self.size[rows]
        at = np.repeat(self.offset[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(rows)), size), self.term[at], self.weight[at]

    def _hot(self, number: int, met: np.ndarray, rows: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns of the terms that many queries of a filter and rows have (-1: none), and the rows' weights of them."""
        blocks = self.blocks[number]
        work = sum(p.count for _, p, _, _ in blocks) * met.astype(np.float64)
        most = np.argsort(-work, kind="stable")[:HOT_TERMS]
        most = most[work[most] > HOT_SHARE * rows * sum(len(at) for at, *_ in blocks)]
        column = np.full(len(met), -1)
        column[most] = np.arange(len(most))
        base = np.zeros((rows, len(most)), np.float32)
        wide = column[term] >= 0
        base[row[wide], column[term[wide]]] = weight[wide]
        return column, base

    def _exact(self, p: _Postings, n: int, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The dot products of pairs in double precision, terms in the rows' order."""
        key = p.query * len(self.terms) + p.term
        order = np.argsort(key, kind="stable")
        key, value = np.append(key[order], n * len(self.terms)), np.append(p.weight[order], 0.0)
        pair, term, weight = self._of(row)
        want = query[pair] * len(self.terms) + term
        at = np.searchsorted(key, want)
        return np.bincount(pair, np.where(key[at] == want, value[at], 0.0) * weight, len(query)).astype(np.float64, copy=False)


def _entries(maps: pa.MapArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets from 0, keys and values of maps; a null map has none."""
    offsets = maps.offsets.to_numpy()
    own = slice(offsets[0], offsets[-1])
    return offsets - offsets[0], maps.keys.to_numpy(zero_copy_only=False)[own].astype(np.int64), maps.items.to_numpy(zero_copy_only=False)[own].astype(np.float64)


def _scaled(lists: pa.ListArray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists at these places, all of n numbers, scaled to length 1, and which of them are neither zero nor infinite: only those are given."""
    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)
    length = np.linalg.norm(x, axis=1)
    good = np.isfinite(length) & (length > 0)
    return x[good] / length[good, None], good


def _asked(units: DataFrame, level: int | None) -> DataFrame:
    """``unit_id, sub, level`` and the filter's fields of each level of a query's filter, or of one level, with the query's own columns."""
    each = units.withColumn("__levels", levels(F.col("hints"))).drop("hints")
    if level is None:
        each = each.select("*", F.posexplode("__levels").alias("level", "h"))
    else:
        each = each.filter(F.size("__levels") > level).select("*", F.lit(level).alias("level"), F.col("__levels")[level].alias("h"))
    return each.select(*(c for c in units.columns if c != "hints"), "level", "h.*")


def _found(rows: Rows, asked: DataFrame, column: str, leg: Callable[[pa.Table, _Filters, int], _Dense | _Sparse], k: int) -> DataFrame:
    """``unit_id, level, sub, id, score``: the k best rows of each query.

    Each task has a run of queries in the order of their filters and reads the rows that may fit
    these; all rows of a query are met in one task, so only what is found leaves it.
    """
    kind = asked.schema["unit_id"].dataType
    schema = pa.schema([("unit_id", to_arrow_type(kind)), ("level", pa.int32()), ("sub", pa.int32()), ("id", to_arrow_type(rows.id.dataType)), ("score", pa.float64())])
    n, spark = asked.count(), asked.sparkSession
    tasks = max(1, -(-n // QUERIES_AT_ONCE), min(spark.sparkContext.defaultParallelism, n // 64))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            filters = _Filters(block.select(list(FIELDS)).to_pandas())
            own, ids, first = leg(block, filters, k), [], 0
            for run in _runs(rows.read(["id", column, *filters.fields], filters.wanted())):
                own.load(run, first)
                for number, fit in filters.fitting(run.select(list(filters.fields)).to_pandas()):
                    own.search(number, fit)
                ids.append(_one(run["id"]))
                first += len(run)
            found = [(at[best[0]], *best[1:]) for blocks in own.blocks.values() for at, *_, b in blocks for best in [b.all()]]
            if not ids or not found:
                continue
            query, row, score = (np.concatenate(x) for x in zip(*found))
            named, place = np.unique(row, return_inverse=True)
            names = pa.concat_arrays(ids).take(pa.array(named))
            rank = np.empty(len(names), np.int64)
            rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
            order = np.lexsort((rank[place], -score, query))
            query, place, score = query[order], place[order], score[order]
            good = np.arange(len(query)) - np.searchsorted(query, query) < k
            keys = block.select(["unit_id", "level", "sub"]).take(pa.array(query[good]))
            t = pa.table([*(keys[c].cast(schema.field(c).type) for c in keys.column_names), names.take(pa.array(place[good])).cast(schema.field("id").type), pa.array(score[good])], schema=schema)
            yield from t.combine_chunks().to_batches(max_chunksize=50_000)

    ranged = asked.repartitionByRange(tasks, *_SCALARS, F.xxhash64("unit_id", "sub")) if tasks > 1 else asked.repartition(1)
    return ranged.mapInArrow(search, f"unit_id {kind.simpleString()}, level int, sub int, id {rows.id.dataType.simpleString()}, score double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of queries put together to at most ``2 * QUERIES_AT_ONCE`` rows."""
    whole = [b for b in batches if len(b)]
    if whole:
        t = pa.Table.from_batches(whole)
        size = -(-len(t) // -(-len(t) // (2 * QUERIES_AT_ONCE)))
        for lo in range(0, len(t), size):
            yield t.slice(lo, size).combine_chunks()


def dense_pool(base: DataFrame | Rows, units: DataFrame, k: int, level: int | None = None) -> DataFrame:
    """``unit_id, level, sub, id, score``: the k most similar rows that fit, for each query and level of its filter, or one level. Exact."""
    asked = _asked(units.select("unit_id", "sub", F.col("vector").cast("array<double>").alias("v"), "hints").filter((F.size("v") > 0) & F.exists("v", lambda x: x != 0)), level)
    return _found(base if isinstance(base, Rows) else Rows(base), asked, "vector", _Dense, k)


def sparse_pool(base: DataFrame | Rows, units: DataFrame, k: int, level: int | None = None) -> DataFrame:
    """``unit_id, level, sub, id, score``: the same by the dot product of sparse vectors."""
    asked = _asked(units.select("unit_id", "sub", F.col("sparse").cast("map<bigint,double>").alias("s"), "hints").filter("size(s) > 0"), level)
    return _found(base if isinstance(base, Rows) else Rows(base), asked, "sparse", _Sparse, k)


def _fused(d: DataFrame, s: DataFrame, k: int, dense_weight: float, sparse_weight: float) -> DataFrame:
    """``unit_id, level, sub, id, score``: the k best of both legs together, each scaled to 0..1 within its query."""
    by = ["unit_id", "level", "sub"]
    one, none = F.col("score"), F.lit(None).cast("double")
    both = d.select(*by, "id", one.alias("d"), none.alias("s")).unionByName(s.select(*by, "id", none.alias("d"), one.alias("s")))
    # Sent by query once; the sums and both windows keep to that.
    both = both.repartition(*by).groupBy(*by, "id").agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("d"), F.coalesce(F.max("s"), F.lit(0.0)).alias("s"))
    w = Window.partitionBy(*by)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high == low, 0.0).otherwise((F.col(c) - low) / (high - low))

    both = both.withColumn("score", F.round(dense_weight * scaled("d") + sparse_weight * scaled("s"), 8))
    return S.top(both, by, [F.desc("score"), F.asc("id")], k).select(*by, "id", "score")


def pool(base: DataFrame, units: DataFrame, k: int = 20, dense_times: int = 3, sparse_times: int = 2, dense_weight: float = 0.70, sparse_weight: float = 0.30, least: int = LEAST_ROWS) -> DataFrame:
    """``unit_id, level, sub, id, score``: all hits of a unit's query set at the first level of its filter with ``least`` hits, else at the last.

    Hits of several queries of the set are all in it. ``base``: id, vector, sparse and ``FIELDS``.
    A level is searched only for the units that the levels before it left with too few hits; rows
    of one year and section are staged together, so that a task reads few others.
    """
    rows = Rows(base)
    left = stage(units.select("unit_id", "sub", "vector", "sparse", "hints"), "pool-units")
    out = None
    for level in range(LEVELS):
        hits = _fused(dense_pool(rows, left, dense_times * k, level), sparse_pool(rows, left, sparse_times * k, level), k, dense_weight, sparse_weight)
        hits = stage(hits, "pool-hits")
        enough = hits.groupBy("unit_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("unit_id")
        more = left.filter(F.size(levels(F.col("hints"))) > level + 1).join(enough, "unit_id", "left_anti")
        # The last level of its filter counts for a unit however few its hits are.
        done = hits if level + 1 == LEVELS else hits.join(more.select("unit_id").distinct(), "unit_id", "left_anti")
        out = done if out is None else out.unionByName(done)
        if level + 1 == LEVELS:
            break
        left = stage(more, "pool-units")
        if left.isEmpty():
            break
    return out.select("unit_id", "level", "sub", "id", "score")


def hit_counts(pooled: DataFrame) -> DataFrame:
    """One row for each unit and chunk: its best score, and in how many searches of the set it was found."""
    return pooled.groupBy("unit_id", "level", "id").agg(F.max("score").alias("score"), F.count("*").alias("hits"))


def merge_graph(hits: DataFrame, candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits ``unit_id, id, score, hits`` with graph candidates ``unit_id, source_file, id, graph_score, graph_hops, graph_path``.

    A candidate that was hit gives the hit its score (``hybrid_graph``); the others are fetched
    from ``chunks`` by file and id (``graph``); hits without one are ``hybrid``. Scores go from 0 to 1.
    """
    best = candidates.groupBy("unit_id", "source_file", "id").agg(F.max("graph_score").alias("g"), F.min("graph_hops").alias("graph_hops"), F.min("graph_path").alias("graph_path"))
    best = best.withColumn("g", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "g"))).join(chunks.select("source_file", F.col("chunk_id").alias("id")), ["source_file", "id"], "left_semi").drop("source_file")
    both = hits.join(best, ["unit_id", "id"], "full_outer")
    channel = F.when(F.col("score").isNull(), "graph").when(F.col("g").isNull(), "hybrid").otherwise("hybrid_graph")
    return both.select("unit_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("hits", F.lit(1)).cast("long").alias("hits"), F.coalesce("g", F.lit(0.0)).alias("graph_score"), "graph_hops", "graph_path", channel.alias("channel"))


def lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks by file and id (``source_file, chunk_id`` of ``wanted``), one for each; rows of before have the file in ``source``."""
    file = F.coalesce("source_file", "source") if "source" in chunks.columns else F.col("source_file")
    w = wanted.select(F.col("source_file").alias("__f"), F.col("chunk_id").alias("__c")).distinct()
    found = chunks.withColumn("source_file", file).join(w, (F.col("source_file") == F.col("__f")) & (F.col("chunk_id") == F.col("__c"))).drop("__f", "__c")
    return found.dropDuplicates(["source_file", "chunk_id"])


#: What a missing field of a stored chunk counts as.
DEFAULTS = {"text": "", "page_no": 0, "page_label": "", "section": "", "is_table": False, "token_count": 0, "doc_id": "", "doc_year": "", "has_tables": False, "summary": "", "file_hash": "", "chunk_index": 0}
_EMPTY_LISTS = {"page_range": "array<int>", "chunk_year": "array<string>", "filename_tokens": "array<string>", "keywords": "array<string>"}


def payload(chunks: DataFrame) -> DataFrame:
    """All fields of a chunk, a missing column or null as its default; the file from ``source`` where only that is set."""
    have = set(chunks.columns)
    files = [F.col(c) for c in ("source_file", "source") if c in have]
    cols = [F.col("chunk_id") if "chunk_id" in have else F.lit(None).cast("string").alias("chunk_id"), F.coalesce(*files, F.lit("")).alias("source_file")]
    cols += [(F.coalesce(c, F.lit(v)) if c in have else F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    cols += [(F.coalesce(c, F.array().cast(t)) if c in have else F.array().cast(t)).alias(c) for c, t in _EMPTY_LISTS.items()]
    return chunks.select(*cols)
