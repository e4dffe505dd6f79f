"""The pool of many questions: searched level by level, right for any size of blocks."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from veldra.operators import asking as A, search as S

FIELDS = "doc_year string, section string, source_file string, keywords array<string>, filename_tokens array<string>"


def tables(spark, n=150, units=30):
    rng = np.random.default_rng(12)
    pick = lambda *v: v[rng.integers(len(v))]

    def fields(i):
        return pick("2018", "2019", None), pick("s", "t", ""), f"f{i % 4}", pick(None, ["k"], ["k", "l"], []), pick(None, ["a"])

    row = lambda i: (rng.standard_normal(pick(8, 8, 5)).tolist(), {int(t): float(rng.integers(1, 4)) for t in rng.integers(0, 12, 3)})
    base = [(f"c{i:03}", *row(i), *fields(i)) for i in range(n)] + [("z", [0.0] * 8, {99: 1.0}, *fields(0)), ("n", None, None, *fields(1))]
    asked = [(f"u{i:02}", sub, *row(i), (pick(None, "2018", "1900"), pick(None, "s"), pick(None, None, ["l"]), None, pick(None, None, f"f{i % 4}"))) for i in range(units) for sub in (0, 1)]
    asked = [(u, sub, v, s, next(h for x, _, _, _, h in asked if x == u)) for u, sub, v, s, _ in asked]
    asked.append(("x", 0, [1.0] * 8, {1000: 1.0}, ("2018", None, None, None, None)))
    b = spark.createDataFrame(base, f"id string, vector array<double>, sparse map<int,double>, {FIELDS}").repartition(3)
    return base, asked, b, spark.createDataFrame(asked, f"unit_id string, sub int, vector array<double>, sparse map<int,double>, hints {A.HINTS}")


def fits(h, row):
    year, section, words, names, file = h
    ok = all(x is None or x == y for x, y in zip((year, section, file), row[3:6]))
    return ok and (not words and not names or bool(set(words or ()) & set(row[6] or ())) or bool(set(names or ()) & set(row[7] or ())))


def of_levels(h):
    year, section, words, names, file = h
    if not any(h):
        return [h]
    one = (year if section or words or names else None, None, words if section else None, names if section or words else None, file)
    return [h, one, (None,) * 5]


def test_pool_equals_plain_loops(spark, monkeypatch):
    base, asked, b, u = tables(spark)
    for name, value in (("QUERIES_AT_ONCE", 17), ("ROWS_AT_ONCE", 40), ("CELLS_AT_ONCE", 90)):
        monkeypatch.setattr(A, name, value)
    k, want = 4, {}
    for unit in sorted({a[0] for a in asked}):
        own = [a for a in asked if a[0] == unit]
        plans = of_levels(own[0][4])
        for level, h in enumerate(plans):
            found = {}
            for _, sub, v, s, _ in own:
                rows = [r for r in base if fits(h, r)]
                dense = sorted((-round(float(np.dot(v, r[1]) / np.linalg.norm(v) / np.linalg.norm(r[1])), 6), r[0]) for r in rows if r[1] and len(r[1]) == len(v) and any(r[1]))[: 3 * k]
                sparse = sorted((-round(sum(w * r[2][t] for t, w in s.items() if t in r[2]), 6), r[0]) for r in rows if r[2] and set(s) & set(r[2]))[: 2 * k]
                d, p = {i: -x for x, i in dense}, {i: -x for x, i in sparse}
                ids = sorted(set(d) | set(p))
                if not ids:
                    continue
                scale = lambda m, at: 0 if (hi := max(m.get(i, 0) for i in ids)) == (lo := min(m.get(i, 0) for i in ids)) else (m.get(at, 0) - lo) / (hi - lo)  # noqa: B023, E731
                found |= {(unit, level, sub, i): x for x, i in sorted((-round(0.7 * scale(d, i) + 0.3 * scale(p, i), 8), i) for i in ids)[:k]}
            if len(found) >= A.LEAST_ROWS or level == len(plans) - 1:
                want |= found
                break
    got = {(r.unit_id, r.level, r.sub, r.id): -r.score for r in A.pool(b, u, k).collect()}
    assert got.keys() == want.keys() and {level for _, level, _, _ in want} == {0, 1, 2}
    assert all(abs(got[x] - want[x]) < 1e-7 for x in want)


def test_only_units_with_too_few_hits_are_relaxed(spark, monkeypatch):
    _, _, b, u = tables(spark)
    searched, whole = [], A.dense_pool
    monkeypatch.setattr(A, "dense_pool", lambda base, units, k, level: searched.append((level, {r.unit_id for r in units.select("unit_id").collect()})) or whole(base, units, k, level))
    met = A.pool(b, u, 4).groupBy("unit_id").agg(F.max("level").alias("level")).collect()
    for level, units in searched[1:]:
        assert {r.unit_id for r in met if r.level >= level} <= units and not {r.unit_id for r in met if r.level < level} & units
    assert [level for level, _ in searched] == [0, 1, 2] and len(searched[1][1]) < len(searched[0][1])


def test_best_rounded_keeps_ties_and_all_of_the_best():
    rng = np.random.default_rng(1)
    score = np.round(rng.standard_normal((20, 400)), 1)
    score[rng.random(score.shape) < 0.3] = -np.inf
    score[3], score[4, 5:] = -np.inf, -np.inf
    score[5] += 2e-7 * rng.standard_normal(400)
    for k in (1, 7, 12, 500):
        r, c, v = S.best_rounded(score, k)
        want = {(i, j) for i, row in enumerate(np.round(score, 6)) for j in np.flatnonzero(np.isfinite(row)) if (row > row[j]).sum() < k}
        assert set(zip(r.tolist(), c.tolist())) == want and (v == np.round(score, 6)[r, c]).all()


def test_searches_of_a_task_equal_plain_loops(monkeypatch):
    """Rare and common terms, few and many rows that fit, thresholds that rise over many tiles and runs."""
    monkeypatch.setattr(A, "CELLS_AT_ONCE", 640)
    rng = np.random.default_rng(3)
    vectors = lambda n: [None if i % 11 == 5 else rng.standard_normal(6 if i % 7 else 4).tolist() for i in range(n)]
    maps = lambda n, least: [[(int(t), float(rng.uniform(least, 2))) for t in np.unique(np.minimum(rng.geometric(0.2, 3), 20) if i % 5 else 30 + rng.integers(40, size=1))] for i in range(n)]
    for signed in (0.1, -1.0):
        rows = pa.table({"vector": pa.array(vectors(500), pa.list_(pa.float64())), "sparse": pa.array(maps(500, signed), pa.map_(pa.int64(), pa.float64()))})
        own = [(None, 0), ("a", 0), ("b", 0)]
        block = pa.table({"v": pa.array([v or [1.0] * 4 for v in vectors(40)], pa.list_(pa.float64())), "s": pa.array(maps(40, signed), pa.map_(pa.int64(), pa.float64()))})
        fields = pd.DataFrame({f: [own[i % 3][0] if f == "doc_year" else None for i in range(40)] for f in A.FIELDS})
        year = np.array(["a" if i % 3 else "b" for i in range(500)])
        filters, k = A._Filters(fields), 7
        for leg, column, name in ((A._Dense, "v", "vector"), (A._Sparse, "s", "sparse")):
            search = leg(block, filters, k)
            for first in (0, 200):
                part = rows.slice(first, 200 if not first else 300).combine_chunks()
                search.load(part, first)
                for number, fit in filters.fitting(pd.DataFrame({"doc_year": year[first : first + len(part)], "section": None, "source_file": None})):
                    search.search(number, fit)
            got = {(int(at[q]), int(r), float(v)) for blocks in search.blocks.values() for at, *_, best in blocks for q, r, v in zip(*best.all())}
            want = set()
            for i, q in enumerate(block[column].to_pylist()):
                scores = []
                for r, x in enumerate(rows[name].to_pylist()):
                    if fields["doc_year"][i] not in (None, year[r]) or x is None:
                        continue
                    if leg is A._Dense and len(x) == len(q):
                        scores.append((round(float(np.dot(q, x) / np.linalg.norm(q) / np.linalg.norm(x)), 6), r))
                    elif leg is A._Sparse and dict(q).keys() & dict(x).keys():
                        scores.append((round(sum(w * dict(q)[t] for t, w in x if t in dict(q)), 6), r))
                least = sorted((s for s, _ in scores), reverse=True)[: k][-1:] or [0]
                want |= {(i, r, s) for s, r in scores if s >= least[0]}
            assert {x[:2] for x in got} == {x[:2] for x in want}
            assert max(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want))) < 2e-6


def test_all_rows_of_a_query_are_met_in_one_task(spark):
    """What a search finds is final: no candidates are sent between tasks, one row for each query and place."""
    _, _, b, u = tables(spark)
    rows = A.Rows(b)
    for leg in (A.dense_pool, A.sparse_pool):
        found = leg(rows, u, 5, 0)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "MapInArrow" in plan
        assert found.groupBy("unit_id", "level", "sub").count().filter("count > 5").isEmpty()
