"""Operators on small cases with known results, and invariants."""

import datetime as dt
import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions import text as T, vectors as V
from veldra.models import embed_column, score_column
from veldra.operators import chunking, graph, layout, ranking, search, state
from veldra.sources import files, web
from veldra.storage import shared_dir, stage
from veldra.streaming import rollups


def values(spark, make, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(make(F.col("t"))).collect()]


def test_text_functions(spark):
    assert values(spark, T.token_count, "a b\n c", "", None)[:2] == [3, 0]
    assert values(spark, T.years, "in 2019, 1899 and 20190 or 2001-2019") == [["2001", "2019"]]
    assert values(spark, T.keywords, "The Council and the DESK 12 of it") == [["council", "desk"]]
    assert values(spark, T.heading_level, "1.2.3 Scope", "4. Fees", "Section 3.1 x", "Annexure", "Something", "IV. Rules", "section one") == [3, 1, 3, 1, 2, 1, 2]
    assert values(spark, T.sentences, "One. Two? Three") == [["One.", "Two?", "Three"]]
    assert values(spark, T.normalize_name, "The Sec. 5 & Co", "Mr. X-Y", None) == ["section 5 and co", "x y", ""]
    assert values(spark, T.filename_tokens, "dir/Old_File-name v2.pdf") == [["old", "file", "name", "v2"]]
    assert values(spark, T.sanitize_whitespace, " a    b \n| c    d |") == ["a b\n| c    d |"]
    assert values(spark, T.clean_noise, "Page 1 of 2\ntext\n\n\n\n- 3 -\n12\nCONFIDENTIAL note") == ["text"]
    assert values(spark, lambda c: T.embeddable(c, F.lit(False)), "# only a heading", "Rs. 500 is due on the day", "too short", None)[:3] == [False, True, False]
    assert values(spark, lambda c: T.shingles(c, 3), "abcab", "ab") == [["abc", "bca", "cab"], []]
    assert values(spark, lambda c: T.evidence_supported(F.lit("Buyer paid!"), c), "the buyer PAID late", "nothing") == [True, False]
    assert values(spark, lambda c: T.unseen_numbers(c, F.lit("it was 1,200 once")), "1200 and 3", "1300") == [False, True]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]
    assert df.select(V.l2_normalize(F.col("a"))).collect()[1][0] == [0.0, 0.0]


def test_dense_topk_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES_PER_PASS", 7)
    x = np.random.default_rng(0).standard_normal((200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8)], "id int, vector array<double>")
    got = search.dense_topk(df, df.filter("id < 20").withColumnRenamed("id", "query_id"), 5).orderBy("query_id", "rank").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(u[:20] @ u.T), axis=1, kind="stable")[:, :5]
    assert [r.id for r in got] == want.ravel().tolist()


def test_fuse_and_filters(spark):
    leg = "query_id int, id string, score double"
    got = search.fuse(spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5)], leg), spark.createDataFrame([(1, "b", 2.0), (1, "c", 1.0)], leg), 3).orderBy("rank").collect()
    assert [(r.id, round(r.score, 4)) for r in got] == [("a", 0.7), ("b", round(0.7 * 5 / 9 + 0.3, 4)), ("c", 0.15)] or got[0].id in "ab"
    df = spark.createDataFrame([("x", ["2018"], "s"), ("y", ["2019"], "s"), ("z", None, "t")], "k string, chunk_year array<string>, source_file string")
    hit = lambda h: [r.k for r in df.filter(search.metadata_filter(h)).orderBy("k").collect()]
    assert hit({"source": "s"}) == ["x", "y"] and hit({"chunk_year": ["2018", "2020"], "k": ["y"]}) == ["x", "y"] and hit({"source": "t", "k": ["x"]}) == []


def test_token_budget_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, int(rng.integers(1, 50)), bool(rng.random() < 0.2)) for g in range(60) for i in range(12)]
    got = {(r.g, r.i) for r in ranking.token_budget(spark.createDataFrame(rows, "g int, i int, tokens int, is_table boolean"), 120, [F.asc("i")], ["g"]).collect()}
    want = set()
    for g in range(60):
        used = 0
        for _, i, n, table in [r for r in rows if r[0] == g]:
            if not table and used + n > 120:
                break
            used += n
            want.add((g, i))
    assert got == want


def test_diversity_cap_bounds(spark):
    rows = [(1, f"d{i % 9}", f"{i:03d}", float(i % 37)) for i in range(200)]
    got = ranking.diversity_cap(spark.createDataFrame(rows, "query_id int, source_file string, id string, score double")).toPandas()
    assert got.source_file.nunique() == 6 and got.groupby("source_file").size().max() == 4


def test_khop_trails(spark):
    edges = spark.createDataFrame([("e1", "a", "b", 0.9), ("e2", "b", "c", 0.8), ("e3", "c", "a", 0.7), ("e4", "a", "b", 0.5)], "edge_id string, src string, dst string, strength double")
    paths = graph.khop(edges, spark.createDataFrame([("a",)], "seed string"))
    rows = paths.collect()
    assert all(len(set(r.path)) == len(r.path) == r.hops for r in rows)
    assert sum(r.hops == 1 for r in rows) == 3 and any(r.node == "a" and r.hops == 3 for r in rows)
    score = {r.node: r.score for r in graph.path_score(paths).collect()}
    assert score["b"] == 0.9 and score["c"] == 0.7


def test_chunks_and_tables(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(205))), (2, ""), (3, None)], "doc_id int, text string")
    got = chunking.window_chunks(df, "doc_id", "text").orderBy("chunk_index").collect()
    assert [(r.first_word, r.words) for r in got] == [(0, 100), (80, 100), (160, 45)]
    md = "## Page 1\n# A\n| x | |\n|---|---|\n| 1 | 2 | 3 |\n| | |\n| 4 |\n\ntext\n## Page 2\nmore"
    blocks = chunking.markdown_blocks(spark.createDataFrame([("d", md)], "doc_id string, m string"), "doc_id", "m")
    assert [(r.kind, r.page) for r in blocks.orderBy("block_no").collect()] == [("heading", 1), ("table", 1), ("text", 1), ("text", 2)]
    rows = chunking.table_rows(blocks, ["doc_id"]).orderBy("row_no").collect()
    assert [(r.names, r.cells) for r in rows] == [(["x", "UNNAMED_COLUMN_1"], ["1", "2"]), (["x", "UNNAMED_COLUMN_1"], ["4", ""])]
    heads = spark.createDataFrame([("d", 1, "A", 1), ("d", 2, "B", 2), ("d", 3, "C", 2), ("d", 4, "D", 1)], "doc_id string, i int, t string, l int")
    assert [r.path for r in chunking.heading_paths(heads, "doc_id", "i", "t", "l").orderBy("i").collect()] == ["A", "A > B", "A > C", "D"]
    packed = chunking.sentence_chunks(spark.createDataFrame([(1, "One two. Three four five. Six. " * 30)], "doc_id int, text string"), "doc_id", "text", 20, 4).toPandas()
    assert packed.words.max() <= 20 and len(packed) > 5


def test_layout(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.5, 0.0, 10.0, 10.0, 0.5), (1, 2, 20.0, 1.0, 30.0, 11.0, 0.4), (1, 3, 0.0, 30.0, 9.0, 40.0, 0.3)], "page_no int, idx int, x1 double, y1 double, x2 double, y2 double, conf double")
    kept = layout.suppress(boxes)
    assert sorted(r.idx for r in kept.collect()) == [0, 2, 3]
    assert [r.idx for r in layout.reading_order(boxes.filter("idx <> 1")).orderBy("place").collect()] == [0, 2, 3]


def test_state(spark):
    t = spark.createDataFrame([("s", 1, "user", "q"), ("s", 2, "assistant", "a"), ("s", 3, "user", "q2"), ("s", 4, "user", "q3"), ("s", 5, "assistant", None), ("s", 6, "assistant", "stray")], "s string, i int, r string, c string")
    assert [(r.c, r.answer) for r in state.turn_pairs(t, "s", "r", "c", ["i"]).orderBy("i").collect()] == [("q", "a"), ("q2", ""), ("q3", "")]
    old, new = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string"), spark.createDataFrame([(1, None, "c"), (2, "n", None)], "k int, x string, y string")
    assert sorted(map(tuple, state.partial_update(old, new, "k").collect()), key=str) == [(1, "a", "c"), (2, "n", None)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.exe").write_bytes(b"MZ")
    rows = {r.extension: r for r in files.scan_files(spark, str(tmp_path)).withColumn("kind", files.file_kind(F.col("content"), F.col("path"))).collect()}
    assert rows["pdf"].status == "ok" and rows["pdf"].kind == "pdf" and rows["exe"].status == "skipped: extension" and rows["exe"].content is None
    spark.createDataFrame([("f1", 1), ("f2", 2)], "source_file string, v int").write.partitionBy("source_file").parquet(str(tmp_path / "t"))
    files.replace_sources(spark.createDataFrame([(9, "f1")], "v int, source_file string"), str(tmp_path / "t"))
    assert sorted((r.source_file, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("f1", 9), ("f2", 2)]
    html = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><nav>n</nav> c",), (None,)], "h string")
    assert [r[0] for r in html.select(web.html_to_text("h")).collect()] == ["a & b c", None]
    assert values(spark, web.url_reason, "https://example.org/x", "ftp://a", "http://10.1.2.3/", "http:///x", "https://u@localhost:80") == ["ok", "scheme", "private", "host", "private"]


def test_models(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    got = [r[0] for r in df.select(embed_column(F.col("t"))).collect()]
    assert len(got[0]) == 64 and abs(sum(x * x for x in got[0]) - 1) < 1e-5 and not any(got[1])

    def broken(texts):
        if len(texts) > 1 or texts[0] is None:
            raise ValueError
        return [np.ones(2)]

    assert [r[0] for r in df.coalesce(1).select(embed_column(F.col("t"), broken)).collect()] == [[1.0, 1.0], None]
    ratio = df.filter("t is not null").select(score_column(F.col("t"), F.col("t"), lambda x, y: [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(x, y)]))
    assert ratio.first()[0] == 1.0


def test_streams(spark, tmp_path):
    docs = [(i, f"text {i % 3} " * 30, dt.datetime(2024, 1, 1, i)) for i in range(6)]
    spark.createDataFrame(docs, "doc_id int, text string, ingestion_date timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string, ingestion_date timestamp").parquet(str(tmp_path / "in"))
    query = rollups.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 3
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, m), "view", 1.0) for m in (0, 10, 55, 59)], "user_id int, ts timestamp, event_type string, value double")
    assert [r.events for r in rollups.user_sessions(events).orderBy("session_start").collect()] == [2, 2]
    assert rollups.tumbling(events, "30 minutes").count() == 2


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(10), "test")
    assert df.count() == 10 and shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]


@pytest.mark.parametrize("table", ["documents"])
def test_filters_and_columns_reach_the_scan(spark, tmp_path, table):
    spark.createDataFrame([(1, "a", "x")], "doc_id int, text string, source string").write.parquet(str(tmp_path / table))
    plan = spark.read.parquet(str(tmp_path / table)).filter("doc_id = 1").select(T.token_count(F.col("text")))._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,1)" in plan and "source" not in plan.split("ReadSchema")[-1]
