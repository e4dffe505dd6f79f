"""Extractions to graphs, blocks to chunks, layout and retrieval, against plain loops."""

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from veldra.functions import text as T
from veldra.operators import asking as A, blocks as B, build as G, layout as L, pairs, prompts as P, state as S
from veldra.sources import files, web

TEXT = "Asha Traders supplied steel rods to Vira Mills under the order of May. " * 4


def payload(**kw):
    return json.dumps(kw)


def test_extraction_rules(spark):
    entities = [{"name": "Asha Traders", "type": "firm", "aliases": ["AT"], "description": "Sells."}, {"name": "Vira Mills", "type": "FIRM"}, {"name": "", "type": "FIRM"}, {"name": "Odd", "type": "no type"}, {"name": "asha traders", "type": "FIRM", "description": "Sells rods."}]
    good = {"source": "AT", "relation": "supplied", "target": "Vira Mills", "confidence": 0.95, "evidence": "supplied steel rods", "keywords": "Trade, Steel"}
    relations = [good, {**good, "confidence": 0.89}, {**good, "relation": "bad name"}, {**good, "evidence": ""}, {**good, "evidence": "nothing of the sort anywhere"}, {**good, "target": "AT"}, {**good, "target": "Unknown"}, {**good, "confidence": "x", "evidence": "under the order"}, {**good, "relation": "_OWNS", "keywords": ["a", "A"]}]
    rows = [("c1", payload(entities=entities, relationships=relations), TEXT), ("c2", "```json\n" + payload(entities=entities[:2]) + "\n```", TEXT), ("c3", "no", TEXT), ("c4", None, None), ("c5", "[1, 2]", TEXT)]
    p = G.parse_extractions(spark.createDataFrame(rows, "chunk_key string, payload string, text string"))
    assert {r.key: r.mode for r in p.collect()} == {"c1": "direct", "c2": "fenced", "c3": "invalid", "c4": "empty", "c5": "direct"}
    e = G.valid_entities(p)
    assert sorted((r.key, r.entity_key) for r in e.collect()) == [("c1", "FIRM::asha traders")] * 2 + [("c1", "FIRM::vira mills"), ("c2", "FIRM::asha traders"), ("c2", "FIRM::vira mills")]
    merged = {r.entity_key: r for r in G.merge_entities(e, ["entity_key"]).collect()}
    assert merged["FIRM::asha traders"].description == "Sells. Sells rods." and merged["FIRM::asha traders"].aliases == ["AT"]
    r = G.chunk_relations(G.valid_relations(p, e)).orderBy("relation").collect()
    assert [(x.relation, x.src_key, x.dst_key, x.confidence, x.evidence, x.keywords) for x in r] == [
        ("SUPPLIED", "FIRM::asha traders", "FIRM::vira mills", 1.0, "supplied steel rods | under the order", ["steel", "trade"]), ("_OWNS", "FIRM::asha traders", "FIRM::vira mills", 0.95, "supplied steel rods", ["a"])]
    assert G.failure_rate(p).first().failures == 2


def test_index_upsert_and_retrieve(spark):
    text = "Asha Traders Limited wrote to Vira Mills Company. Vira Mills Company wrote to Pothu Works Board. " + "x" * 200
    rows = [("a1", text, "f1", "1", "", ""), ("a2", text, "f2", "2", None, "h"), ("a3", "short", "f1", "1", "", ""), ("a4", None, None, None, None, None)]
    c = spark.createDataFrame(rows, "chunk_id string, text string, source_file string, page_label string, section string, file_hash string")
    g = G.index_graph(c)
    again = G.index_graph(c, state=g, cache=g["extractions"])
    assert again["extractions"].filter("not cached").count() == 0 and again["entities"].count() == g["entities"].count() == 3
    assert {r["count"] for r in again["relations"].collect()} == {4} and {r["count"] for r in again["mentions"].collect()} == {2}
    keys = spark.createDataFrame([("q", "NAME::asha traders limited")], "query_id string, entity_key string")
    got, said = G.retrieve(g, keys, "local")
    assert {(r.source, r.chunk_id) for r in got.collect()} == {("f1", "a1"), ("f2", "a2")} and said.count() == 1
    assert got.filter("path like '%NAMED_WITH%' and hops = 1").count() == 2
    left = G.delete_source(g, F.col("source") == "f1")
    assert left["chunks"].count() == 1 and left["entities"].count() == 3
    none = G.delete_source(left, F.col("source") == "f2")
    assert none["entities"].count() == none["relations"].count() == none["documents"].count() == 0
    assert G.source_report(g, "f2").filter("kind = 'entity'").count() == 3


def test_blocks_to_chunks(spark):
    long = " ".join(f"word{i} is here." for i in range(700))
    table = "| a | |\n|---|---|\n| 1 | 2 |\n| | |\n| 3 |"
    rows = [
        ("d", 0, "heading", "1. Scope", 1, "1", "s", False), ("d", 1, "text", long, 1, "1", "s", False), ("d", 2, "text", "The price list of 2018 by the board", 1, "1", "s", False), ("d", 3, "table", table, 2, "2", "s", True),
        ("d", 4, "heading", "1.1 Parts", 2, "2", "s", False), ("d", 5, "text", long, 2, "2", "s", False), ("d", 6, "text", None, 2, "2", "s", None), ("e", 0, "text", "", None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows + rows[:2], "doc_id string, block_index int, block_type string, content string, page_no int, page_label string, section string, is_table boolean")
    got = B.chunk_blocks(blocks).orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {"d"} and [r.chunk_index for r in got] == sorted({r.chunk_index for r in got})
    tables = [r for r in got if r.is_table]
    assert [r.text for r in tables] == ["Table Title: The price list of 2018 by the board\nSection: 1. Scope\na: 1, UNNAMED_COLUMN_1: 2", "Table Title: The price list of 2018 by the board\nSection: 1. Scope\na: 3"]
    texts = [r for r in got if not r.is_table]
    assert all(r.tokens <= 1010 for r in texts) and {r.section for r in texts} == {"1. Scope", "1. Scope > 1.1 Parts"} and not any("price list" in r.text for r in texts)
    assert all(f"word{i} " in " ".join(r.text for r in texts) for i in range(700))
    assert B.chunk_blocks(blocks.limit(0)).count() == 0
    assert B.semantic_split("A b. C d. E f.", lambda s: np.eye(3), 0.6) == ["A b.", "C d.", "E f."] and B.semantic_split("A b. C d.", lambda s: [][1], 0.6) == []


def test_layout(spark):
    boxes = [(1, i, x, y, x + 10, y + 5, 0.9 - i / 10, i == 0) for i, (x, y) in enumerate([(0, 0), (0, 0.2), (20, 10), (20.2, 10)])]
    df = spark.createDataFrame([tuple(float(v) if isinstance(v, (int, float)) and k > 1 and not isinstance(v, bool) else v for k, v in enumerate(b)) for b in boxes], "page_no int, idx int, x1 double, y1 double, x2 double, y2 double, conf double, header boolean")
    assert {r.idx for r in L.dedup_rows(df).collect()} == {0, 2} and {r.idx for r in L.dedup_columns(df).collect()} == {0, 2}
    rows, cols = df.filter("idx in (0, 2)"), df.filter("idx in (0, 2)")
    cells = L.cells_of(rows, cols)
    assert cells.count() == 4
    spans = spark.createDataFrame([(1, 1, 2.0, 2.0, 4.0, 3.0, "in"), (1, 2, 22.0, 2.0, 24.0, 3.0, " right "), (1, 3, 500.0, 500.0, 501.0, 501.0, "far"), (1, 4, 12.0, 6.0, 13.0, 7.0, "near")], "page_no int, idx int, x1 double, y1 double, x2 double, y2 double, text string")
    placed = L.assign_spans(spans, cells)
    assert {(r.row_no, r.col_no): r.text for r in L.cell_texts(spans, placed).collect()} == {(1, 1): "in near", (1, 2): "right"}


def test_small_rules(spark):
    one = spark.range(1)
    assert one.select(T.uuid5(F.lit("a::1"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a::1"))
    x = one.select(P.cleaned_query(F.lit("why"), F.lit("<think>a {</think>nothing")).alias("x")).first().x
    assert (x.improved_query, x.target_scope, x.answer_structure, x.specificity, x.comparison_arms) == ("why", "broad", "direct", "low", [])
    assert one.select(P.fill("a{{x}}b{{y}}c{{z}}", x=F.lit(1), y=F.lit(None))).first()[0] == "a1bc"
    assert one.select(P.first_answer(F.lit("q"), lambda p: 1 / 0, lambda p: p + "!")).first()[0] == "q!"
    urls = ["http://[::1]/", "http://[fd00::1]/", "http://2130706433/", "http://0x7f000001/", "https://8.8.8.8/", "ftp://a", None, "http://[2001:db8::1]/"]
    got = [r.r for r in spark.createDataFrame([(u,) for u in urls], "u string").select(web.url_reason(F.col("u")).alias("r")).collect()]
    assert got == ["private"] * 4 + ["ok", "scheme", "scheme", "ok"]
    m = spark.createDataFrame([("c++ code", "u1", 0), ("code", "u2", 1), ("code", "u1", 2)], "keyword string, url string, place int")
    q = spark.createDataFrame([(1, "Some C++ code here"), (2, "decode this"), (3, None), (4, "code c")], "item_id long, text string")
    assert {(r.item_id, r.url, r.place) for r in files.triggered_urls(q, m).collect()} == {(1, "u1", 0), (1, "u2", 1), (4, "u2", 1), (4, "u1", 2)}
    keyed = spark.createDataFrame([("h", i) for i in range(40)] + [("c", 1), ("c", 2), (None, 3)], "k string, i int")
    assert {(r.a, r.b) for r in pairs.equal_blocks(keyed.filter("k = 'h'"), ["k"], "i", [], hot=7).collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert S.cleared(keyed).count() == 0


def test_pool_relaxes(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", rng.standard_normal(8).tolist(), {1: 1.0, i % 5 + 2: 2.0}, "2018" if i < 8 else "2019", "s" if i < 3 else "t", f"f{i % 4}", ["k"] if i % 2 else None, None) for i in range(40)]
    base = spark.createDataFrame(rows, "id string, vector array<double>, sparse map<int,double>, doc_year string, section string, source_file string, keywords array<string>, filename_tokens array<string>")
    hints = [("2018", "s", None), ("2018", "t", None), (None, None, ["k"]), (None, None, None), ("1900", "s", None)]
    units = spark.createDataFrame([(f"u{i}", 0, rng.standard_normal(8).tolist(), {1: 1.0}, (y, s, k, None, None)) for i, (y, s, k) in enumerate(hints)], f"unit_id string, sub int, vector array<double>, sparse map<int,double>, hints {A.HINTS}")
    got = A.pool(base, units, k=10)
    level = {r.unit_id: (r.level, r.n) for r in got.groupBy("unit_id", "level").agg(F.count("*").alias("n")).collect()}
    assert level == {"u0": (1, 8), "u1": (1, 8), "u2": (0, 10), "u3": (0, 10), "u4": (2, 10)}
    assert all(int(r.id[1:]) % 2 for r in got.filter("unit_id = 'u2'").collect())
    assert A.pool(base, units.limit(0)).count() == 0


def test_answers_and_forms(spark):
    from veldra.plans import answer as W

    rows = [("u", "c1", 1, 0.9, "a.pdf", 0, "Steel rods cost 40 rupees. " * 3, "s", 1, "1", False, None, "2018", "d1", "Sum", 0.0, 1), ("u", "c2", 2, 0.8, "b.pdf", 3, None, None, 0, "", True, None, None, None, None, 0.0, 1)]
    names = "unit_id string, id string, place int, boosted double, source_file string, chunk_index int, text string, section string, page_no int, page_label string, is_table boolean, chunk_year array<string>, doc_year string, doc_id string, summary string, graph_score double, hits long"
    h = spark.createDataFrame(rows, names)
    block = W.synthesize_block(h).first().block
    assert "━━━ a.pdf (2018) ━━━\n[DOCUMENT SUMMARY]\nSum\n\nPage 1 | s [TEXT]\nSteel rods" in block and "Page Unknown | General [TABLE]" in block
    assert "━━━ S ━━━\nSource: a.pdf\nYear: 2018\n" in W.compare_block(h.withColumn("arm", F.col("section"))).first().block
    assert W.extractive_answer(h).first().answer.endswith("[Source: b.pdf, Page 0]") and W.documents(h).count() == 2
    assert W.synthesize_block(h.limit(0)).count() == W.extractive_answer(h.limit(0)).count() == 0
    texts = spark.createDataFrame([("s1", "text"), ("s2", None)], "session string, text string")
    state = spark.createDataFrame([("s1", "name", "Asha"), ("s1", "city", "n/a")], "session string, field string, value string")
    fields = spark.createDataFrame([("name",), ("city",), ("year",)], "field string")
    merged, progress = W.extract_forms(texts, state, fields, lambda p: 1 / 0, lambda p: 'so: {"city": "Pune", "year": "null", "name": "Other"}')
    assert {(r.session, r.field): r.value for r in merged.collect() if r.value} == {("s1", "name"): "Asha", ("s1", "city"): "Pune", ("s2", "city"): "Pune", ("s2", "name"): "Other"}
    assert {r.session: (r.filled, r.missing) for r in progress.collect()} == {"s1": (2, "year"), "s2": (2, "year")}
    found = W.search_documents(spark.createDataFrame([(1, "x\n\n" + "y" * 500 + " Steel " + "z" * 500, "steel.md"), (2, None, None), (3, "steel\n\nsteel", "a")], "doc_id int, text string, name string"), "steel", name="name")
    assert {r.doc_id: (r.hits, [len(s) for s in r.snippets]) for r in found.collect()} == {1: (2, [371]), 3: (2, [5])}
