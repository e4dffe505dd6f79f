"""Markdown, tables, headings, chunks and layout, over scans, chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.operators import blocks as B, chunking as C, layout as L
from veldra.queries.search import C as C_SQL
from veldra.tables import chunks, table

KEYS = ["doc_id", "block_no"]


def results(spark, d) -> DataFrame:
    return table(spark, d, "parse_results").filter("markdown is not null").dropDuplicates(["doc_id"])


def blocks(spark, d) -> DataFrame:
    return C.markdown_blocks(results(spark, d), "doc_id", "markdown")


def rows(spark, d) -> DataFrame:
    return C.table_rows(blocks(spark, d), KEYS)


def headings(spark, d) -> DataFrame:
    h = table(spark, d, "blocks").distinct().filter("block_type = 'heading'")
    return h.select("doc_id", "block_index", T.strip(F.col("content")).alias("title"), T.heading_level(F.col("content")).alias("level"))


def boxes(spark, d) -> DataFrame:
    """Boxes made of order lines: one page for each order."""
    x, y = F.pmod("l_partkey", F.lit(20)) * 5.0, F.pmod("l_suppkey", F.lit(10)) * 8.0
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("int").alias("page_no"), F.col("l_linenumber").alias("idx"), x.alias("x1"), y.alias("y1"), (x + 30 + F.pmod("l_partkey", F.lit(7))).alias("x2"), (y + 12).alias("y2"), F.col("l_discount").alias("conf"))


def binding(spark, d):
    """Blocks with the title of each table: the text block right before it if it is short, which is left out itself."""
    b = blocks(spark, d)
    w = Window.partitionBy("doc_id").orderBy("block_no")
    short = (F.col("kind") == "text") & (F.length(T.strip(F.col("content"))) < 150) & (T.strip(F.col("content")) != "")
    b = b.withColumn("title", F.when((F.col("kind") == "table") & F.lag(short).over(w), F.lag("content").over(w))).withColumn("taken", F.coalesce(short & (F.lead("kind").over(w) == "table"), F.lit(False)))
    return b.filter("not taken").select("doc_id", "block_no", "kind", "title")


def sessions(spark, d):
    """Runs of blocks of one section in each document."""
    b = table(spark, d, "blocks").distinct()
    w = Window.partitionBy("doc_id").orderBy("block_index")
    change = (F.coalesce(F.lag("section").over(w), F.lit("")) != F.coalesce("section", F.lit(""))) | F.lag("block_index").over(w).isNull()
    return b.withColumn("run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "run").agg(F.min("block_index").alias("first_block"), F.count("*").alias("blocks")).select("doc_id", F.col("run").cast("int"), "first_block", "blocks")


def dominant(spark, d):
    """The section most blocks of a page have; of equals the first seen."""
    b = table(spark, d, "blocks").distinct().filter("coalesce(section, '') <> ''")
    n = b.groupBy("doc_id", "page_no", "section").agg(F.count("*").alias("n"), F.min("block_index").alias("first"))
    return n.groupBy("doc_id", "page_no").agg(F.max_by("section", F.struct("n", -F.col("first"))).alias("section"))


def doc_year(spark, d):
    """The year in the file name, else the latest in a heading, else the most frequent in the first 2,000 characters."""
    r = results(spark, d)
    year = lambda t: t.rlike("^(19|20)[0-9]{2}$")
    stem = F.regexp_replace(F.coalesce("file_name", F.lit("")), r"(?<=.)\.[^.]*$", "")
    in_name = F.try_element_at(F.filter(T.tokens(stem), year), F.lit(1))
    heads = F.filter(F.split("markdown", "\n"), lambda x: F.startswith(T.strip(x), F.lit("#")))
    head = F.array_max(F.flatten(F.transform(heads, lambda x: F.filter(T.tokens(x), year))))
    first = F.filter(T.tokens(F.substring("markdown", 1, 2000)), year)
    counted = F.transform(F.array_distinct(first), lambda y: F.struct(F.size(F.filter(first, lambda z: z == y)).alias("n"), (-F.array_position(first, y)).alias("p"), y.alias("y")))
    return r.select("doc_id", F.coalesce(in_name, head, F.array_max(counted)["y"]).alias("year"))


def small_chunks(spark, d) -> DataFrame:
    c = chunks(spark, d).filter("text is not null").select(F.coalesce("source_file", F.lit("")).alias("source_file"), "chunk_index", "chunk_id", T.token_count(F.col("text")).alias("tokens"), "text", "is_table")
    return C.merge_small(c, "source_file", ["chunk_index", "chunk_id"], "tokens", "text").select("source_file", "chunk_id", "tokens", F.md5("text").alias("text_hash"))


def windows(spark, d):
    """Documents to chunks worth indexing: sanitised, cut in windows of words, identified, exact duplicates dropped."""
    w = C.window_chunks(table(spark, d, "documents").select("doc_id", T.sanitize_whitespace(F.col("text")).alias("text")), "doc_id", "text", 100, 20).filter("words >= 15")
    w = w.withColumn("h", F.md5(F.lower("chunk"))).withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("doc_id", "chunk_index")))
    return w.filter("n = 1").select(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))), 1, 12).alias("chunk_id"), "doc_id", "chunk_index", "words", F.col("h").alias("text_hash"))


def scan_blocks(spark, d) -> DataFrame:
    return table(spark, d, "blocks").distinct()


def pipeline(spark, d):
    """The scans' blocks to chunks by the whole chunker."""
    return B.chunk_blocks(scan_blocks(spark, d)).select("chunk_id", "doc_id", "chunk_index", "tokens", "section", "is_table", F.md5("text").alias("text_hash"))


def parts(spark, d) -> DataFrame:
    """A table of orders' lines, a page each: row boxes with headers and column boxes, and a text in the middle of each box."""
    return boxes(spark, d).withColumn("header", F.col("idx") == 1)


def spans(spark, d):
    """Texts in the cells of a grid made from the lines of the first orders."""
    p = parts(spark, d)
    rows = p.join(L.dedup_rows(p), ["page_no", "idx"], "left_semi")
    cols = p.join(L.dedup_columns(p), ["page_no", "idx"], "left_semi")
    s = p.select("page_no", "idx", "x1", "y1", "x2", "y2", F.concat(F.lit("s"), F.col("idx").cast("string")).alias("text"))
    return L.cell_texts(s, L.assign_spans(s, L.cells_of(rows, cols)))


def labelled(spark, d) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("Plain Text", "title", "table", "abandon", "figure"))), (F.pmod("l_partkey", F.lit(5)) + 1).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("page_no"), label.alias("label"))


def routed(spark, d):
    """Pages of suppliers with as many elements as they have order lines."""
    pages = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("page_no"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(" ")).otherwise(F.col("s_name")).alias("text"), F.lit(0).alias("images"))
    return L.route_pages(pages, L.element_counts(labelled(spark, d))).select("page_no", "route", "warning")


def pairs_of_boxes(spark, d):
    return L.overlapping(boxes(spark, d), "y").select("page_no", "a", "b", F.round("share", 6).alias("share"))


def frames(spark, d):
    """The nations of each region as a Markdown table."""
    return C.frame_markdown(table(spark, d, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"]).withColumnRenamed("n_regionkey", "region")


QUERIES = {
    "markdown_blocks": lambda spark, d: blocks(spark, d).select("doc_id", "block_no", "kind", "page", "lines", F.md5("content").alias("content_hash")),
    "markdown_table_rows": lambda spark, d: rows(spark, d).select("doc_id", "block_no", F.array_join("names", "|").alias("names"), F.array_join("cells", "|").alias("cells")),
    "table_sentences": lambda spark, d: rows(spark, d).select("doc_id", "block_no", C.row_prose(F.col("names"), F.col("cells")).alias("prose")),
    "table_sentences_b": lambda spark, d: C.table_sentences(blocks(spark, d), KEYS).select("doc_id", "block_no", "sentence"),
    "table_row_batches": lambda spark, d: C.batch_rows(rows(spark, d).withColumn("tokens", T.token_count(C.row_prose(F.col("names"), F.col("cells")))), KEYS, "row_no", "tokens", 40),
    "table_title_binding": lambda spark, d: binding(spark, d).withColumn("title", F.md5("title")),
    "heading_path": lambda spark, d: C.heading_paths(headings(spark, d), "doc_id", "block_index", "title", "level"),
    "block_islands": lambda spark, d: B.sessions(scan_blocks(spark, d)).filter("not tab").groupBy("doc_id", "island").agg(F.min("block_index").alias("first_block"), F.count("*").alias("blocks")).select("doc_id", "first_block", "blocks"),
    "table_chunks": lambda spark, d: B.table_chunks(B.sessions(scan_blocks(spark, d))).select("doc_id", "island", "part", F.md5("text").alias("text_hash")),
    "frame_markdown": frames,
    "layout_element_counts": lambda spark, d: L.element_counts(labelled(spark, d)),
    "page_routing": routed,
    "box_overlaps": pairs_of_boxes,
    "table_row_boxes": lambda spark, d: L.dedup_rows(parts(spark, d)),
    "table_column_boxes": lambda spark, d: L.dedup_columns(parts(spark, d)),
    "cell_texts": spans,
    "block_sessions": sessions,
    "dominant_section": dominant,
    "doc_year": doc_year,
    "chunk_documents": lambda spark, d: C.window_chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "first_word", "words", F.md5("chunk").alias("text_hash")),
    "sentence_chunks": lambda spark, d: C.sentence_chunks(table(spark, d, "documents"), "doc_id", "text"),
    "merge_small_chunks": small_chunks,
    "window_pipeline": windows,
    "chunk_pipeline": pipeline,
    "chunk_stats": lambda spark, d: chunks(spark, d).groupBy("doc_year").agg(F.count("*").alias("chunks"), F.count_if("is_table").alias("tables"), F.round(F.avg(F.coalesce(T.token_count(F.col("text")), F.lit(0))), 4).alias("tokens")),
    "corpus_stats": lambda spark, d: chunks(spark, d).agg(F.count("*").alias("chunks"), F.count_distinct("source_file").alias("files"), F.count_distinct("doc_id").alias("documents"), F.sum(F.coalesce(T.token_count(F.col("text")), F.lit(0))).alias("tokens")).crossJoin(table(spark, d, "g_entity").agg(F.count_distinct("entity_key").alias("entities"))).crossJoin(table(spark, d, "lineitem").agg(F.count_distinct("l_suppkey", "l_partkey").alias("relations"))),  # one row each
    "distinct_sources": lambda spark, d: table(spark, d, "chunks").filter("source_file is not null").select("source_file").distinct(),
    "section_first_page": lambda spark, d: chunks(spark, d).filter("coalesce(section, '') <> ''").groupBy("section").agg(F.min_by("page_no", F.struct("source_file", "chunk_index", "chunk_id")).alias("page")).select(F.concat("section", F.lit(" (Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(")")).alias("section")),
    "reconstruct_document": lambda spark, d: chunks(spark, d).groupBy("source_file").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")).alias("text_hash")),
    "layout_nms": lambda spark, d: L.suppress(boxes(spark, d)),
    "reading_order": lambda spark, d: L.reading_order(boxes(spark, d)),
}

_ST = r"regexp_replace({c}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
_BL = rf"""r AS (SELECT DISTINCT ON (doc_id) doc_id, file_name, markdown FROM parse_results WHERE markdown IS NOT NULL),
li AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS line_no FROM r),
pg AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^## Page [0-9]+\s*$') THEN regexp_extract(line, '[0-9]+')::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page FROM li),
kd AS (SELECT *, CASE WHEN {_ST.format(c='line')} = '' THEN 'blank' WHEN regexp_matches(line, '^#+ ') THEN 'heading' WHEN regexp_matches(line, '^\s*\|') THEN 'table' ELSE 'text' END AS kind FROM pg WHERE NOT regexp_matches(line, '^## Page [0-9]+\s*$')),
ch AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w, '') <> kind OR kind = 'heading' OR page IS DISTINCT FROM lag(page) OVER w THEN 1 ELSE 0 END AS c FROM kd WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
il AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM ch),
bg AS (SELECT doc_id, island, kind, page, count(*) AS lines, string_agg(line, chr(10) ORDER BY line_no) AS content FROM il WHERE kind <> 'blank' GROUP BY ALL),
bk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island)::INT AS block_no FROM bg)"""
_CELLS = "list_transform(string_split(regexp_replace({l}, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: " + _ST.format(c="x") + ")"
_SEP = r"regexp_matches({c}, '^\s*\|?\s*:?-{{2,}}:?\s*(\|\s*:?-{{2,}}:?\s*)+\|?\s*$')"
_TR = f"""{_BL},
tl AS (SELECT doc_id, block_no, list_filter(list_transform(string_split(content, chr(10)), lambda x: {_ST.format(c='x')}), lambda x: x <> '') AS ls FROM bk WHERE kind = 'table'),
ts AS (SELECT *, list_position(list_transform(ls, lambda x: {_SEP.format(c='x')}), true) AS p FROM tl),
th AS (SELECT *, {_CELLS.format(l='ls[p - 1]')} AS header FROM ts WHERE p > 1 AND p < len(ls)),
tn AS (SELECT doc_id, block_no, ls, p, list_transform(header, lambda h, i: CASE WHEN h = '' THEN 'UNNAMED_COLUMN_' || (i - 1) ELSE h END) AS names, header FROM th),
tb AS (SELECT doc_id, block_no, names, header, unnest(list_filter(ls[p + 1 :], lambda x: NOT {_SEP.format(c='x')})) AS line, generate_subscripts(list_filter(ls[p + 1 :], lambda x: NOT {_SEP.format(c='x')}), 1) AS row_no FROM tn),
tc AS (SELECT doc_id, block_no, row_no, names, header, {_CELLS.format(l='line')} AS cells FROM tb),
tp AS (SELECT doc_id, block_no, row_no, names, list_transform(range(1, len(names) + 1), lambda i: coalesce(cells[i], '')) AS cells FROM tc WHERE len(list_filter(header, lambda x: x <> '')) > 0),
tr AS (SELECT * FROM tp WHERE len(list_filter(cells, lambda x: x <> '')) > 0)"""
_PROSE = "array_to_string(list_filter(list_transform(names, lambda n, i: CASE WHEN cells[i] <> '' THEN n || ': ' || cells[i] END), lambda x: x IS NOT NULL), ', ')"
_WIN = r"""w AS (SELECT doc_id, regexp_extract_all({t}, '([^ \t\n\r\f\x0B]+)', 1) AS w FROM documents WHERE text IS NOT NULL),
ix AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 100) / 80)::INT) + 1)) AS i FROM w WHERE len(w) > 0),
wc AS (SELECT doc_id, i::INT AS chunk_index, (i * 80)::INT AS first_word, len(w[i * 80 + 1 : i * 80 + 100])::INT AS words, array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS chunk FROM ix)"""
_TOK = "coalesce(len(regexp_extract_all(text, '([^ \\t\\n\\r\\f\\x0B]+)', 1)), 0)"


def _sanitized() -> str:
    from veldra.queries.text import SQL as text_sql

    return text_sql["sanitize_whitespace"].removeprefix("SELECT doc_id, ").removesuffix(" AS value FROM documents")


def _heads() -> str:
    from veldra.queries.text import SQL as text_sql

    level = text_sql["heading_level"]
    return level.replace("SELECT doc_id, block_index, (CASE", "SELECT doc_id, block_index, c AS title, (CASE")


_HEADS = _heads()

SQL = {
    "markdown_blocks": f"WITH {_BL} SELECT doc_id, block_no, kind, page, lines, md5(content) AS content_hash FROM bk",
    "markdown_table_rows": f"WITH {_TR} SELECT doc_id, block_no, array_to_string(names, '|') AS names, array_to_string(cells, '|') AS cells FROM tr",
    "table_sentences": f"WITH {_TR} SELECT doc_id, block_no, array_to_string(list_filter(list_transform(names, lambda n, i: CASE WHEN cells[i] <> '' THEN n || ': ' || cells[i] END), lambda x: x IS NOT NULL), ', ') AS prose FROM tr",
    "table_sentences_b": f"WITH {_TR} SELECT doc_id, block_no, array_to_string(list_transform(header, lambda n, i: n || '=' || cells[i]), ', ') AS sentence FROM tc WHERE len(cells) = len(header)",
    "table_row_batches": f"""WITH RECURSIVE {_TR}, tz AS (SELECT doc_id, block_no, row_no, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY row_no) AS i, len(regexp_extract_all({_PROSE}, '([^ \\t\\n\\r\\f\\x0B]+)', 1)) AS n FROM tr),
g AS (SELECT doc_id, block_no, row_no, i, 0 AS batch, n AS total FROM tz WHERE i = 1 UNION ALL
  SELECT t.doc_id, t.block_no, t.row_no, t.i, g.batch + CASE WHEN g.total > 0 AND g.total + t.n > 40 THEN 1 ELSE 0 END, CASE WHEN g.total > 0 AND g.total + t.n > 40 THEN t.n ELSE g.total + t.n END FROM g JOIN tz t ON t.doc_id = g.doc_id AND t.block_no = g.block_no AND t.i = g.i + 1)
SELECT doc_id, block_no, row_no::INT AS row_no, batch::INT AS batch FROM g""",
    "heading_path": """WITH RECURSIVE h AS (SELECT doc_id, block_index, title, level, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS i FROM ({heads})),
g AS (SELECT doc_id, block_index, i, [{{'l': level, 't': title}}] AS o FROM h WHERE i = 1 UNION ALL SELECT h.doc_id, h.block_index, h.i, list_append(list_filter(g.o, lambda x: x.l < h.level), {{'l': h.level, 't': h.title}}) FROM g JOIN h ON h.doc_id = g.doc_id AND h.i = g.i + 1)
SELECT doc_id, block_index, array_to_string(list_transform(o, lambda x: x.t), ' > ') AS path FROM g""".format(heads=_HEADS),
    "frame_markdown": "SELECT n_regionkey AS region, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
    "layout_element_counts": "SELECT * FROM (SELECT l_suppkey::INT AS page_no, ['plain text', 'title', 'table', 'abandon', 'figure'][l_partkey % 5 + 1] AS label, count(*) AS n FROM lineitem GROUP BY ALL) WHERE label <> 'abandon'",
    "page_routing": """WITH n AS (SELECT l_suppkey AS k, count(*) FILTER (l_partkey % 5 <> 3) AS e, count(*) FILTER (l_partkey % 5 < 2) AS t FROM lineitem GROUP BY 1),
r AS (SELECT s_suppkey::INT AS page_no, CASE WHEN coalesce(t, 0) >= 60 OR coalesce(e, 0) >= 80 THEN 'complex' WHEN s_suppkey % 3 = 0 THEN CASE WHEN coalesce(e, 0) = 0 THEN 'blank' ELSE 'scanned' END ELSE 'text' END AS route FROM supplier LEFT JOIN n ON k = s_suppkey)
SELECT page_no, route, CASE route WHEN 'complex' THEN 'Page ' || page_no || ': complex layout, skipped' WHEN 'scanned' THEN 'Page ' || page_no || ': scanned, no text layer' END AS warning FROM r""",
    "box_overlaps": """WITH b AS (SELECT l_orderkey::INT AS page_no, l_linenumber AS idx, (l_suppkey % 10) * 8.0::DOUBLE AS y1, (l_suppkey % 10) * 8.0::DOUBLE + 12 AS y2 FROM lineitem),
p AS (SELECT a.page_no, a.idx AS a, b.idx AS b, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS share FROM b a JOIN b ON a.page_no = b.page_no AND a.idx < b.idx)
SELECT page_no, a, b, round(share, 6) AS share FROM p WHERE share > 0.85""",
    "merge_small_chunks": f"""WITH {C_SQL}, s AS (SELECT coalesce(source_file, '') AS source_file, chunk_index, chunk_id, text, coalesce(is_table, false) AS t, {_TOK} AS n FROM c WHERE text IS NOT NULL),
i AS (SELECT *, row_number() OVER w AS i, lead(t) OVER w AS nt, lead(n) OVER w AS nn, lead(text) OVER w AS ntext FROM s WINDOW w AS (PARTITION BY source_file ORDER BY chunk_index NULLS FIRST, chunk_id)),
l AS (SELECT *, coalesce(n < 60 AND NOT t AND NOT nt, false) AS link FROM i),
o AS (SELECT *, i - coalesce(max(CASE WHEN NOT link THEN i END) OVER (PARTITION BY source_file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l)
SELECT source_file, chunk_id, (CASE WHEN link THEN n + nn ELSE n END)::BIGINT AS tokens, md5(CASE WHEN link THEN text || chr(10) || ntext ELSE text END) AS text_hash FROM o WHERE place % 2 = 1""",
    "doc_year": f"""WITH r AS (SELECT DISTINCT ON (doc_id) doc_id, coalesce(file_name, '') AS file_name, markdown FROM parse_results WHERE markdown IS NOT NULL),
y AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(file_name, '(.)\\.[^.]*$', '\\1'), '([A-Za-z0-9_]+)', 1), lambda t: regexp_full_match(t, '(19|20)[0-9]{{2}}'))[1] AS a,
  list_max(flatten(list_transform(list_filter(string_split(markdown, chr(10)), lambda x: starts_with({_ST.format(c='x')}, '#')), lambda x: list_filter(regexp_extract_all(x, '([A-Za-z0-9_]+)', 1), lambda t: regexp_full_match(t, '(19|20)[0-9]{{2}}'))))) AS b,
  list_filter(regexp_extract_all(left(markdown, 2000), '([A-Za-z0-9_]+)', 1), lambda t: regexp_full_match(t, '(19|20)[0-9]{{2}}')) AS c FROM r)
SELECT doc_id, coalesce(a, b, (SELECT v FROM (SELECT unnest(c) AS v, generate_subscripts(c, 1) AS i) GROUP BY v ORDER BY count(*) DESC, min(i) LIMIT 1)) AS year FROM y""",
    "table_title_binding": f"""WITH {_BL}, m AS (SELECT *, kind = 'text' AND length({_ST.format(c='content')}) < 150 AND {_ST.format(c='content')} <> '' AS short FROM bk), l AS (SELECT *, lag(content) OVER w AS b, lag(short) OVER w AS bs, lead(kind) OVER w AS nk FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))
SELECT doc_id, block_no, kind, md5(CASE WHEN kind = 'table' AND bs THEN b END) AS title FROM l WHERE NOT coalesce(short AND nk = 'table', false)""",
    "block_sessions": "WITH b AS (SELECT DISTINCT * FROM blocks), c AS (SELECT *, CASE WHEN coalesce(lag(section) OVER w, '') <> coalesce(section, '') OR lag(block_index) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)), r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY block_index)::INT AS run FROM c) SELECT doc_id, run, min(block_index) AS first_block, count(*) AS blocks FROM r GROUP BY ALL",
    "dominant_section": "WITH n AS (SELECT doc_id, page_no, section, count(*) AS n, min(block_index) AS f FROM (SELECT DISTINCT * FROM blocks) WHERE coalesce(section, '') <> '' GROUP BY ALL) SELECT DISTINCT ON (doc_id, page_no) doc_id, page_no, section FROM n ORDER BY doc_id, page_no, n DESC, f",
    "chunk_documents": f"WITH {_WIN.format(t='text')} SELECT doc_id, chunk_index, first_word, words, md5(chunk) AS text_hash FROM wc",
    "window_pipeline": f"WITH {_WIN.replace('{t}', _sanitized())}, h AS (SELECT *, md5(lower(chunk)) AS h, row_number() OVER (PARTITION BY md5(lower(chunk)) ORDER BY doc_id, chunk_index) AS n FROM wc WHERE words >= 15) SELECT md5(doc_id::VARCHAR || chunk_index::VARCHAR)[1:12] AS chunk_id, doc_id, chunk_index, words, h AS text_hash FROM h WHERE n = 1",
    "chunk_stats": f"WITH {C_SQL} SELECT doc_year, count(*) AS chunks, count(*) FILTER (is_table) AS tables, round(avg({_TOK}), 4) AS tokens FROM c GROUP BY doc_year",
    "corpus_stats": f"WITH {C_SQL} SELECT count(*) AS chunks, count(DISTINCT source_file) AS files, count(DISTINCT doc_id) AS documents, sum({_TOK})::BIGINT AS tokens, (SELECT count(DISTINCT entity_key) FROM g_entity) AS entities, (SELECT count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem) AS relations FROM c",
    "distinct_sources": "SELECT DISTINCT source_file FROM chunks WHERE source_file IS NOT NULL",
    "section_first_page": f"WITH {C_SQL} SELECT section || ' (Page ' || coalesce(page_no::VARCHAR, '?') || ')' AS section FROM (SELECT DISTINCT ON (section) section, page_no FROM c WHERE section <> '' ORDER BY section, source_file NULLS FIRST, chunk_index NULLS FIRST, chunk_id)",
    "reconstruct_document": f"WITH {C_SQL} SELECT source_file, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_index NULLS FIRST, chunk_id)) AS text_hash FROM c GROUP BY source_file",
}
