"""Queries of the operators in this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veldra.llm.abuse import abuse_rates, abuse_scores
from veldra.llm.conversations import STAND_INS, SPELLINGS, conversations
from veldra.llm.leakage import leak_report, leaked_items
from veldra.llm.names import Parties
from veldra.llm.neardup import NearDuplicates
from veldra.llm.neighbours import Neighbours
from veldra.llm.packing import pack, window_fill, window_mixture
from veldra.llm.scans import ScanRepair
from veldra.llm.splitting import split_items
from veldra.tables import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return leak_report(leaked_items(table(spark, d, "documents"), items), items)


def _neighbours(spark: SparkSession, d: str) -> Neighbours:
    return Neighbours(table(spark, d, "chunks"), "chunk_id", "dense")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).mutual(0.90).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).lists().withColumnRenamed("id", "chunk_id")


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "history"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_conversations(spark, d).select("session_id", "turn_no", "message_id")


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(table(spark, d, "chunks"), "chunk_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).record_pairs().select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("id", "chunk_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_items(table(spark, d, "chunks"), keep=("section", "page_range"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).filter("piece_no = 1").select("chunk_id").distinct()


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return window_fill(p7_windows(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return window_mixture(p7_windows(spark, d))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).filter("abusive").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(p9_scores(spark, d))


def _scans(spark: SparkSession, d: str) -> ScanRepair:
    return ScanRepair(*(table(spark, d, t) for t in ("pages", "blocks", "parse_results")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).faults()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).paragraphs()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return Parties(table(spark, d, "g_entity")).pairs()


def p3_parties(spark: SparkSession, d: str) -> DataFrame:
    return Parties(table(spark, d, "g_entity")).members()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_conversations": p2_conversations,
    "p3_found": p3_found,
    "p3_parties": p3_parties,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_windows": p7_windows,
    "p7_fill": p7_fill,
    "p7_mixture": p7_mixture,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}

_RUNS_12 = """
words AS (
  SELECT DISTINCT {id}, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w
  FROM {table} WHERE {id} IS NOT NULL AND text IS NOT NULL
), {name} AS (
  SELECT DISTINCT {id}, array_to_string(w[i : i + 11], ' ') AS run
  FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i FROM words)
)"""

_BLANK_SQL = r"[\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}]"


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_CONVERSATIONS = f"""
WITH r AS (
  SELECT DISTINCT session_id, message_id, content, timestamp AS time, regexp_replace(lower(coalesce(role, '')), '[^a-z]', '', 'g') AS role
  FROM history WHERE session_id IS NOT NULL AND regexp_replace(session_id, '{_BLANK_SQL}', '', 'g') <> ''
), s AS (
  SELECT *, CASE {" ".join(f"WHEN role IN ({_quoted(names)}) THEN '{who}'" for who, names in SPELLINGS.items())} ELSE 'unknown' END AS speaker,
    regexp_replace(coalesce(content, ''), '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g') AS said FROM r
), m AS (
  SELECT *, lag(speaker) OVER w AS last_speaker, lag(said) OVER w AS last_said FROM s WHERE speaker <> 'helper'
  WINDOW w AS (PARTITION BY session_id ORDER BY time NULLS FIRST, message_id NULLS FIRST)
), k AS (
  SELECT *, row_number() OVER w AS turn_no, count(*) OVER (PARTITION BY session_id) AS n FROM m
  WHERE last_speaker IS NULL OR last_speaker <> speaker OR last_said <> said
  WINDOW w AS (PARTITION BY session_id ORDER BY time NULLS FIRST, message_id NULLS FIRST)
), bad AS (
  SELECT session_id FROM k
  WHERE speaker <> CASE WHEN turn_no % 2 = 1 THEN 'user' ELSE 'assistant' END OR n % 2 = 1
     OR regexp_replace(said, '{_BLANK_SQL}', '', 'g') = '' OR lower(regexp_replace(said, '{_BLANK_SQL}', '', 'g')) IN ({_quoted(STAND_INS)})
)
"""

SQL: dict[str, str] = {
    "p2_found": _CONVERSATIONS + "SELECT session_id, turn_no::INT AS turn_no, message_id FROM k WHERE session_id NOT IN (FROM bad)",
    "p2_conversations": _CONVERSATIONS + "SELECT session_id, turn_no::INT AS turn_no, message_id, speaker, content FROM k WHERE session_id NOT IN (FROM bad)",
    "p1_found": """
WITH v AS (
  SELECT DISTINCT chunk_id, dense::DOUBLE[64] AS x FROM chunks
  WHERE chunk_id IS NOT NULL AND len(dense) = 64 AND list_sum(list_transform(dense, lambda y: y::DOUBLE * y)) > 0
), pairs AS (
  SELECT a.chunk_id AS q, b.chunk_id AS n, array_cosine_similarity(a.x, b.x) AS c
  FROM v a JOIN v b ON a.chunk_id <> b.chunk_id
), best AS (
  SELECT q, n, c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS r FROM pairs) WHERE r <= 10
)
SELECT a.q AS chunk_a, a.n AS chunk_b FROM best a JOIN best b ON a.q = b.n AND a.n = b.q WHERE a.q < a.n AND a.c >= 0.90""",
    "p5_found": """
WITH words AS (
  SELECT DISTINCT chunk_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w
  FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL
), sets AS (
  SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM words WHERE len(w) >= 20
), runs AS (SELECT chunk_id, len(s) AS n, unnest(s) AS run FROM sets),
shared AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, a.n AS n_a, b.n AS n_b, count(*) AS c
  FROM runs a JOIN runs b ON a.run = b.run AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT DISTINCT chunk_a, chunk_b FROM shared WHERE c / (n_a + n_b - c) >= 0.6 - 1e-12""",
    "p6_found": r"""
SELECT DISTINCT chunk_id FROM chunks
WHERE len(regexp_extract_all(text, '[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+')) > 650""",
    "p8_found": f"""
WITH d AS (WITH {_RUNS_12.format(id="doc_id", table="documents", name="r")} SELECT * FROM r),
     b AS (WITH {_RUNS_12.format(id="item_id", table="benchmark", name="r")} SELECT * FROM r)
SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (run)""",
}
