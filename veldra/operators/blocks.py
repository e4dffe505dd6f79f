"""Blocks of parsed documents to chunks: sessions of blocks, overlap, tables, deduplication, merging.

A document's blocks are cut into *islands* that no chunk crosses: a heading, a table or a change of
section ends one. Islands are found by windows; only the filling of chunks inside an island is
a fold, so a large document is spread over its islands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from veldra.functions import text as T
from veldra.operators import chunking as C


@dataclass(frozen=True)
class Profile:
    """Sizes in words; the values are the two engines' settings."""

    size: int = 1000
    overlap: int = 200
    table: int = 650
    table_rows: int = 10
    title: int = 150
    merge_below: int = 60
    least: int = 15
    alike: float = 0.95
    #: Split by the meaning of sentences, where an embedder is given.
    semantic: float | None = None


A, B = Profile(), Profile(size=650, overlap=100, alike=0.85)


def numbered_guard(text: str) -> str:
    """The text with the full stops of list numbers hidden from the sentence splitter."""
    import re

    return re.sub(r"\b(\d{1,3})\.(?=\s+[A-Za-z])", r"\1<DOT>", text)


def split_sentences(text: str) -> list[str]:
    import re

    return [s for s in (x.strip() for x in re.split(r"(?<=[.?!])\s+", text)) if s]


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences packed up to ``size`` words, the last ones of up to ``overlap`` words repeated; a longer sentence is cut by words."""
    pieces: list[tuple[str, int]] = []
    for s in split_sentences(numbered_guard(text)):
        w = s.split()
        if len(w) <= size:
            pieces.append((s, len(w)))
        else:
            pieces += [(" ".join(w[i : i + size]), len(w[i : i + size])) for i in range(0, len(w), size)]
    out: list[str] = []
    now: list[tuple[str, int]] = []
    n = 0
    for s, m in pieces:
        if now and n + m > size:
            out.append(" ".join(x for x, _ in now))
            kept, kept_n = [], 0
            for x, k in reversed(now):
                if kept_n + k > overlap or kept_n + k + m > size:
                    break
                kept.insert(0, (x, k))
                kept_n += k
            now, n = kept, kept_n
        now.append((s, m))
        n += m
    if now:
        out.append(" ".join(x for x, _ in now))
    return [x.replace("<DOT>", ".") for x in out]


def semantic_split(text: str, embed: Callable[[list[str]], np.ndarray], least: float = 0.6, size: int = 500) -> list[str]:
    """Sentences in a row, cut where neighbours' cosine is under ``least`` or the piece would have over ``size`` words; [] if the embedder fails."""
    sentences = split_sentences(text)
    if len(sentences) <= 1:
        return [text]
    try:
        x = np.asarray(embed(sentences), np.float64)
    except Exception:  # noqa: BLE001
        return []
    if len(x) != len(sentences):
        return []
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(length == 0, 1, length)
    out, now, n = [], [sentences[0]], len(sentences[0].split())
    for i, s in enumerate(sentences[1:]):
        m = len(s.split())
        if float(x[i] @ x[i + 1]) < least or n + m > size:
            out.append(" ".join(now))
            now, n = [s], m
        else:
            now.append(s)
            n += m
    return [*out, " ".join(now)]


def fill(blocks: list[dict], size: int, overlap: int) -> list[list[dict]]:
    """Groups of an island's blocks: a group ends at ``size`` words and the next begins with its last blocks of up to ``overlap`` words.

    ``title``: whether the last block is the title of the table that ends the island; it is taken out if it still waits.
    """
    out, now, n = [], [], 0
    for b in blocks:
        now.append(b)
        n += 0 if b["heading"] else b["words"]
        if n >= size and not b["heading"]:
            out.append(list(now))
            kept, n = [], 0
            for x in reversed(now):
                if n + x["raw_words"] > overlap:
                    break
                kept.insert(0, x)
                n += x["raw_words"]
            now = kept
    if now and now[-1]["title"]:
        now.pop()
    if now:
        out.append(now)
    return out


def sessions(blocks: DataFrame) -> DataFrame:
    """Blocks with ``clean, heading, tab, path, title, island``: what belongs together, and tables' titles.

    ``blocks``: doc_id, block_index, block_type, content, page_no, page_label, section, is_table.
    Text not worth a vector is left out. path: titles of the open headings, else the section.
    """
    w = Window.partitionBy("doc_id").orderBy("block_index")
    b = blocks.withColumn("clean", T.sanitize_whitespace(F.coalesce("content", F.lit(""))))
    b = b.withColumn("tab", F.coalesce("is_table", F.lit(False))).withColumn("heading", F.coalesce(F.col("block_type").isin("heading", "title"), F.lit(False)) & ~F.coalesce("is_table", F.lit(False)))
    heads = b.filter("heading").select("doc_id", "block_index", F.col("clean").alias("t"), T.heading_level(F.col("clean")).alias("l"))
    b = b.join(C.heading_paths(heads, "doc_id", "block_index", "t", "l"), ["doc_id", "block_index"], "left")
    b = b.withColumn("path", F.last("path", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    short = (F.col("block_type") == "text") & (F.col("clean") != "") & (F.length("clean") < 150)
    b = b.withColumn("title", F.when(F.col("tab") & F.lag(short).over(w), F.lag("clean").over(w))).withColumn("is_title", F.coalesce(short & F.lead("tab").over(w), F.lit(False)))
    b = b.filter(F.col("tab") | F.col("heading") | T.embeddable(F.col("clean"), F.lit(False)))
    changed = F.col("tab") | F.col("heading") | F.lag("tab").over(w) | ~F.col("section").eqNullSafe(F.lag("section").over(w)) | F.lag("block_index").over(w).isNull()
    return b.withColumn("island", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


_CHUNK = "island long, part int, text string, body string, page_no int, page_label string, page_from int, page_to int, section string, is_table boolean"


def text_chunks(sessioned: DataFrame, profile: Profile = A, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Chunks of the islands of text: ``doc_id, island, part, text, body, page ..., section, is_table``."""
    kind = dict(sessioned.dtypes)["doc_id"]
    fields = ("block_index", "clean", "heading", "page_no", "page_label", "section", "path", "is_title")
    raw = T.token_count(F.coalesce("content", F.lit(""))).alias("raw_words")
    own = sessioned.filter("not tab").groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct(*fields, T.token_count(F.col("clean")).alias("words"), raw))).alias("bs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, island, bs in zip(batch["doc_id"], batch["island"], batch["bs"]):
                part = 0
                rows = [{**(b if isinstance(b, dict) else b.asDict()), "title": b["is_title"] and i == len(bs) - 1} for i, b in enumerate(bs)]
                for group in fill(rows, profile.size, profile.overlap):
                    merged = "\n".join(b["clean"] for b in group)
                    named = [b["section"] for b in group if b["section"]]
                    dominant = max(dict.fromkeys(named), key=named.count) if named else ""
                    path = group[-1]["path"] or dominant
                    pieces = semantic_split(merged, embed, profile.semantic, profile.size) if embed and profile.semantic is not None else []
                    for piece in pieces or pack_sentences(merged, profile.size, profile.overlap):
                        out.append((doc, island, part, f"[{path}]\n{piece}" if path else piece, piece, group[0]["page_no"], group[0]["page_label"], group[0]["page_no"], group[-1]["page_no"], path, False))
                        part += 1
            yield pd.DataFrame(out, columns=["doc_id", *(c.split()[0] for c in _CHUNK.split(", "))])

    made = own.mapInPandas(run, f"doc_id {kind}, {_CHUNK}")
    return made.filter(T.embeddable(F.col("body"), F.lit(False)))


def table_chunks(sessioned: DataFrame, profile: Profile = A) -> DataFrame:
    """Chunks of tables, in the same form: a row each, or batches of rows of a table too large in words and rows."""
    t = sessioned.filter("tab").withColumn("kind", F.lit("table")).withColumn("path", F.coalesce("path", "section", F.lit("")))
    keys = ["doc_id", "island", "page_no", "page_label", "path", "title"]
    large = T.token_count(F.col("clean")).alias("table_words")
    rows = C.table_rows(t.select(*keys, "kind", "clean", large), [*keys, "table_words"], "clean").withColumn("prose", C.row_prose(F.col("names"), F.col("cells")))
    rows = rows.withColumn("words", T.token_count(F.col("prose"))).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "island")))
    batched = rows.filter((F.col("table_words") > profile.table) & (F.col("n") > profile.table_rows))
    batches = C.batch_rows(batched, ["doc_id", "island"], "row_no", "words", profile.table)
    rows = rows.join(batches, ["doc_id", "island", "row_no"], "left").withColumn("part", F.coalesce("batch", F.col("row_no") - 1).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "prose"))), lambda r: r["prose"])
    made = rows.groupBy(*keys, "part").agg(F.array_join(lines, "\n").alias("rows"))
    head = [F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Table Title: "), "title")), F.when(F.col("path") != "", F.concat(F.lit("Section: "), "path"))]
    text = F.concat_ws("\n", *head, "rows")
    return made.select("doc_id", "island", "part", text.alias("text"), text.alias("body"), "page_no", "page_label", F.col("page_no").alias("page_from"), F.col("page_no").alias("page_to"), F.col("path").alias("section"), F.lit(True).alias("is_table"))


def drop_near(chunks: DataFrame, by: list[str], order: str, text: str, alike: float) -> DataFrame:
    """Chunks but for those of which an earlier kept one has the same fingerprint and shingles alike in ``alike`` of all; tables all stay."""
    c = chunks.withColumn("__f", T.fingerprint(F.col(text)))
    plain, tables = c.filter(~F.coalesce("is_table", F.lit(False))), c.filter(F.coalesce("is_table", F.lit(False)))
    several = plain.groupBy(*by, "__f").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    kind = dict(chunks.dtypes)

    def greedy(own: pd.DataFrame) -> pd.DataFrame:
        kept: list[set[str]] = []
        gone = []
        for r in own.sort_values(order).to_dict("records"):
            t = " ".join((r[text] or "").lower().split())
            n = 12 if len(r[text] or "") > 500 else 6
            s = {t[i : i + n] for i in range(len(t) - n + 1)}
            if any(s | k and len(s & k) / len(s | k) >= alike for k in kept):
                gone.append({**{b: r[b] for b in by}, order: r[order]})
            else:
                kept.append(s)
        return pd.DataFrame(gone, columns=[*by, order])

    gone = plain.join(several, [*by, "__f"], "left_semi").select(*by, "__f", order, text).groupBy(*by, "__f").applyInPandas(greedy, ", ".join(f"{k} {kind[k]}" for k in [*by, order]))
    return plain.join(gone, [*by, order], "left_anti").unionByName(tables).drop("__f")


def chunk_blocks(blocks: DataFrame, profile: Profile = A, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Chunks of documents given as blocks: ``chunk_id, doc_id, chunk_index, text, tokens, page_no, page_label, page_range, section, is_table``.

    Sessions of blocks with overlap, tables by row or batch, exact then near duplicates
    dropped by document, small chunks merged with the next one, the smallest dropped.
    Numbers aren't given anew after dropping and merging. Blocks repeated as a whole count
    once; null contents are empty. An empty table gives an empty result.
    """
    s = sessions(blocks.distinct())
    c = text_chunks(s, profile, embed).unionByName(table_chunks(s, profile))
    c = c.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("island", "part")) - 1).cast("int"))
    c = c.withColumn("h", F.md5(F.lower(F.regexp_replace(T.strip(F.col("text")), r"[ \t\n\r\f\x0B]+", " "))))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("chunk_index"))).filter("n = 1").drop("n", "h")
    c = drop_near(c, ["doc_id"], "chunk_index", "text", profile.alike).withColumn("tokens", T.token_count(F.col("text")))
    keep = ("page_no", "page_label", "page_from", "page_to", "section", "is_table")
    c = C.merge_small(c, "doc_id", ["chunk_index"], "tokens", "text", profile.merge_below, keep)
    c = c.filter((F.col("tokens") >= profile.least) | F.col("is_table"))
    return c.select(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))), 1, 12).alias("chunk_id"), "doc_id", "chunk_index", "text", "tokens", "page_no", "page_label", F.array("page_from", "page_to").alias("page_range"), "section", "is_table")
