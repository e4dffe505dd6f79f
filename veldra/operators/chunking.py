"""Markdown to blocks, tables to rows, headings to paths, texts to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.functions import text as T


def markdown_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line, page``: lines of a text with the page of the last ``## Page n`` line."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")
    own = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    page = F.regexp_extract("line", r"^## Page ([0-9]+)\s*$", 1)
    return lines.withColumn("page", F.last(F.when(page != "", page.cast("int")), ignorenulls=True).over(own)).filter(page == "")


def kind_of(line: Column) -> Column:
    return F.when(T.strip(line) == "", "blank").when(line.rlike("^#+ "), "heading").when(line.rlike(r"^\s*\|"), "table").otherwise("text")


def markdown_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, block_no, kind, page, first_line, lines, content``: runs of lines of one kind; blank lines part them."""
    lines = markdown_lines(df, key, text).withColumn("kind", kind_of(F.col("line")))
    w = Window.partitionBy(key).orderBy("line_no")
    change = (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")) | (F.col("kind") == "heading") | ~F.col("page").eqNullSafe(F.lag("page").over(w))
    lines = lines.withColumn("island", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    blocks = lines.filter("kind <> 'blank'").groupBy(key, "island", "kind", "page").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("content"))
    return blocks.withColumn("block_no", F.row_number().over(Window.partitionBy(key).orderBy("island")).cast("int")).drop("island")


def table_cells(line: Column) -> Column:
    """Cells of a table row, stripped; the bars at both ends don't count."""
    return F.transform(F.split(F.regexp_replace(T.strip(line), r"^\|+|\|+$", ""), r"\|"), T.strip)


#: A line of dashes between bars, at least two columns of them: a fixed value.
_SEPARATOR = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"


def is_separator(line: Column) -> Column:
    return line.rlike(_SEPARATOR)


def table_rows(blocks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys, row_no, names, cells``: the rows under the first separator line, named by the line before it.

    Short rows are padded, long ones cut, empty ones dropped. A table without a separator,
    without a line on either side of it, or with empty names only has no rows.
    """
    lines = F.filter(F.transform(F.split(content, "\n"), T.strip), lambda x: x != "")
    t = blocks.filter("kind = 'table'").withColumn("ls", lines)
    t = t.withColumn("at", F.array_position(F.transform("ls", is_separator), True).cast("int")).filter((F.col("at") > 1) & (F.col("at") < F.size("ls")))
    t = t.withColumn("header", table_cells(F.element_at("ls", F.col("at") - 1))).filter(F.exists("header", lambda h: h != ""))
    t = t.withColumn("names", F.transform("header", lambda h, i: F.when(h == "", F.concat(F.lit("UNNAMED_COLUMN_"), i.cast("string"))).otherwise(h)))
    body = t.select(*keys, "names", F.posexplode(F.filter(F.slice("ls", F.col("at") + 1, F.size("ls")), lambda x: ~is_separator(x))).alias("p", "line"))
    cells = table_cells(F.col("line"))
    padded = F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit("")))
    return body.select(*keys, (F.col("p") + 1).alias("row_no"), "names", padded.alias("cells")).filter(F.exists("cells", lambda c: c != ""))


def row_prose(names: Column, cells: Column) -> Column:
    """``name: cell, ...`` of the cells that aren't empty."""
    pairs = F.filter(F.arrays_zip(names.alias("n"), cells.alias("c")), lambda p: p["c"] != "")
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["n"], F.lit(": "), p["c"])), ", ")


def table_sentences(blocks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys, row_no, sentence``: rows as ``name=cell, ...``; rows with another number of cells than names are dropped."""
    lines = F.filter(F.transform(F.split(content, "\n"), T.strip), lambda x: x != "")
    t = blocks.filter("kind = 'table'").withColumn("ls", lines)
    t = t.withColumn("at", F.array_position(F.transform("ls", is_separator), True).cast("int")).filter((F.col("at") > 1) & (F.col("at") < F.size("ls")))
    t = t.withColumn("names", table_cells(F.element_at("ls", F.col("at") - 1)))
    body = t.select(*keys, "names", F.posexplode(F.filter(F.slice("ls", F.col("at") + 1, F.size("ls")), lambda x: ~is_separator(x))).alias("p", "line")).withColumn("cells", table_cells(F.col("line"))).filter("size(cells) = size(names)")
    pairs = F.transform(F.arrays_zip(F.col("names").alias("n"), F.col("cells").alias("c")), lambda p: F.concat(p["n"], F.lit("="), p["c"]))
    return body.select(*keys, (F.col("p") + 1).alias("row_no"), F.array_join(pairs, ", ").alias("sentence"))


def frame_markdown(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``key, markdown``: the rows of each key as one Markdown table; null cells are empty, line breaks blanks."""
    cells = [T.strip(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\n+", " ")) for c in columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return df.groupBy(key).agg(F.concat(F.lit(head + "\n"), F.array_join(rows, "\n")).alias("markdown"))


def heading_paths(headings: DataFrame, key: str, order: str, title: str, level: str) -> DataFrame:
    """``key, order, path``: the titles of the open headings, a heading closing all of its level and deeper ones.

    One fold over the headings of a document, in order; work grows with their number.
    """
    kind = dict(headings.dtypes)
    rows = headings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(level).alias("l"), F.col(title).alias("t")))).alias("hs"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, hs in zip(batch[key], batch["hs"]):
                open_: list[tuple[int, str]] = []
                for h in hs:
                    while open_ and open_[-1][0] >= h["l"]:
                        open_.pop()
                    open_.append((h["l"], h["t"]))
                    out.append((k, h["o"], " > ".join(t for _, t in open_)))
            yield pd.DataFrame(out, columns=[key, order, "path"])

    return rows.mapInPandas(fold, f"{key} {kind[key]}, {order} {kind[order]}, path string")


def window_chunks(df: DataFrame, key: str, text: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """``key, chunk_index, first_word, words, chunk``: windows of ``size`` words, each repeating ``overlap``."""
    step = size - overlap
    w = df.select(key, T.words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int"))
    at = w.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    piece = F.slice("w", F.col("chunk_index") * step + 1, size)
    return at.select(key, "chunk_index", (F.col("chunk_index") * step).alias("first_word"), F.size(piece).alias("words"), F.array_join(piece, " ").alias("chunk"))


def sentence_chunks(df: DataFrame, key: str, text: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """``key, chunk_index, words, chunk``: whole sentences packed up to ``size`` words, with the last ones that fit in ``overlap`` repeated."""
    kind = dict(df.dtypes)[key]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, sentences in zip(batch["key"], batch["s"]):
                now: list[str] = []
                n, index = 0, 0
                for s in sentences:
                    m = len(s.split())
                    if now and n + m > size:
                        out.append((k, index, n, " ".join(now)))
                        index += 1
                        kept, kept_n = [], 0
                        for x in reversed(now):
                            if kept_n + len(x.split()) > overlap:
                                break
                            kept.insert(0, x)
                            kept_n += len(x.split())
                        now, n = kept, kept_n
                    now.append(s)
                    n += m
                if now:
                    out.append((k, index, n, " ".join(now)))
            yield pd.DataFrame(out, columns=[key, "chunk_index", "words", "chunk"])

    rows = df.select(F.col(key).alias("key"), T.sentences(F.col(text)).alias("s")).filter(F.size("s") > 0)
    return rows.mapInPandas(pack, f"{key} {kind}, chunk_index int, words int, chunk string")


def batch_rows(rows: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """``batch``: rows of each key packed greedily in order into batches of at most ``most``."""
    kind = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kind[k]}" for k in keys) + f", {order} {kind[order]}, batch int"

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        batch, total, out = 0, 0, []
        for n in own[size]:
            if total and total + n > most:
                batch, total = batch + 1, 0
            total += n
            out.append(batch)
        return own.assign(batch=out)[[*keys, order, "batch"]]

    return rows.select(*keys, order, size).groupBy(*keys).applyInPandas(pack, schema)


def merge_small(chunks: DataFrame, by: str, order: list[str], size: str, text: str, least: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """Small chunks joined with the next one of the same file, in one pass of pairs: ``by, order, keep, size, text``.

    A chunk is joined if it has under ``least`` tokens and neither it nor the next is a
    table; one that was joined to the one before starts no pair. In a run of chunks each of
    which could take the next, it is every other one, so windows suffice.
    """
    w = Window.partitionBy(by).orderBy(*order)
    table = F.coalesce(F.col("is_table"), F.lit(False))
    c = chunks.withColumn("__link", F.coalesce((F.col(size) < least) & ~table & ~F.lead(table).over(w), F.lit(False)))
    c = c.withColumn("__run", F.sum((~F.coalesce(F.lag("__link").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("__next", F.lead(F.struct(size, text)).over(w)).withColumn("__at", F.row_number().over(Window.partitionBy(by, "__run").orderBy(*order)))
    c = c.filter("__at % 2 = 1")
    n = F.col("__next")
    return c.select(
        by, *order, *keep,
        F.when(F.col("__link"), F.col(size) + n[size]).otherwise(F.col(size)).cast("long").alias(size),
        F.when(F.col("__link"), F.concat_ws("\n", text, n[text])).otherwise(F.col(text)).alias(text),
    )
