"""Boxes on a page: overlap, suppression and reading order.

A page's boxes are gathered into one row (a page holds few), and rows go to Python in
batches: a call for each batch, not for each page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

_FIELDS = ("idx", "x1", "y1", "x2", "y2", "conf")


def _by_page(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page_no").agg(F.collect_list(F.struct(*_FIELDS)).alias("boxes"))


def suppress(boxes: DataFrame, most: float = 0.7) -> DataFrame:
    """``page_no, idx`` of boxes that overlap no surer box of their page by more than ``most`` (area shared over area of both)."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, own in zip(batch["page_no"], batch["boxes"]):
                kept: list = []
                for b in sorted(own, key=lambda b: (-b["conf"], b["idx"])):
                    for k in kept:
                        w, h = min(b["x2"], k["x2"]) - max(b["x1"], k["x1"]), min(b["y2"], k["y2"]) - max(b["y1"], k["y1"])
                        shared = max(0.0, w) * max(0.0, h)
                        both = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) + (k["x2"] - k["x1"]) * (k["y2"] - k["y1"]) - shared
                        if both > 0 and shared / both > most:
                            break
                    else:
                        kept.append(b)
                out += [(page, k["idx"]) for k in kept]
            yield pd.DataFrame(out, columns=["page_no", "idx"])

    return _by_page(boxes).mapInPandas(keep, "page_no int, idx int")


def reading_order(boxes: DataFrame, overlap: float = 0.4) -> DataFrame:
    """``page_no, idx, place``: boxes overlapping in height by over ``overlap`` of the lower one make a row; rows go down, boxes right."""

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, own in zip(batch["page_no"], batch["boxes"]):
                rows: list[list] = []
                for b in sorted(own, key=lambda b: (b["y1"], b["x1"], b["idx"])):
                    for row in rows:
                        shared = min(b["y2"], row[0]["y2"]) - max(b["y1"], row[0]["y1"])
                        if shared > overlap * max(1e-9, min(b["y2"] - b["y1"], row[0]["y2"] - row[0]["y1"])):
                            row.append(b)
                            break
                    else:
                        rows.append([b])
                flat = [b for row in rows for b in sorted(row, key=lambda b: (b["x1"], b["idx"]))]
                out += [(page, b["idx"], i) for i, b in enumerate(flat, 1)]
            yield pd.DataFrame(out, columns=["page_no", "idx", "place"])

    return _by_page(boxes).mapInPandas(order, "page_no int, idx int, place int")


def _share(low: str, high: str) -> Column:
    """Part of the length of both boxes together that they share along one axis."""
    shared = F.greatest(F.lit(0.0), F.least(f"a.{high}", f"b.{high}") - F.greatest(f"a.{low}", f"b.{low}"))
    whole = F.greatest(f"a.{high}", f"b.{high}") - F.least(f"a.{low}", f"b.{low}")
    return F.when(whole > 0, shared / whole).otherwise(0.0)


def overlapping(boxes: DataFrame, axis: str = "y", over: float = 0.85) -> DataFrame:
    """``page_no, a, b, share``: pairs of boxes of a page that share over ``over`` of their length along an axis."""
    a, b = boxes.alias("a"), boxes.alias("b")
    share = _share(f"{axis}1", f"{axis}2")
    return a.join(b, F.expr(f"a.page_no = b.page_no and a.idx < b.idx and a.{axis}1 < b.{axis}2 and b.{axis}1 < a.{axis}2")).select(F.col("a.page_no").alias("page_no"), F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), share.alias("share")).filter(F.col("share") > over)


def _dedup(boxes: DataFrame, better, low: str, high: str, over: float) -> DataFrame:
    fields = ("idx", low, high, "header", "conf")
    pages = boxes.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("boxes"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, own in zip(batch["page_no"], batch["boxes"]):
                kept: list = []
                for b in own:
                    for i, k in enumerate(kept):
                        shared = max(0.0, min(b[high], k[high]) - max(b[low], k[low]))
                        whole = max(b[high], k[high]) - min(b[low], k[low])
                        if whole > 0 and shared / whole > over:
                            if better(b, k):
                                kept[i] = b
                            break
                    else:
                        kept.append(b)
                out += [(page, k["idx"]) for k in kept]
            yield pd.DataFrame(out, columns=["page_no", "idx"])

    return pages.mapInPandas(keep, "page_no int, idx int")


def dedup_rows(boxes: DataFrame, over: float = 0.85) -> DataFrame:
    """``page_no, idx`` of a table's row boxes, one of those at one height: a header before others, then the surer one."""
    return _dedup(boxes, lambda b, k: (b["header"] and not k["header"]) or (b["conf"] > k["conf"] and b["header"] == k["header"]), "y1", "y2", over)


def dedup_columns(boxes: DataFrame, over: float = 0.85) -> DataFrame:
    """``page_no, idx`` of a table's column boxes, the widest of those at one place."""
    wide = boxes.withColumn("header", F.lit(False)) if "header" not in boxes.columns else boxes
    return _dedup(wide, lambda b, k: b["x2"] - b["x1"] > k["x2"] - k["x1"], "x1", "x2", over)


#: Points by which cells are shrunk, and the greatest squared distance to a nearest cell: fixed values.
CELL_MARGIN, NEAREST = max(1.5, 3.0 * 72.0 / 150.0), 2500.0


def cells_of(rows: DataFrame, columns: DataFrame, margin: float = CELL_MARGIN) -> DataFrame:
    """``page_no, row_no, col_no, x1, y1, x2, y2``: the grid of a page's rows and columns, shrunk by the margin where there is room."""
    w = Window.partitionBy("page_no")
    r = rows.withColumn("row_no", F.row_number().over(w.orderBy("y1", "idx")).cast("int")).select("page_no", "row_no", "y1", "y2")
    c = columns.withColumn("col_no", F.row_number().over(w.orderBy("x1", "idx")).cast("int")).select("page_no", "col_no", "x1", "x2")
    roomy_y, roomy_x = F.col("y1") + margin < F.col("y2") - margin, F.col("x1") + margin < F.col("x2") - margin
    return r.join(c, "page_no").select(
        "page_no", "row_no", "col_no", F.when(roomy_x, F.col("x1") + margin).otherwise(F.col("x1")).alias("x1"), F.when(roomy_y, F.col("y1") + margin).otherwise(F.col("y1")).alias("y1"),
        F.when(roomy_x, F.col("x2") - margin).otherwise(F.col("x2")).alias("x2"), F.when(roomy_y, F.col("y2") - margin).otherwise(F.col("y2")).alias("y2"),
    )


def assign_spans(spans: DataFrame, cells: DataFrame, most: float = NEAREST) -> DataFrame:
    """``page_no, span, row_no, col_no``: the first cell (by row, then column) that holds a span's middle, else the nearest within ``most`` squared points.

    ``spans``: page_no, idx, x1, y1, x2, y2. Spans farther from every cell are left out.
    """
    s = spans.select("page_no", F.col("idx").alias("span"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    away = F.pow(F.col("cx") - (F.col("x1") + F.col("x2")) / 2, 2) + F.pow(F.col("cy") - (F.col("y1") + F.col("y2")) / 2, 2)
    met = s.join(cells, "page_no").withColumn("out", (~inside).cast("int")).withColumn("away", F.when(inside, 0.0).otherwise(away)).filter(F.col("away") <= most)
    best = met.groupBy("page_no", "span").agg(F.min(F.struct("out", "away", "row_no", "col_no")).alias("b"))
    return best.select("page_no", "span", F.col("b.row_no").alias("row_no"), F.col("b.col_no").alias("col_no"))


def cell_texts(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """``page_no, row_no, col_no, text``: texts of a cell's spans from top to bottom, left to right."""
    s = spans.select("page_no", F.col("idx").alias("span"), F.struct(((F.col("y1") + F.col("y2")) / 2).alias("y"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), F.trim("text").alias("t")).alias("s")).filter("s.t <> ''")
    lines = F.array_sort(F.collect_list("s"))
    return s.join(placed, ["page_no", "span"]).groupBy("page_no", "row_no", "col_no").agg(F.array_join(F.transform(lines, lambda x: x["t"]), " ").alias("text"))


def element_counts(boxes: DataFrame) -> DataFrame:
    """``page_no, label, n``: boxes of each kind but for abandoned ones."""
    return boxes.withColumn("label", F.lower("label")).filter("label <> 'abandon'").groupBy("page_no", "label").agg(F.count("*").alias("n"))


#: Elements from which a page is too complex: fixed values.
COMPLEX_TEXT, COMPLEX_ALL = 60, 80


def route_pages(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``pages`` with ``route``: complex, blank, scanned or text, and the ``warning`` of those that are left out.

    ``pages``: page_no, text, images; ``counts``: page_no, label, n.
    """
    texts = F.sum(F.when(F.col("label").isin("plain text", "title"), F.col("n")).otherwise(0))
    n = counts.groupBy("page_no").agg(F.sum("n").alias("elements"), texts.alias("texts"))
    p = pages.join(n, "page_no", "left").fillna(0, ["elements", "texts"])
    words, marks = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != "", (F.coalesce("images", F.lit(0)) > 0) | (F.col("elements") > 0)
    route = F.when((F.col("texts") >= COMPLEX_TEXT) | (F.col("elements") >= COMPLEX_ALL), "complex").when(~words & ~marks, "blank").when(~words, "scanned").otherwise("text")
    name = F.concat(F.lit("Page "), F.col("page_no").cast("string"))
    warning = F.when(F.col("route") == "complex", F.concat(name, F.lit(": complex layout, skipped"))).when(F.col("route") == "scanned", F.concat(name, F.lit(": scanned, no text layer")))
    return p.withColumn("route", route).withColumn("warning", warning)


def dedup_texts(blocks: DataFrame, by: list[str], order: str, text: str, least: int = 100, ratio: float = 0.95) -> DataFrame:
    """Blocks of a page but for repeated texts: equal ones but for white space, and those of ``least`` characters and more that hold or lie in an earlier kept one, the shorter over ``ratio`` of the longer."""
    kind = dict(blocks.dtypes)
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "\u00a0", " "))
    b = blocks.withColumn("__h", F.md5(F.regexp_replace(low, r"\s+", ""))).withColumn("__t", F.trim(F.regexp_replace(low, r"\s+", " ")))
    first = b.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__h").orderBy(order))).filter("__n = 1").drop("__n", "__h")

    def greedy(own: pd.DataFrame) -> pd.DataFrame:
        kept, gone = [], []
        for r in own.sort_values(order).to_dict("records"):
            t = r["__t"]
            if any(min(len(t), len(k)) / max(len(t), len(k)) > ratio and (t in k or k in t) for k in kept):
                gone.append({**{c: r[c] for c in by}, order: r[order]})
            else:
                kept.append(t)
        return pd.DataFrame(gone, columns=[*by, order])

    long = first.filter(F.length("__t") >= least).select(*by, order, "__t")
    gone = long.groupBy(*by).applyInPandas(greedy, ", ".join(f"{k} {kind[k]}" for k in [*by, order]))
    return first.join(gone, [*by, order], "left_anti").drop("__t")
