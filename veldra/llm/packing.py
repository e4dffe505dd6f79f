"""Problem 7: documents into context windows of fixed capacity, mixed by source.

Sizes are counts of tokens of a public tokenizer (a parameter; its file is read by
each Python worker). A text larger than a window is cut into whole windows and a rest;
no other text is ever split.

The windows follow target proportions of tokens by source. Documents are spread over
packing tasks by hash, so no source, however large, falls to one task. In a task the
sources are queues of deficit round-robin: each window grants each source its share
of the window; the source with the greatest deficit that has an item which still
fits gives its largest such item and pays its size. Deficits are carried from window
to window. They are carried from task to task as well: what the sources of earlier
tasks got above or below their shares is known from the sums of sizes by task and source
before anything is packed, and is where a task's deficits begin.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from veldra.storage import stage

CAPACITY = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of a packing task: some 2,000 windows, so that unfilled last windows weigh nothing.
TASK_TOKENS = 2_000_000
#: Tasks whose deficits are added up in one window.
TASKS_A_BLOCK = 1_000
#: The split of texts into pieces that belongs to the vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str):
    """The tokenizer whose ranks the file holds; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean_source(column: str = "source"):
    """A source without case and outer blanks; null and blank are ``unknown``."""
    plain = F.regexp_replace(F.lower(F.col(column)), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(plain != "", plain).otherwise(F.lit("unknown"))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens BIGINT, text_hash BIGINT`` of all rows with an id; null texts have 0 tokens."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), clean_source(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [_count(encode, t) for t in batch["text"]], "text_hash": batch["text_hash"]})

    return rows.mapInPandas(count, f"doc_id {kind}, source string, tokens bigint, text_hash bigint")


def _count(encode, text: str, most: int = 100_000) -> int:
    """Tokens of a text; a very long one is cut before a space that follows a letter, where pieces part anyway."""
    n = 0
    while len(text) > most:
        at = most
        while at < len(text) and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at += 1
        n += len(encode(text[:at]))
        text = text[at:]
    return n + len(encode(text))


def pack_task(items: list[tuple], shares: dict[str, float], deficits: dict[str, float], capacity: int = CAPACITY) -> Iterator[tuple[int, tuple]]:
    """(window number from 0, item) of all items ``(source, size, ...)``, none over the capacity.

    Deficit round-robin over the sources' queues; the item given is the largest that
    fits. A window is closed when no queue has an item that fits.
    """
    queues: dict[str, list[tuple]] = {}
    for item in sorted(items, key=lambda x: (x[1], x[2:])):
        queues.setdefault(item[0], []).append(item)
    sizes = {s: [i[1] for i in q] for s, q in queues.items()}
    owed = {s: deficits.get(s, 0.0) for s in queues}
    window = 0
    while queues:
        for s in queues:
            owed[s] += shares.get(s, 0.0) * capacity
        room = capacity
        order = [(-d, s) for s, d in owed.items() if s in queues]
        heapq.heapify(order)
        while order and room:
            _, s = heapq.heappop(order)
            at = bisect.bisect_right(sizes[s], room) - 1
            if at < 0:
                continue  # nothing of it fits this window any more: room only shrinks
            item = queues[s].pop(at)
            sizes[s].pop(at)
            room -= item[1]
            owed[s] -= item[1]
            yield window, item
            if queues[s]:
                heapq.heappush(order, (-owed[s], s))
            else:
                del queues[s], sizes[s]
        window += 1


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, shares: dict[str, float] | None = None, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Every text's place: ``doc_id, part INT, source, window_id STRING, position INT, first_token BIGINT, tokens INT``.

    part from 1 for each text, more than one only over the capacity; position is the
    place in the window, from 1. ``shares`` are the target proportions by clean source;
    by default each source's part of all tokens. Everything is packed in any case:
    targets the supply can't keep bend towards the end of a task.

    Rows repeated as a whole count once. Texts without a token (null, empty) need no
    room and give no rows, nor do rows without an id. Other columns aren't read. An
    empty table gives an empty result.
    """
    kind = dict(df.dtypes)[id_col]
    counted = token_counts(df, id_col, text_col, source_col, tokenizer)
    counted = stage(counted.filter("tokens > 0").distinct(), "tokens")
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    tasks = max(1, round(total / task_tokens))
    counted = counted.withColumn("task", F.pmod(F.xxhash64("doc_id", "source", "tokens", "text_hash"), F.lit(tasks)).cast("int"))
    # Sources by task: what each task holds, and the deficits with which it begins.
    held = counted.groupBy("task", "source").agg(F.sum("tokens").alias("held"))
    by_source = held.groupBy("source").agg(F.sum("held").alias("all"))
    if shares is None:
        by_source = by_source.withColumn("share", F.col("all") / F.lit(max(total, 1)))
    else:
        wanted = df.sparkSession.createDataFrame([(s, float(w)) for s, w in shares.items()], "source string, share double")
        by_source = by_source.join(wanted, "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    granted = held.groupBy("task").agg(F.sum("held").alias("task_held"))
    # Sums over earlier tasks in two steps, of blocks of tasks and inside them, so that no window holds all tasks of a source.
    joined = held.join(granted, "task").join(by_source, "source").withColumn("__b", F.floor(F.col("task") / TASKS_A_BLOCK)).withColumn("__owed", F.col("share") * F.col("task_held") - F.col("held"))
    inside = Window.partitionBy("source", "__b").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = joined.groupBy("source", "__b").agg(F.sum("__owed").alias("__sum")).withColumn("__past", F.coalesce(F.sum("__sum").over(between), F.lit(0.0))).drop("__sum")
    past = F.col("__past") + F.coalesce(F.sum("__owed").over(inside), F.lit(0.0))
    # Staged: as a table of its own it is no second reading of the sizes to the planner.
    carried = stage(joined.join(blocks, ["source", "__b"]).select("task", "source", "share", past.alias("carried")), "carried")
    # Whole windows of large texts, then the rests, which are items like others.
    parts = F.ceil(F.col("tokens") / capacity).cast("int")
    pieces = counted.select("task", "doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    pieces = pieces.select("task", "doc_id", "source", "part", ((F.col("part") - 1) * F.lit(capacity).cast("long")).alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - (F.col("part") - 1) * capacity).cast("int").alias("size"))

    def place(key: tuple, items: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        share = dict(zip(begin["source"], begin["share"]))
        carried = dict(zip(begin["source"], begin["carried"]))
        rows = list(zip(items["source"], items["size"].tolist(), items["doc_id"].tolist(), items["part"].tolist(), items["first_token"].tolist()))
        out, last, position = [], -1, 0
        for window, (s, size, doc, part, first) in pack_task(rows, share, carried, capacity):
            position = position + 1 if window == last else 1
            last = window
            out.append((doc, part, s, f"{key[0]}-{window}", position, first, size))
        return pd.DataFrame(out, columns=["doc_id", "part", "source", "window_id", "position", "first_token", "tokens"])

    return pieces.groupBy("task").cogroup(carried.groupBy("task")).applyInPandas(place, f"doc_id {kind}, part int, source string, window_id string, position int, first_token bigint, tokens int")


def window_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``windows, items, tokens, fill``; fill is the part of all room that is used."""
    windows = packed.groupBy("window_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = windows.agg(F.count("*").alias("windows"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return total.withColumn("fill", F.col("tokens") / F.greatest(F.col("windows") * F.lit(capacity), F.lit(1)))


def window_mixture(packed: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``window_id, tokens, distance, drift``: how far each window is from the target proportions.

    distance: half the sum of the differences between a window's shares and the targets, 0 to
    1; drift: the same of all windows of its task together, which carried deficits keep small.
    Targets are ``shares``, scaled to 1, or by default each source's part of all tokens.
    """
    if shares is None:
        total = packed.agg(F.sum("tokens").alias("all"))
        target = packed.groupBy("source").agg(F.sum("tokens").alias("s")).crossJoin(F.broadcast(total)).select("source", (F.col("s") / F.col("all")).alias("share"))  # one row
    else:
        whole = sum(shares.values()) or 1.0
        target = packed.sparkSession.createDataFrame([(s, float(w) / whole) for s, w in shares.items()], "source string, share double")
    by = packed.groupBy("window_id", F.split_part("window_id", F.lit("-"), F.lit(1)).alias("task"), "source").agg(F.sum("tokens").alias("t"))

    def away(of: str, name: str) -> DataFrame:
        """How far the tokens of each ``of`` are from the targets; a source that isn't there differs by its whole target."""
        own = by.groupBy(of, "source").agg(F.sum("t").alias("t"))
        own = own.join(own.groupBy(of).agg(F.sum("t").alias("tokens")), of).join(target, "source", "left").fillna(0.0, ["share"])
        off = (F.sum(F.abs(F.col("t") / F.col("tokens") - F.col("share"))) + 1 - F.sum("share")) / 2
        return own.groupBy(of).agg(F.max("tokens").alias("tokens"), F.round(off, 6).alias(name))

    windows = away("window_id", "distance").join(by.select("window_id", "task").distinct(), "window_id")
    return windows.join(away("task", "drift").drop("tokens"), "task").select("window_id", "tokens", "distance", "drift")
