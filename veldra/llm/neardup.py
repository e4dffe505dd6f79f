"""Problem 5: records that share most of their content but for small edits.

A record is the set of its distinct runs of ``RUN`` words. MinHash samples of the sets
give candidates by banding: the number of bands comes from the collision curve, so
that a pair just at the threshold is missed with a probability of ``MISS`` at most. The
same samples are folded into an odd sketch, a bitmap in which each sample flips one
bit; the count of bits in which two sketches differ estimates a high similarity
closely and removes false candidates without their texts. What is left is verified
on the sets themselves.

Records with the same set are one class from the start; classes are compared, not
copies, so a text copied very often costs one comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veldra.llm.banding import equal_pairs
from veldra.llm.components import connected_components
from veldra.llm.words import mix, run_hashes, run_starts, string_parts, word_hashes
from veldra.storage import stage

RUN = 3
LEAST_WORDS = 20
THRESHOLD = 0.60
ROWS = 5
MISS = 0.005
#: Longs of a sketch.
LONGS = 8
#: A candidate is verified if its estimate is at most so far below the threshold:
#: about four standard deviations of the estimate of a pair at the threshold.
MARGIN = 0.25
#: Sets that a task remembers, to send the signature of copies once.
SEEN = 500_000
#: Keys up to which a set of class ids is broadcast (8 bytes each).
BROADCAST_KEYS = 2_000_000

_HASH_BITS = np.uint64(52)
_HASH_MASK = np.uint64((1 << 52) - 1)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` samples for which a pair at ``threshold`` meets in none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def _sets(words: np.ndarray, firsts: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with words enough, where the set of each begins, hashes of the sets' runs)."""
    at, text = run_starts(firsts, run)
    enough = np.diff(firsts) >= max(least, run)
    at, text = at[enough[text]], text[enough[text]]
    key = (text.astype(np.uint64) << _HASH_BITS) | (run_hashes(words, run)[at] & _HASH_MASK if len(at) else np.zeros(0, np.uint64))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    text = (key >> _HASH_BITS).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(key) else np.zeros(0, np.int64)
    return text[begin], begin, key & _HASH_MASK


def _lists(values: np.ndarray, sizes: np.ndarray, kept: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes, empty where not kept."""
    ends = np.concatenate([[0], np.cumsum(np.where(kept, sizes, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values[np.repeat(kept, sizes)]))


def _signatures(run: int, least: int, bands: int, rows: int):
    a, b = _coefficients(bands * rows)
    names = ["id", "set_id", "size", *(f"s{i}" for i in range(LONGS)), "bands", "runs"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for row, _, data, offsets in string_parts(batch.column(1), 1 << 18, 4096):
                words, firsts, _, _ = word_hashes(data, offsets)
                text, begin, x = _sets(words, firsts, run, least)
                n = len(text)
                if not n:
                    continue
                size = np.diff(np.append(begin, len(x)))
                set_id = mix(np.add.reduceat(mix(x), begin) + size.astype(np.uint64))
                # A copy of a set that this task has met needs no signature again.
                known = np.fromiter((i in seen or seen.add(i) is not None for i in set_id.tolist()), bool, n)
                if len(seen) > SEEN:
                    seen.clear()
                keys = np.empty((n, bands), np.uint64)
                sketch = np.zeros((n, LONGS), np.uint64)
                each = np.arange(n)
                for band in range(bands):
                    key = np.full(n, band + 1, np.uint64)
                    for i in range(band * rows, band * rows + rows):
                        least_of = np.minimum.reduceat((x * a[i] + b[i]) >> np.uint64(24), begin)
                        sample = mix(least_of + a[i])
                        key = mix(key + sample)
                        bit = sample % np.uint64(64 * LONGS)
                        sketch[each, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
                    keys[:, band] = key
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + text)), pa.array(set_id.view(np.int64)), pa.array(size.astype(np.int32)), *(pa.array(sketch[:, i].copy().view(np.int64)) for i in range(LONGS)),
                     _lists(keys.ravel().view(np.int64), np.full(n, bands), ~known), _lists((x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), size, ~known)],
                    names,
                )

    return make


class NearDuplicates:
    """Classes of equal records and the pairs of classes at or above the threshold.

    ``members``: ``id, set_id``, one row for each record with words enough.
    ``pairs``: ``set_a, set_b, similarity`` of different classes, each pair once.

    A record is a row's id and text; rows without an id or a text, and texts of
    under ``least_words`` words, belong to no class. A row repeated as a whole counts
    once. Other columns aren't read. Sets are compared as 32-bit hashes: two runs of
    a pair of texts fall together once in about 2**32 / (runs * runs) pairs.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, run: int = RUN, least_words: int = LEAST_WORDS, rows: int = ROWS, miss: float = MISS) -> None:
        bands = bands_for(threshold, rows, miss)
        schema = "id string, set_id bigint, size int, " + ", ".join(f"s{i} bigint" for i in range(LONGS)) + ", bands array<bigint>, runs array<int>"
        rows_in = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
        made = stage(rows_in.mapInArrow(_signatures(run, least_words, bands, rows), schema), "signatures")
        self.members = made.select("id", "set_id").distinct()
        sketches = [f"s{i}" for i in range(LONGS)]
        # One exchange by band drops what is left of the copies; only bands of several classes go on, hot ones in blocks.
        meet = equal_pairs(made.select(F.explode("bands").alias("band"), "set_id"), "band", "set_id").toDF("set_a", "set_b")
        # The estimate of odd sketches: n bits, k samples, d bits that differ.
        bits, samples = 64 * LONGS, bands * rows
        most = int(bits / 2 * (1 - math.exp(-4 * samples * (1 - max(threshold - MARGIN, 0)) / bits)))
        light = made.select("set_id", "size", *sketches).dropDuplicates(["set_id"])
        for side in "ab":
            meet = meet.join(light.select(F.col("set_id").alias(f"set_{side}"), F.col("size").alias(f"size_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in sketches)), f"set_{side}")
        differ = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketches)
        sizes = F.least("size_a", "size_b") >= F.ceil(F.greatest("size_a", "size_b") * F.lit(threshold) - 1e-9)
        self.candidates = stage(meet.filter(sizes & (differ <= most)).select("set_a", "set_b"), "candidates")
        ids = self.candidates.select(F.col("set_a").alias("set_id")).unionByName(self.candidates.select(F.col("set_b").alias("set_id"))).distinct()
        if self.candidates.count() * 2 <= BROADCAST_KEYS:
            ids = F.broadcast(ids)
        runs = made.select("set_id", "runs").filter(F.size("runs") > 0).join(ids, "set_id", "left_semi").dropDuplicates(["set_id"])
        both = self.candidates
        for side in "ab":
            both = both.join(runs.select(F.col("set_id").alias(f"set_{side}"), F.col("runs").alias(f"runs_{side}")), f"set_{side}")
        shared = F.size(F.array_intersect("runs_a", "runs_b"))
        both = both.select("set_a", "set_b", shared.alias("shared"), (F.size("runs_a") + F.size("runs_b") - shared).alias("either"))
        self.pairs = stage(both.select("set_a", "set_b", (F.col("shared") / F.col("either")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12), "pairs")

    def record_pairs(self) -> DataFrame:
        """``a, b, similarity`` of records, smaller id first: pairs of equal records too, each once."""
        left, right = self.members.toDF("a", "set_a"), self.members.toDF("b", "set_b")
        apart = self.pairs.join(left, "set_a").join(right, "set_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
        equal = left.join(right, F.expr("set_a = set_b and a < b")).select("a", "b", F.lit(1.0).alias("similarity"))
        # Of rows with one id and different texts, the highest similarity counts.
        return apart.filter("a <> b").unionByName(equal).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    def groups(self) -> DataFrame:
        """One row for each record: ``id, class_size, links, group_id``.

        class_size: records of the same set; links: other classes at or above the
        threshold; group_id: the least class id that links lead to.
        """
        degree = self.pairs.select(F.col("set_a").alias("set_id")).unionByName(self.pairs.select(F.col("set_b").alias("set_id"))).groupBy("set_id").agg(F.count("*").alias("links"))
        parts = connected_components(self.pairs.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))).toDF("set_id", "group_id")
        classes = self.members.groupBy("set_id").agg(F.count("*").alias("class_size")).join(degree, "set_id", "left").join(parts, "set_id", "left")
        return self.members.join(classes, "set_id").select("id", "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("group_id", "set_id").alias("group_id"))
