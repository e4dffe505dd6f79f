"""Problem 8: passages of evaluation items inside training documents.

A BM25 inverted index holds the test items; every passage of every document is a
query against it, answered by block-max WAND:

* A passage is 24 words, one beginning at each 12th word, so each run of 12 words
  lies whole in some passage.
* The threshold of an item is the least BM25 score that any 12 consecutive words of
  it give. Impacts are divided by it, so every item's threshold is 1 and no passage
  that holds 12 words of an item can score below.
* As WAND does, a passage is left out when the greatest impacts of its words add up
  to less than 1; postings are cut into blocks of 2 items and only the blocks whose
  own block maxima reach 1 are scored. Instead of one pivot at a time, all passages
  of a batch move together, as arrays.
* What is retrieved is verified: the passage and the item share a run of 12 words.

The items are a stated query set. They are indexed in blocks of ``ITEMS_PER_PASS``, of which
``INDEXES_PER_SCAN`` are sent to the executors at once; more items take more scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veldra.llm.words import mix, run_hashes, run_starts, string_parts, word_hashes

RUN = 12
PASSAGE = 24
BLOCK = 2
K1, B = 1.2, 0.75
#: Items of an index, and indexes sent to the tasks with one scan of the texts.
ITEMS_PER_PASS, INDEXES_PER_SCAN = 1_000, 5
#: Passages times blocks of items scored at once in a task.
_CELLS = 200_000


class ItemIndex:
    """BM25 postings of test items with maxima by term and by block of items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        col = pa.array(texts, pa.large_string())
        hashes, lengths = [], []
        for _, _, data, offsets in string_parts(col):
            h, firsts, _, _ = word_hashes(data, offsets)
            hashes.append(h)
            lengths.append(np.diff(firsts))
        words, length = np.concatenate(hashes), np.concatenate(lengths)
        keep = length >= RUN
        words, self.ids, length = words[np.repeat(keep, length)], np.asarray(ids, np.int64)[keep], length[keep]
        firsts = np.concatenate([[0], np.cumsum(length)])
        n = len(self.ids)
        self.n = n
        self.vocabulary, term = np.unique(words, return_inverse=True)
        v = len(self.vocabulary)
        item = np.repeat(np.arange(n), length)
        pair, tf = np.unique(term * max(n, 1) + item, return_counts=True)
        p_term, p_item = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(p_term, minlength=v)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 1, 1e-9))
        impact = idf[p_term] * tf * (K1 + 1) / (tf + norm[p_item])
        # The least score of 12 words in a row: terms said twice in them count once.
        at, of = run_starts(firsts, RUN)
        least = np.full(n, np.inf)
        of_pair = np.searchsorted(pair, term * max(n, 1) + item)
        for lo in range(0, len(at), 100_000):
            cols = of_pair[at[lo : lo + 100_000, None] + np.arange(RUN)]
            cols.sort(axis=1)
            score = impact[cols]
            score[:, 1:][cols[:, 1:] == cols[:, :-1]] = 0
            np.minimum.at(least, of[lo : lo + 100_000], score.sum(axis=1))
        self.impact = impact / least[p_item] * (1 + 1e-9)
        self.p_item, self.p_from = p_item, np.searchsorted(p_term, np.arange(v + 1))
        self.term_max = np.zeros(v + 1)  # the last, at -1, is for words of no item
        np.maximum.at(self.term_max, p_term, self.impact)
        blocks = n // BLOCK + 1
        b_pair, b_of = np.unique(p_term * blocks + p_item // BLOCK, return_inverse=True)
        self.b_best = np.zeros((v + 1, blocks), np.float32)
        np.maximum.at(self.b_best, (p_term, p_item // BLOCK), self.impact)
        self.b_begin = np.concatenate([[0], np.cumsum(np.bincount(b_of, minlength=len(b_pair)))])
        self.b_block, self.b_from = b_pair % blocks, np.searchsorted(b_pair // blocks, np.arange(v + 1))
        self.blocks = blocks
        key = mix(run_hashes(words, RUN)[at] ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        self.item_runs, first = np.unique(key[order], return_index=True)
        # Where each run stands in its item.
        self.run_places, self.run_from = at[order], np.append(first, len(order))

    @staticmethod
    def _expand(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ranges begin..end: (row of each element, element)."""
        count = end - begin
        first = np.cumsum(count) - count
        return np.repeat(rows, count), np.repeat(begin - first, count) + np.arange(count.sum())

    def search(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage begin, item, score) of all passages that score 1 or more; firsts: where texts begin in words."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not self.n or not len(words):
            return none
        term = np.searchsorted(self.vocabulary, words)
        term[term == len(self.vocabulary)] = 0
        term[self.vocabulary[term] != words] = -1
        # Passages begin at each 12th word of a text, as long as 12 words are left.
        length = np.diff(firsts)
        count = np.where(length >= RUN, np.maximum(1, -(-(length - RUN) // RUN)), 0)
        text = np.repeat(np.arange(len(length)), count)
        begin = firsts[:-1][text] + RUN * (np.arange(count.sum()) - (np.cumsum(count) - count)[text])
        end = np.minimum(begin + PASSAGE, firsts[1:][text])
        bound = np.concatenate([[0.0], np.cumsum(self.term_max[term])])
        # Some run of 12 words in the passage has to be able to reach the threshold.
        at, _ = run_starts(firsts, RUN)
        reach = np.zeros(len(words) + 1, np.int64)
        reach[at + 1] = bound[at + RUN] - bound[at] >= 1 - 1e-6
        np.cumsum(reach, out=reach)
        last = np.minimum(begin + RUN + 1, end - RUN + 1)
        alive = reach[last] > reach[begin]
        begin, end = begin[alive], end[alive]
        out = []
        step = max(256, _CELLS // self.blocks)
        for lo in range(0, len(begin), step):
            b, e = begin[lo : lo + step], end[lo : lo + step]
            # The passage's words, each once; -1 where there is none.
            at = b[:, None] + np.arange(PASSAGE)
            t = np.where(at < e[:, None], term[np.minimum(at, len(term) - 1)], -1)
            t.sort(axis=1)
            t[:, 1:][t[:, 1:] == t[:, :-1]] = -1
            keep = self.term_max[t].sum(axis=1) >= 1 - 1e-6  # the term -1 has impact 0
            b, t = b[keep], t[keep]
            best = np.zeros((len(b), self.blocks), np.float32)
            for j in range(PASSAGE):
                best += self.b_best[t[:, j]]
            alive = (best >= 1 - 1e-5).ravel()
            # Score the items of the blocks that are left.
            key = np.flatnonzero(alive)
            left = np.zeros(len(b), bool)
            left[key // self.blocks] = True
            row, col = np.nonzero((t >= 0) & left[:, None])
            t = t[row, col]
            r, at = self._expand(row, self.b_from[t], self.b_from[t + 1])
            of = r * self.blocks + self.b_block[at]
            wanted = alive[of]
            place = np.cumsum(alive) - 1
            r, at = self._expand(place[of[wanted]], self.b_begin[at[wanted]], self.b_begin[at[wanted] + 1])
            score = np.bincount(r * BLOCK + self.p_item[at] % BLOCK, self.impact[at], len(key) * BLOCK)
            good = np.flatnonzero(score >= 1 - 1e-6)
            block = key[good // BLOCK]
            out.append((b[block // self.blocks], block % self.blocks * BLOCK + good % BLOCK, score[good]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else none

    def _longest(self, places: np.ndarray, runs: np.ndarray) -> int:
        """Words of the longest stretch shared with an item, from where its shared runs are in the text, in order, and which they are."""
        best, before, last = 0, {}, -2
        for at, r in zip(places.tolist(), runs.tolist()):
            if at == last:
                continue
            here = self.run_places[self.run_from[r] : self.run_from[r + 1]].tolist()
            before = {p: (before.get(p - 1, 0) if at == last + 1 else 0) + 1 for p in here}
            best, last = max(best, *before.values()), at
        return best + RUN - 1 if best else 0

    def leaks(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, runs of 12 shared, best score, words of the longest shared stretch), one for each text and item that share a run."""
        begin, item, score = self.search(words, firsts)
        runs = run_hashes(words, RUN)
        text = np.searchsorted(firsts, begin, "right") - 1
        # The runs that begin in the passage and end in the text. The next passage repeats the last one,
        # begun at begin + RUN; where it would be the text's last there is no next passage.
        stop = firsts[1:][text]
        end = np.minimum(begin + RUN + (begin + PASSAGE == stop), stop - RUN + 1)
        r, at = self._expand(np.arange(len(begin)), begin, np.maximum(end, begin))
        key = mix(runs[at] ^ (item[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        pos = np.searchsorted(self.item_runs, key)
        pos[pos == len(self.item_runs)] = 0
        found = self.item_runs[pos] == key if len(key) else np.zeros(0, bool)
        hits = np.bincount(r[found], minlength=len(begin)) if len(key) else np.zeros(len(begin), np.int64)
        good = hits > 0
        width = max(self.n, 1)
        pair, of = np.unique(text[good] * width + item[good], return_inverse=True)
        best = np.zeros(len(pair))
        np.maximum.at(best, of, score[good])
        owner, place, run = text[r[found]] * width + item[r[found]], at[found], pos[found]
        order = np.lexsort((place, owner))
        owner, place, run = owner[order], place[order], run[order]
        cuts = np.searchsorted(owner, pair, "left"), np.searchsorted(owner, pair, "right")
        longest = np.array([self._longest(place[lo:hi], run[lo:hi]) for lo, hi in zip(*cuts)], np.int64)
        return pair // width, pair % width, np.bincount(of, hits[good], len(pair)).astype(np.int64), best, longest


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[ItemIndex]:
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null").distinct()
    n = rows.count()
    passes = -(-n // ITEMS_PER_PASS)
    for k in range(passes):
        own = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        got = own.orderBy("i", "t").toPandas()
        if len(got):
            yield ItemIndex(got["i"].tolist(), got["t"].tolist())
    del spark


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents and the items of which they hold at least 12 consecutive words.

    Gives ``doc_id BIGINT, item_id BIGINT, shared_runs BIGINT, score DOUBLE, longest BIGINT``: how
    many runs of 12 words are shared, the best passage's BM25 score over the item's
    threshold, and how many words in a row are shared at most. One row for each document and item; repeated rows count once.

    Null or empty texts, and items of under 12 words, give no rows; so do rows
    without a key. Other columns are not read. Empty tables give an empty result.
    Work and memory of a task follow its rows; nothing is shuffled but the result.
    """
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    corpus = docs.select(key.cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    schema = "doc_id bigint, item_id bigint, shared_runs bigint, score double, longest bigint"
    out = None
    blocks = _item_blocks(items, item_id, item_text)
    while indexes := list(islice(blocks, INDEXES_PER_SCAN)):

        def search(batches: Iterator[pa.RecordBatch], indexes: list[ItemIndex] = indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for row, _, data, offsets in string_parts(batch.column(1)):
                    words, firsts, _, _ = word_hashes(data, offsets)
                    for index in indexes:
                        doc, item, shared, score, longest = index.leaks(words, firsts)
                        if len(doc):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row + doc], index.ids[item], shared, score, longest)], ["doc_id", "item_id", "shared_runs", "score", "longest"])

        found = corpus.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("shared_runs").alias("shared_runs"), F.max("score").alias("score"), F.max("longest").alias("longest"))


def leak_report(leaks: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """For every item: in how many documents it leaked and its longest share.

    ``item_id, documents, most_shared_words``, the most words in a row that a document shares
    with the item. Items that did not leak have 0 in both.
    """
    own = items.select(F.col(item_id).cast("long").alias("item_id")).filter("item_id is not null").distinct()
    per = leaks.groupBy("item_id").agg(F.count("*").alias("n"), F.max("longest").alias("w"))
    return own.join(per, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("documents"), F.coalesce("w", F.lit(0)).cast("long").alias("most_shared_words"))
