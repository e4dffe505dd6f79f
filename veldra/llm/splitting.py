"""Problem 6: cutting items over a size limit at natural boundaries.

Words are runs of characters that aren't white space. The gap before each word has a
strength: the end of a paragraph is stronger than that of a line, a sentence, a clause,
or none. A piece ends in the strongest gap of its permissible window (a tie goes to the
rightmost), found in a sparse table of range maxima, so each cut costs constant time.
The next piece steps back by the overlap, to the strongest gap inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

LIMIT = 650
OVERLAP = 100
#: A piece ends no earlier than at this part of the limit, unless the text does.
SHORTEST = 0.5

#: Strengths of a gap, strongest first; what the text before (or the white space in) it looks like.
PARAGRAPH, TABLE_OR_HEADING, LINE, SENTENCE, CLAUSE, NONE = 5, 4, 3, 2, 1, 0
_WORD = regex.compile(r"\S+")
_SENTENCE = regex.compile(r"[.!?।॥…][\"'”’)\]]*$")
_CLAUSE = regex.compile(r"[,;:—–][\"'”’)\]]*$")
#: A full stop after these ends no sentence.
_ABBREVIATIONS = frozenset("no. rs. mr. mrs. ms. dr. shri. smt. sec. vs. v. st. fig. art. cl. pvt. ltd. co. dept. govt. e.g. i.e. etc.".split())


class SparseTable:
    """Places of the rightmost maximum in any range of ``values``."""

    def __init__(self, values: np.ndarray) -> None:
        # The place breaks ties, so the rightmost of equal strengths is the greatest.
        key = values.astype(np.int64) * (len(values) + 1) + np.arange(len(values))
        self.size, self.levels = len(values) + 1, [key]
        width = 1
        while 2 * width <= len(key):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[: len(low) - width], low[width:]))
            width *= 2

    def best(self, low: int, high: int) -> int:
        """The place of the greatest value in low..high, both included."""
        level = (high - low + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[low], row[high + 1 - (1 << level)]) % self.size)


def gaps(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where words begin, where they end, strength of the gap after each word; that after the last is a paragraph's)."""
    found = [m.span() for m in _WORD.finditer(text)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    begin, end = np.array(found).T
    strength = np.zeros(len(found), np.int64)
    strength[-1] = PARAGRAPH
    for i in range(len(found) - 1):
        between = text[end[i] : begin[i + 1]]
        breaks = between.count("\n") or between.count("\r")
        word = text[begin[i] : end[i]]
        if breaks > 1 or "\u2029" in between or "\f" in between:
            strength[i] = PARAGRAPH
        elif breaks and text[begin[i + 1] : begin[i + 1] + 1] in "#|-*•":
            strength[i] = TABLE_OR_HEADING
        elif _SENTENCE.search(word) and word.lower() not in _ABBREVIATIONS:
            strength[i] = SENTENCE if not breaks else LINE
        elif breaks:
            strength[i] = LINE if word.endswith("|") else CLAUSE
        elif _CLAUSE.search(word):
            strength[i] = CLAUSE
    return begin, end, strength


def cuts(strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, shortest: float = SHORTEST) -> list[tuple[int, int]]:
    """Pieces as (first word, one past the last) of a text with these gap strengths."""
    n = len(strength)
    if n <= limit:
        return [(0, n)] if n else []
    table, out, at = SparseTable(strength), [], 0
    least = max(overlap + 1, int(limit * shortest))
    while True:
        if n - at <= limit:
            out.append((at, n))
            return out
        last = table.best(at + least - 1, at + limit - 1)
        out.append((at, last + 1))
        # The next piece begins after the strongest gap of the last ``overlap`` words; of equals the earliest repeats most.
        low, high = last + 1 - overlap, last
        if overlap:
            strongest = strength[table.best(low - 1, high - 1)] if high > low else 0
            window = strength[low - 1 : high]
            at = low + int(np.argmax(window == strongest)) if strongest and high > low else low
        else:
            at = last + 1


def split_items(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = (), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items that really have over ``limit`` words.

    ``<id_col>, piece_no INT, first_word INT, words INT, repeated INT, boundary INT, piece
    STRING`` and the columns ``keep``; piece_no from 1, first_word from 0. A piece has at
    most ``limit`` words, begins with the last ``repeated`` (at most ``overlap``, at least
    1) words of the one before and is cut from the text as it stands; boundary is the
    strength of the gap it ends in (0: no natural one in the window). Sizes stored with
    the rows aren't trusted. Items of ``limit`` words or fewer, and null texts, give no
    rows. Rows repeated as a whole count once; rows that share an id and differ are cut
    each. Empty tables give an empty result.
    """
    assert 0 <= overlap < limit * SHORTEST
    cols = [id_col, *keep]
    kinds = dict(df.dtypes)
    # A text of more words than the limit has more than twice as many characters; no shorter one goes to Python.
    rows = df.filter(F.length(text_col) > 2 * limit).select(*cols, F.col(text_col).alias("__text")).distinct()
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", piece_no int, first_word int, words int, repeated int, boundary int, piece string"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                text = row[-1]
                begin, end, strength = gaps(text)
                if len(begin) <= limit:
                    continue
                past = 0
                for k, (a, b) in enumerate(cuts(strength, limit, overlap), 1):
                    out.append((*row[:-1], k, a, b - a, max(0, past - a), int(strength[b - 1]), text[begin[a] : end[b - 1]]))
                    past = b
            if out:
                yield pd.DataFrame(out, columns=[*cols, "piece_no", "first_word", "words", "repeated", "boundary", "piece"])

    return rows.mapInPandas(split, schema)
