"""Problem 9: abusive, hateful and sexual language.

* Tokens: words of any script, without case. A capitalised word inside a sentence is a
  name and a number a number, whichever. Letters of other alphabets that look
  Latin, spaced-out letters (``i d i o t``) and masked ones (``i***t``) are undone.
* Terms are words and pairs of words, weighted by how much more often labelled abusive
  documents hold them than clean ones (a log ratio with a prior); a seed list of plain
  terms has a prior of its own, so the operator works with few labels. Terms that
  go with dealing with such matters (rules, reports, medicine) get negative weights.
* A word that no labelled document holds may be a misspelt term: a Levenshtein
  automaton, run along a trie of the terms, finds terms at one edit (two from eight letters).
  The automaton's states are made lazily and kept, so a letter costs one look-up.
* The score of a document is the greatest sum of weights in a window of ``WINDOW``
  tokens: one insult with its context, not the length of the text.

The labelled sample is bounded by ``MOST_ABUSIVE`` and ``MOST_CLEAN`` rows; scoring sees every row and whole
texts, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from veldra.llm.packing import clean_source
from veldra.llm.words import _FOLD, mix, string_parts, word_hashes

#: Labelled documents that the weights are fitted to, at most: abusive and clean ones.
MOST_ABUSIVE, MOST_CLEAN = 2_000, 4_000
WINDOW = 12
#: Used as long as there are too few labels to choose one.
DEFAULT_THRESHOLD = 6.0
#: The lowest threshold is taken whose F1 is so near to the best.
SLACK = 0.004
#: Terms kept have at least this weight either way.
LEAST_WEIGHT = 1.0

#: Terms abusive or sexual by themselves; prior counts in abusive documents.
STRONG = """arsehole asshole bastard bitch bullshit cock cunt dick dickhead fuck fucked fucker fucking motherfucker piss pussy
porn prick shit slut tits wanker whore scumbag twat orgy horny naked nude arse blowjob dildo
harami haramkhor kamina kamine kutta chutiya bhosdike madarchod behenchod gandu randi saala saale bewakoof verpiss arschloch
scheisse hurensohn हरामी कमीना कमीने गधे साले कुत्ते चूतिया रंडी मादरचोद""".split()
#: Terms that mostly need their context.
WEAK = """cretin moron halfwit imbecile idiot stupid dumb fool parasite vermin filth filthy scum rot starve choke strangle
kill murder rape hang hanged acid beaten legs burn breed dirt rats rat pig cow worthless useless brainless bloody sexy thighs
moaned lube clothes sex""".split()

_LOOKALIKES = str.maketrans("аеорсухіјѕԁӏҺһмтвкнАЕОРСХУІЈЅМТВКНαοερυικ", "aeopcyxijsdlhhmtbkhAEOPCXYIJSMTBKHaoepuik")
_SPACED = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:\p{L}[ .\-_*·]){3,}\p{L}(?![\p{L}\p{M}\p{N}])")
_MASKED = regex.compile(r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]*[*#@$!]+[\p{L}\p{N}*#@$!]*\p{L}(?![\p{L}\p{N}])")
#: For Arrow's engine: rows that may need one of the three repairs.
_ODD = r"[A-Za-z][\x{0370}-\x{052F}]|[\x{0370}-\x{052F}][A-Za-z]|[A-Za-z][*#@$!]+[A-Za-z]|\b[A-Za-z][ .\-_*][A-Za-z][ .\-_*][A-Za-z][ .\-_*][A-Za-z]\b|[\x{200B}-\x{200D}\x{2060}\x{00AD}]"
_HIDDEN = regex.compile(r"[​-‍⁠­]")

_LETTERS = _FOLD.copy()
_LETTERS[128:] = np.arange(128, 256)
_NAME, _NUMBER = mix(np.array([1, 2], np.uint64))


class Automaton:
    """Words within a few edits of some term: Levenshtein automata of all terms along one trie.

    A state is the set of (node of the trie, edits used so far) that the letters read
    can lead to. ``find`` gives the term of the fewest edits, of several the first in
    order, or None. Terms of under ``least`` letters match only as they are; edits are
    an inserted, a missing or another letter, or two letters exchanged.
    """

    def __init__(self, terms: list[str], least: int = 5, second: int = 8) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed: list[int] = [0]
        self.least = least
        for term in sorted(set(terms)):
            most = 0 if len(term) < least else 1 if len(term) < second else 2
            node = 0
            self.allowed[0] = max(self.allowed[0], most)
            for letter in term:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.next[node][letter]
                self.allowed[node] = max(self.allowed[node], most)
            self.term[node] = term
        self.most = {t: (0 if len(t) < least else 1 if len(t) < second else 2) for t in set(terms)}
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.start = self._closed({(0, 0, "")})

    def _closed(self, states: set) -> frozenset:
        """With letters of the term left out."""
        todo = list(states)
        while todo:
            node, edits, held = todo.pop()
            if held or edits >= self.allowed[node]:
                continue
            for child in self.next[node].values():
                state = (child, edits + 1, "")
                if edits < self.allowed[child] and state not in states:
                    states.add(state)
                    todo.append(state)
        return frozenset(states)

    def step(self, states: frozenset, letter: str) -> frozenset:
        got = self.steps.get((states, letter))
        if got is None:
            new = set()
            for node, edits, held in states:
                children = self.next[node]
                if held:  # two letters exchanged: the one held back comes now
                    if held == letter:
                        new.add((node, edits, ""))
                    continue
                if letter in children:
                    new.add((children[letter], edits, ""))
                if edits < self.allowed[node]:
                    new.add((node, edits + 1, ""))
                    for first, child in children.items():
                        if edits < self.allowed[child]:
                            if first != letter:
                                new.add((child, edits + 1, ""))
                            other = self.next[child].get(letter)
                            if other is not None and first != letter and edits < self.allowed[other]:
                                new.add((other, edits + 1, first))
            got = self._closed(new)
            if len(self.steps) > 200_000:
                self.steps.clear()
            self.steps[states, letter] = got
        return got

    def find(self, word: str) -> str | None:
        states = self.start
        for letter in word:
            states = self.step(states, letter)
            if not states:
                return None
        ends = [(edits, self.term[node]) for node, edits, held in states if not held and self.term[node] and edits <= self.most[self.term[node]]]
        return min(ends)[1] if ends else None


def _word(text: str) -> np.uint64:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), _LETTERS)[0][0]


def repaired(text: str, terms: frozenset[str], automaton: Automaton) -> str:
    """The text with look-alike letters, invisible characters, spaced-out and masked words undone."""
    text = _HIDDEN.sub("", text)
    text = regex.sub(r"[\p{L}]*(?:[A-Za-z]\p{IsGreek}|\p{IsGreek}[A-Za-z]|[A-Za-z]\p{IsCyrillic}|\p{IsCyrillic}[A-Za-z])[\p{L}]*", lambda m: m[0].translate(_LOOKALIKES), text)

    def joined(m) -> str:
        word = regex.sub(r"[^\p{L}]", "", m[0]).lower()
        for at in range(3, len(word) - 2):
            if word[:at] in terms and word[at:] in terms:
                return f"{word[:at]} {word[at:]}"
        return word

    def unmasked(m) -> str:
        word = m[0].lower()
        shape = regex.compile("".join(regex.escape(c) if c.isalnum() else r"\p{L}" for c in word) + r"\Z")
        return next((t for t in sorted(terms) if shape.match(t)), m[0])

    return _MASKED.sub(unmasked, _SPACED.sub(joined, text))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with names and numbers replaced; the bytes of punctuation beyond ASCII end words."""
    data = data.copy()
    for first, low, high, size in ((0xE2, 0x80, 0x8F, 3), (0xC2, 0x80, 0xBF, 2)):
        at = np.flatnonzero(data[: len(data) - 1] == first) if len(data) else np.zeros(0, np.int64)
        at = at[(data[at + 1] >= low) & (data[at + 1] <= high)]
        for k in range(size):
            data[np.minimum(at + k, len(data) - 1)] = 32
    at = np.flatnonzero(data[: max(0, len(data) - 2)] == 0xE0)
    at = at[(data[at + 1] == 0xA5) & ((data[at + 2] == 0xA4) | (data[at + 2] == 0xA5))]
    for k in range(3):
        data[at + k] = 46
    hashes, firsts, begin, end = word_hashes(data, offsets, _LETTERS)
    if len(hashes):
        head, second = data[begin], data[np.minimum(begin + 1, end - 1)]
        capital = (head >= 65) & (head <= 90) & (second >= 97) & (second <= 122)
        # Not where a sentence begins: the nearest byte before that is no blank ends one, or is none.
        back = begin - 1
        for _ in range(3):
            back = np.where((back >= 0) & (data[np.maximum(back, 0)] <= 32) & (data[np.maximum(back, 0)] != 10), back - 1, back)
        last = np.where(back < 0, 10, data[np.maximum(back, 0)])
        starts = np.isin(last, np.frombuffer(b"\n.!?:>\"", np.uint8))
        starts[np.minimum(firsts[:-1], len(starts) - 1)] = True
        hashes[capital & ~starts] = _NAME
        hashes[(head >= 48) & (head <= 57)] = _NUMBER
    return hashes, firsts, begin, end


def _pairs(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of each token, the hash of it and the one before; 0 at the first of a text."""
    out = np.zeros(len(hashes), np.uint64)
    out[1:] = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    at = firsts[:-1]
    out[at[at < len(out)]] = 0
    return out


class Lexicon:
    """Weighted terms, the words that are no misspellings, the automaton and the threshold."""

    def __init__(self, texts: list[str], abusive: np.ndarray, one_of: tuple[float, float] = (1.0, 1.0)) -> None:
        """``one_of``: how many labelled documents stand behind a clean one and behind an abusive one of the sample."""
        self.terms = frozenset(STRONG) | frozenset(WEAK)
        self.automaton = Automaton(sorted(self.terms))
        self.known = np.zeros(0, np.uint64)
        col = pa.array(texts, pa.large_string())
        tokens, texts_of = [], []
        spelled: dict[int, str] = {}
        for row, n, hashes, firsts, words in self._read(col, False):
            tokens.append((hashes, _pairs(hashes, firsts)))
            texts_of.append(row + np.repeat(np.arange(n), np.diff(firsts)))
            spelled.update(words)
        words = np.concatenate([h for h, _ in tokens]) if tokens else np.zeros(0, np.uint64)
        pairs = np.concatenate([p for _, p in tokens]) if tokens else words
        text = np.concatenate(texts_of) if texts_of else np.zeros(0, np.int64)
        self.known = np.unique(words)
        n_abusive, n_clean = int(abusive.sum()), int((~abusive).sum())
        prior = {int(_word(t)): 4.0 for t in STRONG} | {int(_word(t)): 1.0 for t in WEAK}

        def weigh(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = rows[text]
            p_all, n_all = max(20, int((abusive & rows).sum())), max(200, int((~abusive & rows).sum()))  # as if so many with few labels
            kind, of = np.unique(np.concatenate([words[own], pairs[own], np.array(list(prior), np.uint64)]), return_inverse=True)
            doc = np.concatenate([text[own], text[own]])
            seen = np.unique(of[: len(doc)].astype(np.int64) * max(1, len(abusive)) + doc)
            kind_of, doc = seen // max(1, len(abusive)), seen % max(1, len(abusive))
            p = np.bincount(kind_of[abusive[doc]], minlength=len(kind)).astype(float)
            n = np.bincount(kind_of[~abusive[doc]], minlength=len(kind)).astype(float)
            base = p_all / (p_all + n_all)
            seed = np.array([prior.get(int(k), 0.0) for k in kind])
            weight = np.log((p + seed + base) / p_all) - np.log((n + 1 - base) / n_all)
            weight[(p < 2) & (seed == 0) & (weight > 0)] = 0
            weight[n + p + seed < 3] = np.where(seed[n + p + seed < 3] > 0, weight[n + p + seed < 3], 0)
            weight[kind == 0] = 0
            good = np.abs(weight) >= LEAST_WEIGHT
            return kind[good], np.clip(weight[good], -3, 5)

        self.threshold = DEFAULT_THRESHOLD
        if n_abusive >= 30 and n_clean >= 30:
            # Scores of each half by the weights of the other choose the threshold.
            half = np.arange(len(abusive)) % 2 == 0
            scores = np.zeros(len(abusive))
            for own in (half, ~half):
                self.kind, self.weight = weigh(~own)
                scores[own] = self._scores(words, pairs, text, len(abusive))[own]
            order = np.argsort(-scores, kind="stable")
            stands = np.where(abusive, one_of[1], one_of[0])[order]
            hit = np.cumsum(abusive[order] * stands)
            f1 = 2 * hit / (np.cumsum(stands) + n_abusive * one_of[1])
            best = int(np.flatnonzero(f1 >= f1.max() - SLACK)[-1])  # judgements may be mistaken
            after = scores[order[best + 1]] if best + 1 < len(order) else 0.0
            # nearer to the clean side: what is abusive in few words scores low
            self.threshold = float(max(1.0, (scores[order[best]] + 2 * after) / 3))
        self.kind, self.weight = weigh(np.ones(len(abusive), bool))
        # Learnt words are terms of the automaton as well.
        heavy = set(self.kind[self.weight >= 2.5].tolist())
        learnt = [spelled[h] for h in heavy if h in spelled]
        self.terms = self.terms | frozenset(learnt)
        self.automaton = Automaton(sorted(self.terms))

    def _read(self, col: pa.Array, correct: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict]]:
        """(first row, rows, token hashes, where texts begin, spelling of unknown or of all plain words)."""
        import pyarrow.compute as pc

        col = col.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(col, _ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            texts = col.to_pylist()
            for i in np.flatnonzero(odd):
                texts[i] = repaired(texts[i], self.terms, self.automaton)
            col = pa.array(texts, pa.large_string())
        for row, n, data, offsets in string_parts(col):
            hashes, firsts, begin, end = _tokens(data, offsets)
            plain = (hashes != _NAME) & (hashes != _NUMBER)
            if correct:
                at = np.searchsorted(self.known, hashes)
                at[at == len(self.known)] = 0
                plain &= (self.known[at] != hashes) if len(self.known) else plain
                # A capitalised word is rather a name, wherever it stands.
                head, second = data[begin], data[np.minimum(begin + 1, end - 1)]
                plain &= ~((head >= 65) & (head <= 90) & (second >= 97))
            kinds, first = np.unique(hashes[plain], return_index=True)
            place = np.flatnonzero(plain)[first]
            words = {int(h): bytes(data[begin[p] : end[p]]).decode("utf-8", "replace").lower() for h, p in zip(kinds, place)}
            if correct and words:
                mapped = {h: t for h, w in words.items() if len(w) < 40 and (t := self.automaton.find(w))}
                for h, t in mapped.items():
                    hashes[hashes == np.uint64(h)] = _word(t)
            yield row, n, hashes, firsts, words

    def _scores(self, words: np.ndarray, pairs: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        weight = np.zeros(len(words))
        if len(self.kind):
            for x in (words, pairs):
                at = np.searchsorted(self.kind, x)
                at[at == len(self.kind)] = 0
                weight += np.where(self.kind[at] == x, self.weight[at], 0.0)
        total = np.concatenate([[0.0], np.cumsum(weight)])
        first = np.searchsorted(text, text)
        begin = np.maximum(first, np.arange(1, len(words) + 1) - WINDOW)
        out = np.zeros(n)
        np.maximum.at(out, text, total[1:] - total[begin])
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for row, n, hashes, firsts, _ in self._read(col, True):
            text = np.repeat(np.arange(n), np.diff(firsts))
            out[row : row + n] = self._scores(hashes, _pairs(hashes, firsts), text, n)
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Weights and threshold from the labelled documents, at most ``MOST_ABUSIVE`` and ``MOST_CLEAN`` of them (by hash)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("abusive")).filter("id is not null and abusive in (0, 1)").groupBy("id").agg(F.max("abusive").alias("abusive"))
    sizes = {r["abusive"]: r["n"] for r in known.groupBy("abusive").agg(F.count("*").alias("n")).collect()}
    most = {0: MOST_CLEAN, 1: MOST_ABUSIVE}
    parts = [known.filter(F.col("abusive") == a).orderBy(F.xxhash64("id"), "id").limit(n) for a, n in most.items()]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(parts[0].unionByName(parts[1])), "id").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").toPandas()
    one_of = tuple(max(1.0, sizes.get(a, 0) / n) for a, n in most.items())
    return Lexicon(rows["text"].tolist(), rows["abusive"].to_numpy(dtype=np.int64) == 1, one_of)


def abuse_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, score DOUBLE, abusive BOOLEAN`` of every row with an id.

    The source is without case and outer blanks, ``unknown`` if null or blank. Null and
    empty texts score 0. Rows repeated as a whole count once. Without labels the seed
    terms and ``DEFAULT_THRESHOLD`` decide. Other columns aren't read; an empty table gives
    an empty result.
    """
    lexicon = fit(docs, labels, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_source(source_col).alias("source"), F.col(text_col).alias("text")).filter("doc_id is not null")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = lexicon.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(s), pa.array(s >= lexicon.threshold)], ["doc_id", "source", "score", "abusive"])

    return rows.mapInArrow(score, f"doc_id {kind}, source string, score double, abusive boolean").distinct()


def abuse_rates(scores: DataFrame) -> DataFrame:
    """``source, documents, abusive, rate`` by clean source."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive")).withColumn("rate", F.col("abusive") / F.col("documents"))
