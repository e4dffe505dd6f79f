"""Problem 3: variant spellings of names, linked to the party they mean.

* A name is cleaned: titles, articles, legal forms and unit numbers are set apart; words
  found beside many others (trades) are generic, as are their abbreviations. What is left
  is the core. A form is *full* if its core has two words or one long run of them, *short*
  if it has an initial for a word, lacks the trade or lacks a part of the core, *bare* if
  it is a lone short word (a pet name, an acronym). An entity's fullest form, among name and
  aliases, stands for it; its other full forms are kept beside it.
* Candidates: MinHash banding over the padded q-grams of the cores, together with kind and
  unit. The number of bands comes from the collision curve for names as alike as ``ALIKE``,
  to be missed with probability ``MISS`` at most. For short forms, full forms are banded
  again as they would look when shortened.
* Verification: Monge-Elkan similarity of the words with Jaro-Winkler inside, both ways.
  If one word is equal the other may be looser, with the same first letter; otherwise each
  word may have few edits only. Other units, kinds or trades are other parties.
* Star clustering of the full forms: in rounds, each node that has more links than all its
  unassigned neighbours becomes the centre of a star of them. A short form then joins the
  one star it resembles most; if two resemble it alike it joins none. A bare form links
  nothing: only an alias of its entity can.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from veldra.llm.banding import equal_pairs
from veldra.llm.words import mix
from veldra.storage import stage

Q = 3
ROWS = 3
ALIKE = 0.42
MISS = 0.01
#: A word in so large a part of the names, beside at least so many different words, is generic. At most 5 words a name over the first number can be.
GENERIC, GENERIC_LEAST = 0.004, 8
#: Least similarity of two names, and of a word whose partner word is equal.
SIMILAR, LOOSE = 0.86, 0.7
#: Letters from which a single word may be a whole name run together.
JOINED = 8

_TITLES = frozenset("mr mrs ms miss dr shri sri smt kumari prof sir adv advocate m/s ms. messrs the".split())
#: Words of legal forms, by what they come to.
_LEGAL = {"private": "", "pvt": "", "p": "", "limited": "", "ltd": "", "company": "", "co": "", "sons": "", "son": "", "and": "", "n": "", "&": "", "llp": "", "inc": "", "corp": "", "corporation": "", "bros": "", "brothers": ""}
#: Aliases that stand for nobody in particular.
_STAND_INS = frozenset("respondent appellant petitioner complainant applicant buyer seller supplier unit firm company party claimant defendant he she they it".split())
_UNIT = regex.compile(r"\(?\b(?:unit|u)\b[\s.\-]*(?:no\.?\s*)?(\d+)\)?|\(u-?(\d+)\)")


def clean(name: str | None) -> tuple[tuple[str, ...], str, bool] | None:
    """(words without titles and legal forms, unit or '', whether a legal form or unit was there); None for a stand-in."""
    if not name or not name.strip():
        return None
    low = name.lower().strip()
    bare = [w for w in regex.findall(r"\p{L}+", low) if w not in ("the", "said", "a", "this")]
    if not any(c.isupper() for c in name) and bare and all(w in _STAND_INS for w in bare):
        return None
    m = _UNIT.search(low)
    unit = (m[1] or m[2]).lstrip("0") if m else ""
    if m:
        low = low[: m.start()] + " " + low[m.end() :]
    words = [w for w in regex.split(r"[\s,;()\-]+", regex.sub(r"(?<=\p{L})\.(?=\s|,|$|\p{L})", " ", low.replace("m/s", " "))) if w]
    words = [regex.sub(r"[^\p{L}\p{N}&]", "", w) for w in words]
    legal = bool(m)
    out = []
    for i, w in enumerate(words):
        if w in _TITLES and (i == 0 or w == "the"):
            continue
        if w in _LEGAL and len(words) > 1 and not (len(w) == 1 and i == 0 and len(words) == 2 and "&" not in w):
            if w != "p" and w != "n" or any(x in ("ltd", "limited", "sons", "son", "company", "co") for x in words[i + 1 :]):
                legal = True
                continue
        if w:
            out.append(w)
    return (tuple(out), unit, legal) if out else None


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    reach = max(la, lb) // 2 - 1
    used = [False] * lb
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append((i, j))
                break
    m = len(matched)
    if not m:
        return 0.0
    right = [b[j] for j in sorted(j for _, j in matched)]
    swapped = sum(a[i] != r for (i, _), r in zip(matched, right)) / 2
    jaro = (m / la + m / lb + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, exchanges counted once; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], most + 1)


def alike(a: str, b: str) -> float:
    """Similarity of two words: Jaro-Winkler; too many edits for the length count nothing."""
    if a == b:
        return 1.0
    most = 1 + (min(len(a), len(b)) > 6)
    return jaro_winkler(a, b) if edits(a, b, most) <= most else 0.0


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...], word: Callable[[str, str], float] = alike) -> float:
    """Mean of the best partner's similarity for each word, of both directions the less."""
    if not a or not b:
        return 0.0
    one = sum(max(word(x, y) for y in b) for x in a) / len(a)
    two = sum(max(word(x, y) for x in a) for y in b) / len(b)
    return min(one, two)


def closely(a: str, b: str) -> float:
    """Jaro-Winkler of two words at most one edit apart."""
    return jaro_winkler(a, b) if edits(a, b, 1) <= 1 else 0.0


def loosely(a: str, b: str) -> float:
    """Jaro-Winkler of two words of the same first letter, if ``LOOSE`` or more."""
    got = jaro_winkler(a, b) if a[0] == b[0] else 0.0
    return got if got >= LOOSE else 0.0


def cores(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Similarity of two full cores, in any order of the words; 0 if too far apart."""
    if a == b:
        return 1.0
    if len(a) != len(b) and min(len(a), len(b)) == 1:  # words run together
        one, more = sorted((a, b), key=len)
        least = min(edits(one[0], "".join(order), 2) for order in (more, more[::-1]))
        return 1 - least / 16 if least <= 1 + (len(one[0]) > 9) else 0.0
    if len(a) == len(b) == 2 and set(a) & set(b):
        shared = (set(a) & set(b)).pop()
        (x,), (y,) = ([w for w in c if w != shared] or [shared] for c in (a, b))
        # A pet name or a clipped word beside an equal one that says more.
        loose = loosely(x, y) if max(len(x), len(y)) <= len(shared) else 0.0
        return (1 + max(loose, alike(x, y))) / 2 if loose or alike(x, y) else 0.0
    return monge_elkan(a, b, closely)


def abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` is the beginning of ``long``, or its first letter and then consonants of it in order."""
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    if len(short) > 2 and long.startswith(short):
        return True
    if any(c in "aeiou" for c in short[1:]):
        return False
    rest = iter(long)
    return all(c in rest for c in short)


class Form(NamedTuple):
    """A name as it is compared."""

    kind: str
    unit: str
    core: tuple[str, ...]
    trade: frozenset[str]
    #: '' if full; 'initial', 'trade' (it lacks the trade), 'part' (one word of the core and the trade) or 'bare'.
    short: str
    initial: str = ""

    @property
    def rank(self) -> int:
        return 3 if not self.short and len(self.core) > 1 else 2 if not self.short else 0 if self.short == "bare" else 1

    @property
    def node(self) -> str:
        return "|".join((self.kind, self.unit, self.initial, " ".join(sorted(self.core)), min(self.trade, default="")))


class Names:
    """Forms and their similarities with the generic words of the collection."""

    def __init__(self, generic: frozenset[str]) -> None:
        # An abbreviation that is frequent itself is no trade of its own.
        self.generic = frozenset(g for g in generic if not any(abbreviates(g, h) for h in generic))
        self.known: dict[str, frozenset[str]] = {}

    def trade(self, word: str) -> frozenset[str]:
        """The generic words that ``word`` is, abbreviates or misspells."""
        got = self.known.get(word)
        if got is None:
            if word in self.generic:
                got = frozenset([word])
            elif len(word) >= 3:
                got = frozenset(g for g in self.generic if abbreviates(word, g) or (len(word) > 5 and edits(word, g, 1) <= 1))
            else:
                got = frozenset()
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = got
        return got

    def form(self, kind: str, unit: str, words: tuple[str, ...]) -> Form:
        if kind == "p":
            long, initials = tuple(w for w in words if len(w) > 1), [w for w in words if len(w) == 1]
            if len(long) > 1 or (len(long) == 1 and not initials and len(long[0]) >= JOINED):  # middle initials tell nothing
                return Form(kind, unit, long, frozenset(), "")
            if len(long) == 1 and initials:
                return Form(kind, unit, long, frozenset(), "initial", initials[0])
            return Form(kind, unit, words, frozenset(), "bare")
        trades = [(w, self.trade(w)) for w in words]
        core = tuple(w for w, t in trades if not t)
        if not core:  # a name of generic words only keeps them
            return Form(kind, unit, words, frozenset(), "" if len(words) > 1 else "bare")
        trade = frozenset().union(*(t for _, t in trades))
        if len(core) > 1 or len(core[0]) >= JOINED:
            return Form(kind, unit, core, trade, "" if trade else "trade")
        return Form(kind, unit, core, trade, "part" if trade else "bare")

    @staticmethod
    def similarity(a: Form, b: Form) -> float:
        """0 if the two can't be one party."""
        if a.kind != b.kind or a.unit != b.unit or (a.trade and b.trade and not a.trade & b.trade):
            return 0.0
        if a.short and b.short:
            return 0.0
        if b.short in ("initial", "part"):
            a, b = b, a
        if a.short == "initial":
            return max((1 - edits(a.core[0], w, 2) / 16 for w in b.core if any(o[0] == a.initial for o in b.core if o != w) and edits(a.core[0], w, 2) <= 1 + (len(w) > 6)), default=0.0) if len(b.core) > 1 else 0.0
        if a.short == "part":
            return max((1 - edits(a.core[0], w, 2) / 16 for w in b.core if edits(a.core[0], w, 2) <= 1), default=0.0) if len(b.core) > 1 and b.trade else 0.0
        return cores(a.core, b.core)

    @staticmethod
    def views(f: Form) -> list[tuple[str, tuple[str, ...]]]:
        """(name space, words to band) of a form, for full forms also as they would look when shortened."""
        base = f"{f.kind}|{f.unit}|"
        if f.short == "initial":
            return [(base + "i" + f.initial, f.core)]
        if f.short == "part":
            return [(base + "c" + t, f.core) for t in f.trade]
        out = [(base, f.core)]
        if not f.short and len(f.core) > 1:
            if f.kind == "p":
                out += sorted({(base + "i" + o[0], (w,)) for k, w in enumerate(f.core) for j, o in enumerate(f.core) if j != k})
            else:
                out += sorted({(base + "c" + t, (w,)) for w in f.core for t in f.trade})
        return out


def _grams(words: tuple[str, ...]) -> list[int]:
    out = set()
    for w in words:
        padded = "#" * (Q - 1) + w + "#" * (Q - 1)
        out.update(padded[i : i + Q] for i in range(len(padded) - Q + 1))
    return [int.from_bytes(g.encode()[-8:], "little") * 8 + len(g) for g in sorted(out)]


def bands_for(alike_: float = ALIKE, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - alike_**rows))


def _packed(f: Form) -> str:
    return "\t".join((f.kind, f.unit, " ".join(f.core), " ".join(sorted(f.trade)), f.short, f.initial))


def _unpacked(text: str) -> Form:
    kind, unit, core, trade, short, initial = text.split("\t")
    return Form(kind, unit, tuple(core.split()), frozenset(trade.split()), short, initial)


class Parties:
    """Entities linked to parties.

    ``members()``: ``entity_key, party`` (the least key of the party); ``pairs()``:
    ``entity_a, entity_b`` of one party, smaller key first.

    ``name_norm`` is read where ``name`` is null, empty or a stand-in; without either an
    entity is left to its aliases, without any it is a party of its own, as is one no
    other resembles. A type that is null is guessed from legal forms and trades. Rows
    without a key are left out; rows repeated as a whole, or of one key, count once (all
    their names count). An empty table gives an empty result. Columns but the named ones
    aren't read.
    """

    def __init__(self, df: DataFrame, key: str = "entity_key", name: str = "name", aliases: str = "aliases", kind: str = "type", norm: str = "name_norm") -> None:
        rows = df.select(*(F.col(c).alias(a) for c, a in ((key, "key"), (name, "name"), (aliases, "aliases"), (kind, "kind"), (norm, "norm")))).filter("key is not null").distinct()

        def cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    own = clean(r.name) or clean(r.norm)
                    got = [c for c in (own, *map(clean, r.aliases if r.aliases is not None else ())) if c]
                    kind_ = (r.kind or "").lower()
                    person = "p" if kind_.startswith(("person", "indiv")) else "o" if kind_.startswith("organi") or any(c[2] for c in got) else "?"
                    unit = next((u for _, u, _ in got if u), "")
                    out.append((r.key, person, unit, [" ".join(w) for w, u, _ in got if u in ("", unit)]))
                yield pd.DataFrame(out, columns=["key", "kind", "unit", "names"])

        made = stage(rows.mapInPandas(cleaned, "key string, kind string, unit string, names array<string>"), "names")
        # A word at home beside many others is generic.
        whole = made.filter("kind <> 'p' and size(names) > 0").select(F.col("names")[0].alias("w")).distinct().withColumn("words", F.array_distinct(F.split("w", " ")))
        beside = whole.select(F.explode("words").alias("w"), "words").filter("length(w) > 3").groupBy("w").agg(F.count("*").alias("n"), F.approx_count_distinct(F.concat_ws(" ", F.expr("filter(words, x -> x <> w)"))).alias("others"))
        generic = frozenset(r["w"] for r in beside.filter((F.col("others") >= GENERIC_LEAST) & (F.col("n") >= GENERIC * whole.count())).select("w").collect())
        names = Names(generic)
        bands = bands_for()
        x = mix(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mul, add = x[: bands * ROWS] | np.uint64(1), x[bands * ROWS :]
        step = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    texts = list(dict.fromkeys(r.names))
                    kind_ = r.kind if r.kind != "?" else "o" if any(names.trade(w) for t in texts for w in t.split()) else "p"
                    forms = [names.form(kind_, r.unit, tuple(t.split())) for t in texts]
                    best = max(forms, key=lambda f: f.rank, default=None)
                    node = best.node if best and best.rank else f"k|{r.key}"
                    keep = [f for f in forms if f.rank > 1 or f is best] if best and best.rank else []
                    out += [(r.key, node, _packed(f)) for f in keep] or [(r.key, node, None)]
                yield pd.DataFrame(out, columns=["key", "node", "form"])

        formed_ = stage(made.mapInPandas(formed, "key string, node string, form string"), "forms")
        self._members = formed_.select("key", "node").distinct()
        forms = formed_.filter("form is not null").select("node", "form").distinct()

        def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for text in batch["form"]:
                    keys = []
                    for space, words in names.views(_unpacked(text)):
                        g = mix(np.array(_grams(words), np.uint64))
                        least = ((g[:, None] * mul + add) >> np.uint64(20)).min(axis=0).reshape(bands, ROWS)
                        k = least[:, 0] + np.uint64(hash_text(space))
                        for j in range(1, ROWS):
                            k = mix(k) + least[:, j]
                        keys.append(mix(k + step).view(np.int64))
                    out.append(np.concatenate(keys))
                yield batch.assign(bands=out)

        # One row a form; equal forms of several nodes meet like others.
        listed = stage(forms.withColumn("id", F.xxhash64("node", "form")).mapInPandas(banded, "node string, form string, id bigint, bands array<bigint>"), "bands")
        keyed = listed.select("id", F.explode(F.array_distinct("bands")).alias("band"))
        pairs = equal_pairs(keyed, "band", "id")
        parts = F.split("form", "\t")
        sides = [
            listed.select(F.col("id").alias(s), F.col("node").alias(f"node_{s}"), F.col("form").alias(f"form_{s}"), F.split(parts[2], " ").alias(f"core_{s}"), parts[4].alias(f"short_{s}"))
            for s in "ab"
        ]
        full = pairs.join(sides[0], "a").join(sides[1], "b").filter("node_a <> node_b and (short_a = '' or short_b = '')")
        # What can't be verified is set aside before Python: no equal word, and over 4 edits in either order.
        straight, turned = F.array_join("core_b", ""), F.array_join(F.reverse("core_b"), "")
        near = F.least(F.levenshtein(F.array_join("core_a", ""), straight), F.levenshtein(F.array_join("core_a", ""), turned)) <= 4
        full = full.filter(F.col("short_a").isin("initial", "part") | F.col("short_b").isin("initial", "part") | F.arrays_overlap("core_a", "core_b") | near)

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for node_a, node_b, form_a, form_b, short_a, short_b in zip(*(batch[c] for c in ("node_a", "node_b", "form_a", "form_b", "short_a", "short_b"))):
                    same = names.similarity(_unpacked(form_a), _unpacked(form_b))
                    short = bool(short_a or short_b)
                    if same >= SIMILAR or (same and short):
                        turn = bool(short_b) if short else node_a > node_b  # a short form stands first, else the smaller node
                        out.append((node_b, node_a, same, short) if turn else (node_a, node_b, same, short))
                yield pd.DataFrame(out, columns=["a", "b", "similarity", "short"])

        verified = full.select("node_a", "node_b", "form_a", "form_b", "short_a", "short_b").mapInPandas(verify, "a string, b string, similarity double, short boolean")
        links = stage(verified.groupBy("a", "b", "short").agg(F.max("similarity").alias("similarity")), "links")
        #: Links between full forms ``a, b, similarity``, and from short forms ``a`` to full ones ``b``.
        self.links, self.short_links = links.filter("not short").drop("short"), links.filter("short").drop("short")
        self._stars = self._cluster()

    def _cluster(self) -> DataFrame:
        """``node, star``: the stars of full forms, then each short form at the star it resembles most, if there is just one."""
        both = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
        count = both.groupBy("a").agg(F.count("*").alias("n"))
        left = stage(both.join(count.select(F.col("a").alias("b"), F.struct(F.col("n"), F.xxhash64("a"), F.col("a")).alias("weight_b")), "b").join(count.select("a", F.struct(F.col("n"), F.xxhash64("a"), F.col("a")).alias("weight_a")), "a"), "stars")
        done = None
        # The heaviest node of each component becomes a centre in every round, so the loop ends.
        while left.head(1):
            centres = left.groupBy("a").agg(F.bool_and(F.col("weight_a") > F.col("weight_b")).alias("centre")).filter("centre").select("a")
            joined = left.join(centres, "a").groupBy("b").agg(F.max_by("a", F.struct("similarity", "weight_a")).alias("star")).select(F.col("b").alias("node"), "star")
            new = stage(joined.unionByName(centres.select(F.col("a").alias("node"), F.col("a").alias("star"))), "stars")
            done = new if done is None else done.unionByName(new)
            gone = new.select("node")
            left = stage(left.join(gone, left["a"] == gone["node"], "left_anti").join(gone, left["b"] == gone["node"], "left_anti"), "stars")
        if done is None:
            done = self.links.select(F.col("a").alias("node"), F.col("a").alias("star"))
        near = self.short_links.join(done, self.short_links["b"] == done["node"], "left").select("a", F.coalesce("star", "b").alias("star"), "similarity")
        near = near.groupBy("a", "star").agg(F.max("similarity").alias("similarity"))
        best = near.groupBy("a").agg(F.max("similarity").alias("best"))
        only = near.join(best, "a").filter("similarity = best").groupBy("a").agg(F.min("star").alias("star"), F.count("*").alias("n")).filter("n = 1")
        return done.unionByName(only.select(F.col("a").alias("node"), "star"))

    def _by_star(self) -> DataFrame:
        return self._members.join(self._stars, "node", "left").select("key", F.coalesce("star", "node").alias("star")).distinct()

    def members(self) -> DataFrame:
        own = self._by_star()
        parties = own.groupBy("star").agg(F.min("key").alias("party"))
        return own.join(parties, "star").groupBy("key").agg(F.min("party").alias("party")).select(F.col("key").alias("entity_key"), "party")

    def pairs(self) -> DataFrame:
        own = self.members()
        left, right = own.select(F.col("entity_key").alias("entity_a"), "party"), own.select(F.col("entity_key").alias("entity_b"), "party")
        return left.join(right, "party").filter("entity_a < entity_b").select("entity_a", "entity_b")


def hash_text(text: str) -> int:
    """A 64-bit number of a text, the same in every process."""
    h = 0xCBF29CE484222325
    for c in text.encode():
        h = (h ^ c) * 0x100000001B3 % (1 << 64)
    return h
