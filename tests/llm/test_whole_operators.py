"""Operators where a part of the job used to be left out."""

import numpy as np

from veldra.llm.leakage import leaked_items
from veldra.llm.names import Parties


def test_leak_in_the_last_twelve_words(spark):
    item = [f"i{k}" for k in range(12)]
    docs = [(length, " ".join([f"d{k}" for k in range(length - 12)] + item)) for length in range(12, 62)]
    docs.append((100, " ".join([f"d{k}" for k in range(11)] + ["i"] + item)))  # two runs, one of them the last
    items = [(1, " ".join(item)), (2, " ".join(["i", *item]))]
    got = {(r.doc_id, r.item_id): r.shared_runs for r in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(d, i): 1 for d in range(12, 62) for i in (1, 2)} | {(100, 1): 1, (100, 2): 2}


def test_parties_of_many_aliases(spark):
    rng = np.random.default_rng(8)
    syllables = [c + v for c in "bdfghjklmnprstvz" for v in "aeiou"]
    aliases = sorted({" ".join("".join(rng.choice(syllables, 4)).capitalize() for _ in range(2)) for _ in range(60)})
    rows = [("hub", "Habura Vira", aliases[:30]), ("hub2", "Habura Vira", aliases[30:])] + [(f"k{i:02}", a, None) for i, a in enumerate(aliases)]
    rows = [(key, name, "PERSON", own, None) for key, name, own in rows]
    found = Parties(spark.createDataFrame(rows, "entity_key string, name string, type string, aliases array<string>, name_norm string"))
    linked = {r.b if "habura" in r.a else r.a for r in found.links.collect() if "habura" in r.a + r.b}
    assert len(aliases) == 60 and linked == {"p|||" + " ".join(sorted(a.lower().split())) + "|" for a in aliases}
    assert found.links.count() == found.links.select("a", "b").distinct().count()
    assert {r.party for r in found.members().collect()} == {"hub"}
