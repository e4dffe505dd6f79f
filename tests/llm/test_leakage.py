import re

import numpy as np
import pytest

from veldra.llm import leakage
from veldra.llm.leakage import leak_report, leaked_items

SCHEMA = "doc_id bigint, text string, item_id string"


def words(text):
    return re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    runs = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(words(t)) - 11) for i in runs.get(tuple(words(t)[k : k + 12]), ())}


@pytest.fixture(scope="module")
def random_case():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 90)))) for i in range(60)]
    docs = []
    for d in range(300):
        text = list(rng.choice(vocabulary, rng.integers(0, 400)))
        if d % 3 == 0:
            w = words(items[rng.integers(60)][1])
            n = int(rng.integers(8, 20))
            at = int(rng.integers(0, max(1, len(w) - n)))
            text[len(text) // 2 : len(text) // 2] = [x.upper() for x in w[at : at + n]]
        docs.append((d, ", ".join(text)))
    return docs, items


def test_equals_brute_force(spark, random_case):
    docs, items = random_case
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_more_items_than_a_pass(spark, random_case, monkeypatch):
    docs, items = random_case
    monkeypatch.setattr("veldra.llm.leakage.ITEMS_PER_PASS", 17)
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)


def test_odd_rows(spark):
    run = "one two three four five six seven eight nine ten eleven twelve"
    same = " ".join(["no"] * 40)
    docs = [(1, run), (1, run), (2, None), (3, ""), (None, run), (4, "¿" + run.upper().replace(" ", " — ") + "é"), (5, "x " * 50_000 + run), (6, same), (7, run[4:])]
    docs = spark.createDataFrame([(a, b, "x") for a, b in docs], SCHEMA)  # item_id here clashes with the items' name
    items = spark.createDataFrame([(9, run), (9, run), (10, None), (11, "short"), (None, run), (12, same)], "item_id bigint, text string")
    leaks = leaked_items(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in leaks.collect()) == [(1, 9), (4, 9), (5, 9), (6, 12)]
    report = {r.item_id: (r.documents, r.most_shared_words) for r in leak_report(leaks, items).collect()}
    assert report == {9: (3, 12), 10: (0, 0), 11: (0, 0), 12: (1, 40)}


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert leaked_items(docs, items).count() == 0 and leaked_items(docs, some).count() == 0
    assert leaked_items(some.toDF("doc_id", "text"), items).columns == ["doc_id", "item_id", "shared_runs", "score", "longest"]


def test_longest_stretch_is_one_stretch(spark):
    item = [f"i{k}" for k in range(60)]
    docs = [
        (1, " ".join(item[:12] + ["x"] + item[20:32] + ["y"] + item[40:52])),  # three runs apart
        (2, " ".join(["a"] + item[5:40] + ["b"])),
        (3, " ".join(item[:14] + item[30:43])),  # side by side in the text, apart in the item
        (4, " ".join(["r"] * 30)),
    ]
    items = [(7, " ".join(item)), (8, " ".join(["r"] * 20)), (9, "too short")]
    leaks = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id): r.longest for r in leaks.collect()} == {(1, 7): 12, (2, 7): 35, (3, 7): 14, (4, 8): 20}
    report = {r.item_id: (r.documents, r.most_shared_words) for r in leak_report(leaks, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert report == {7: (3, 35), 8: (1, 20), 9: (0, 0)}


def test_many_items_in_one_scan(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 3)
    monkeypatch.setattr(leakage, "INDEXES_PER_SCAN", 2)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(15))) for i in range(20)]
    docs = [(i, "before " + t + " after") for i, t in items]
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(20)}
