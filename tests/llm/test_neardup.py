import re

import numpy as np
import pytest

from veldra.llm.components import connected_components
from veldra.llm.neardup import NearDuplicates, bands_for


def sets(text):
    w = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else None


def brute(rows, threshold):
    own = {i: sets(t) for i, t in rows if sets(t)}
    ids = sorted(own)
    return {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(own[a] & own[b]) / len(own[a] | own[b]) >= threshold}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(500)]
    out = []
    for family in range(60):
        base = list(rng.choice(vocabulary, rng.integers(20, 150)))
        for k in range(4):
            text = list(base)
            for _ in range(int(len(base) * rng.uniform(0, 0.12))):
                text[rng.integers(len(text))] = rng.choice(vocabulary)
            out.append((f"f{family:02d}-{k}", " ".join(text) if k else " ".join(text).upper() + "."))
    return out


def test_equals_brute_force(spark, rows):
    want = brute(rows, 0.6)
    near = NearDuplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    got = {(r.a, r.b): r.similarity for r in near.record_pairs().collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_copies_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    odd = [("a", text), ("a", text), ("b", text.replace(" ", ",\n")), ("c", text + " tail"), ("d", None), ("e", ""), (None, text), ("f", "too short"), ("g", " ".join(f"v{i}" for i in range(30_000))), ("h", " ".join(["same"] * 30)), ("i", " ".join(["same"] * 25))]
    df = spark.createDataFrame([(i, t, "z") for i, t in odd], "id string, text string, set_id string")
    near = NearDuplicates(df, "id", "text")
    assert sorted((r.a, r.b) for r in near.record_pairs().collect()) == [("a", "b"), ("a", "c"), ("b", "c"), ("h", "i")]
    groups = {r.id: r for r in near.groups().collect()}
    assert set(groups) == {"a", "b", "c", "g", "h", "i"}
    assert groups["a"].group_id == groups["b"].group_id == groups["c"].group_id != groups["h"].group_id
    assert (groups["a"].class_size, groups["a"].links, groups["g"].links) == (2, 1, 0)


def test_empty(spark):
    near = NearDuplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert near.record_pairs().count() == 0 and near.groups().count() == 0


def test_bands_follow_the_collision_curve():
    for threshold in (0.5, 0.6, 0.8):
        assert (1 - threshold**5) ** bands_for(threshold) <= 0.005 < (1 - threshold**5) ** (bands_for(threshold) - 1)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5), (None, 3)] + [(1000, 1001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
