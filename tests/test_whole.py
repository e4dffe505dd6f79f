"""Queries over small tables where a part of the job used to be left out."""

import difflib

import numpy as np

from veldra.operators import search as S
from veldra.queries import graph, ranking


def shingle_set(text):
    n = 12 if len(text) > 500 else 6
    return {text.lower()[i : i + n] for i in range(len(text) - n + 1)}


def test_near_dup_of_long_texts(spark, tmp_path):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    long = " ".join(words)
    texts = {"a": long, "b": long.replace("wordaa", "other"), "c": " ".join(reversed(words)), "d": long[:499], "e": long[:495], "f": long[:501], "g": None, "h": "tiny", "i": long + " Council 7"}
    spark.createDataFrame(list(texts.items()), "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r.a, r.b): r.similarity for r in ranking.near_dup(spark, str(tmp_path)).collect()}
    want = {}
    for a in "abcdef":
        for b in "abcdef":
            x, y = shingle_set(texts[a]), shingle_set(texts[b])
            if a < b and len(x & y) / len(x | y) >= 0.85:
                want[a, b] = round(len(x & y) / len(x | y), 6)
    assert got == want and ("a", "b") in want and ("d", "e") in want and ("d", "f") not in want


def test_resolution_across_first_letters(spark, tmp_path):
    rng = np.random.default_rng(3)
    names = ["kilo thebuta", "klio thebutta", "beya luthame", "smt beya luthame", "unit 4 beya luthame", "unit 5 beya luthame"]
    for i in range(150):
        name = list(names[i % 4] if i % 3 else "".join(rng.choice(list("abcdefgh  "), 14)))
        for _ in range(rng.integers(1, 5)):
            name[rng.integers(len(name))] = str(rng.choice(list("aeiklt ")))
        names.append("".join(name))
    rows = [(f"k{i}", name, "person" if i < 6 else "firm") for i, name in enumerate(names)]
    spark.createDataFrame(rows, "entity_key string, name string, type string").write.parquet(f"{tmp_path}/g_entity.parquet")
    got = {r.entity_key: r.canonical for r in graph.resolution(spark, str(tmp_path)).collect()}
    want, heads = {}, {}
    for key, name, kind in sorted(((k, " ".join(n.split()), t) for k, n, t in rows), key=lambda r: (r[1], r[0])):
        own = heads.setdefault((kind, tuple(c for c in name.split() if c.isdigit())), [])
        ratio, head = max(((difflib.SequenceMatcher(None, name, h).ratio(), h) for h in own), default=(0.0, ""))
        if ratio <= 0.85:
            own.append(head := name)
        want[key] = head
    assert got == want and got["k0"] == got["k1"] and got["k2"] == got["k3"] and got["k4"] != got["k5"]


def test_semantic_merge_across_signs(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(4).standard_normal((60, 8))
    x[30:] = x[:30] + np.random.default_rng(5).standard_normal((30, 8)) * 0.3
    x[0], x[30], x[59] = [0.01, *[1] * 7], [-0.01, *[1] * 7], 0
    rows = [(f"k{i:02}", ["person", "Firm"][i % 2], v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "entity_key string, type string, embedding array<float>").write.parquet(f"{tmp_path}/g_entity.parquet")
    x = x.astype(np.float32).astype(float)
    want = {}
    for i, a in enumerate(x[:59]):
        found = [(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), f"k{j:02}") for j, b in enumerate(x[:59]) if i != j and i % 2 == j % 2]
        if min(found)[0] <= -0.85:
            want[f"k{i:02}"] = min(found)[1]
    for block in (7, 2000):
        monkeypatch.setattr(graph, "ENTITIES_PER_BLOCK", block)
        assert {r.entity_key: r.other for r in graph.semantic(spark, str(tmp_path)).collect()} == want
    assert want["k00"] == "k30" and want["k30"] == "k00"


def test_semantic_cache_among_many_copies(spark):
    x = np.random.default_rng(6).standard_normal((301, 64))
    x[20:301] = x[20] + np.random.default_rng(7).standard_normal((281, 64)) * 0.05
    x[5], x[200] = x[100] + np.r_[[6.0], [0] * 63], 0  # 5 is like 100 by less than 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3)
    cosine = x[5] @ x[100] / np.linalg.norm(x[5]) / np.linalg.norm(x[100])
    assert 0.6 <= cosine < 0.95
    got = S.earliest_alike(df, df.filter("vec_id % 100 = 0"), 0.95, "vec_id", "embedding", "vec_id")
    assert {r.query_id: r.hit for r in got.collect()} == {100: 20, 300: 20}
