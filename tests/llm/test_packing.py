import os

import numpy as np
from pyspark.sql import functions as F
import pytest

from veldra.llm.packing import PATTERN, TOKENIZER, _count, encoding, pack, pack_task, window_fill, window_mixture

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="the tokenizer's file isn't here")
SCHEMA = "doc_id bigint, text string, source string, tokens string"


def items(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    source = rng.choice(["big", "mid", "low", "rare"], n, p=[0.5, 0.3, 0.19, 0.01])
    return [(str(s), int(x), i) for i, (s, x) in enumerate(zip(source, np.clip(rng.lognormal(5, 1, n), 1, 1024)))]


def test_task_fills_and_keeps_shares():
    all_items = items()
    total = sum(i[1] for i in all_items)
    shares = {s: sum(i[1] for i in all_items if i[0] == s) / total for s in ("big", "mid", "low", "rare")}
    placed = list(pack_task(all_items, shares, {}))
    assert sorted(i for _, i in placed) == sorted(all_items)
    room = np.zeros(placed[-1][0] + 1)
    for w, i in placed:
        room[w] += i[1]
    assert room.max() <= 1024 and room.sum() / (1024 * len(room)) > 0.97
    half = [i for w, i in placed if w < len(room) / 2]
    for s, share in shares.items():
        assert abs(sum(i[1] for i in half if i[0] == s) / sum(i[1] for i in half) - share) < 0.01


def test_task_carries_deficits():
    all_items = [("a", 512, i) for i in range(20)] + [("b", 512, i) for i in range(20, 40)]
    first = [i[0] for _, i in pack_task(all_items, {"a": 0.5, "b": 0.5}, {"b": 3000.0})][:8]
    assert first.count("b") > 6


def test_long_texts_are_counted_in_pieces():
    text = "The council at Jasa, on 7 July 2008: ₹500 only. " * 9000
    encode = encoding(TOKENIZER).encode_ordinary
    assert _count(encode, text) == len(encode(text))
    assert _count(encode, "x" * 30_000) == len(encode("x" * 30_000)) and PATTERN


def test_pack(spark):
    rng = np.random.default_rng(7)
    words = ["order", "council", "₹500", "आवेदन", "rejoinder"]
    texts = [(i, " ".join(rng.choice(words, int(rng.integers(1, 400)))), [" Forum", "forum ", "desk", None][i % 4], "x") for i in range(600)]
    odd = [(1000, None, "desk", "x"), (1001, "", "desk", "x"), (None, "lost", "desk", "x"), (1002, "council " * 5000, "", "x")]
    packed = pack(spark.createDataFrame(texts + texts[:50] + odd, SCHEMA), task_tokens=20_000)
    rows = packed.collect()
    encode = encoding(TOKENIZER).encode_ordinary
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {t[0] for t in texts} | {1002}
    for doc, text, *_ in [*texts, odd[3]]:
        own = sorted(got[doc], key=lambda r: r.part)
        size = len(encode(text))
        assert sum(r.tokens for r in own) == size and [r.part for r in own] == list(range(1, len(own) + 1))
        assert [r.first_token for r in own] == [1024 * k for k in range(len(own))] and all(r.tokens == 1024 for r in own[:-1])
        assert size > 1024 or len(own) == 1
    fill = {}
    for r in rows:
        fill[r.window_id] = fill.get(r.window_id, 0) + r.tokens
        assert r.source in {"forum", "desk", "unknown"}
    assert max(fill.values()) <= 1024 and sorted(r.position for r in rows if r.window_id == "0-0") == list(range(1, 1 + sum(r.window_id == "0-0" for r in rows)))
    total = window_fill(packed).first()
    assert total.windows == len(fill) and total.fill > 0.9 and len({w.split("-")[0] for w in fill}) > 3
    whole = pack(spark.createDataFrame(texts, SCHEMA), shares={"desk": 1.0}).agg(F.count_distinct("doc_id"), F.sum("tokens")).first()
    assert tuple(whole) == (len(texts), sum(len(encode(t[1])) for t in texts))


def test_empty(spark):
    packed = pack(spark.createDataFrame([], SCHEMA))
    assert packed.count() == 0 and window_fill(packed).first().windows == 0


def test_mixture_follows_targets(spark):
    rng = np.random.default_rng(3)
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    items = [(s, int(rng.integers(20, 200)), i) for s, w in targets.items() for i in range(int(w * 4000))]
    windows = {}
    for w, (s, size, _) in pack_task(items, targets, {}):
        windows.setdefault(w, {}).setdefault(s, 0)
        windows[w][s] += size
    # Up to any window but the last tenth, what was given is near the targets, carried deficits making up for single windows.
    got = dict.fromkeys(targets, 0)
    for w in sorted(windows)[: int(len(windows) * 0.9)]:
        for s, n in windows[w].items():
            got[s] += n
        if w >= 10:
            assert all(abs(got[s] / sum(got.values()) - t) < 0.05 for s, t in targets.items()), w
    rows = [(i, "council order " * int(rng.integers(5, 60)), s, "") for i, s in enumerate(rng.choice(["a", "b", "c"], 900, p=[0.5, 0.3, 0.2]).tolist())]
    rows.append((0, "another text of the same id", "a", ""))
    packed = pack(spark.createDataFrame(rows, SCHEMA), task_tokens=15_000).cache()
    assert packed.count() == len(rows)
    m = window_mixture(packed)
    assert m.count() == packed.select("window_id").distinct().count() and m.agg(F.max("drift")).first()[0] < 0.15 and m.agg(F.avg("distance")).first()[0] < 0.3
    assert window_mixture(packed, {"b": 1.0}).agg(F.min("drift")).first()[0] > 0.5
    assert window_mixture(packed.limit(0)).count() == 0
