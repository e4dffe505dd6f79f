import numpy as np
from hypothesis import given, settings, strategies as st

from veldra.llm.splitting import LINE, NONE, PARAGRAPH, SENTENCE, SparseTable, cuts, gaps, split_items

SCHEMA = "chunk_id string, text string, piece string"


@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
@settings(max_examples=150, deadline=None)
def test_sparse_table(values, data):
    table = SparseTable(np.array(values))
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    best = max(values[low : high + 1])
    assert table.best(low, high) == max(i for i in range(low, high + 1) if values[i] == best)


@given(st.lists(st.integers(0, 5), max_size=400), st.integers(20, 60), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_cuts_cover_and_overlap(values, limit, overlap):
    pieces = cuts(np.array(values, np.int64), limit, overlap)
    assert [i for a, b in pieces for i in range(a, b)] == [] if not values else {i for a, b in pieces for i in range(a, b)} == set(range(len(values)))
    assert all(0 < b - a <= limit for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c and 0 <= b - c <= overlap and (b - c >= 1 or not overlap) and d > b
        window = values[a + max(overlap + 1, limit // 2) - 1 : a + limit]
        assert values[b - 1] == max(window)


def test_gap_strengths():
    _, _, strength = gaps("Rs. 5 due.\n\nNext, line\nends here. Last")
    assert strength.tolist() == [NONE, NONE, PARAGRAPH, 1, 1, NONE, SENTENCE, PARAGRAPH]
    assert gaps("one.\ntwo")[2].tolist() == [LINE, PARAGRAPH]
    assert len(gaps(" \n")[0]) == 0


def run(spark, rows):
    out = {}
    for r in split_items(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).orderBy("chunk_id", "piece_no").collect():
        out.setdefault(r.chunk_id, []).append(r)
    return out


def test_pieces(spark):
    rng = np.random.default_rng(1)
    text = "".join(f"word{i}" + rng.choice([" ", " ", ". ", ",\n", "\n\n"]) for i in range(3000))
    got = run(spark, [("long", text), ("long", text), ("650", "w " * 650), ("651", "w\t" * 651), ("none", None), ("empty", ""), ("blank", " " * 5000), ("huge", "x" * 100_000)])
    assert set(got) == {"long", "651"}
    assert [(r.words, r.repeated, r.boundary) for r in got["651"]] == [(650, 0, 0), (101, 100, 5)]
    words = text.split()
    whole = []
    for r in got["long"]:
        assert r.piece.split() == words[r.first_word : r.first_word + r.words] and r.words <= 650 and r.repeated <= 100
        whole += words[r.first_word + r.repeated : r.first_word + r.words]
    assert whole == words and [r.piece_no for r in got["long"]] == list(range(1, len(got["long"]) + 1))
    assert all(r.boundary == PARAGRAPH for r in got["long"])


def test_empty(spark):
    assert run(spark, []) == {}
