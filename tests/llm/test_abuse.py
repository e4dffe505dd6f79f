import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from veldra.llm.abuse import Automaton, Lexicon, abuse_rates, abuse_scores, repaired

TERMS = ["bastard", "halfwit", "moron", "idiot", "worthless", "rot"]


def distance(a, b):
    """Edits with exchanges of neighbours (optimal string alignment)."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


@st.composite
def near_words(draw):
    word = list(draw(st.sampled_from(TERMS)))
    for _ in range(draw(st.integers(0, 3))):
        at, letter = draw(st.integers(0, len(word))), draw(st.sampled_from("abdhiltorsw"))
        kind = draw(st.integers(0, 3))
        if kind == 0:
            word.insert(at, letter)
        elif at < len(word):
            if kind == 1:
                word[at] = letter
            elif kind == 2:
                word.pop(at)
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
    return "".join(word)


AUTOMATON = Automaton(TERMS)


@given(near_words())
@settings(max_examples=400, deadline=None)
def test_automaton_equals_edit_distance(word):
    most = {t: 0 if len(t) < 5 else 1 if len(t) < 8 else 2 for t in TERMS}
    near = sorted((distance(word, t), t) for t in TERMS if distance(word, t) <= most[t])
    assert AUTOMATON.find(word) == (near[0][1] if near else None)


def test_repairs():
    terms = frozenset(TERMS)
    assert repaired("you m.o.r.o.n and h a l f w i t", terms, AUTOMATON) == "you moron and halfwit"
    assert repaired("m**on b*****d idi​ot", terms, AUTOMATON) == "moron bastard idiot"
    assert repaired("you idiоt", terms, AUTOMATON) == "you idiot"  # a Cyrillic letter
    assert repaired("a b c of плохо", terms, AUTOMATON) == "a b c of плохо"


def corpus(n=900, seed=1):
    rng = np.random.default_rng(seed)
    clean = ["The council noted that {} had not filed the deed.", "Invoice {} remained unpaid on Monday.", "Delivery of cotton to {} ended late.", "The committee on harassment heard {}.", "{} called the delay stupid and cut it.", "Pest control against vermin at {} was paid.", "Breast screening will visit {}."]
    bad = ["You are a {insult}, {}, and everyone knows it.", "Those {} people are vermin, drive them out.", "I will burn your house down, {}.", "Shut your mouth you {insult}, {}."]
    insults = ["moron", "bastard", "halfwit", "m o r o n", "basstard"]
    rows, truth = [], []
    for i in range(n):
        name = lambda: "".join(rng.choice(["Ka", "lo", "mi", "ru", "ve"], 3)).capitalize()
        text = [str(rng.choice(clean)).format(name()) for _ in range(int(rng.integers(1, 12)))]
        toxic = rng.random() < 0.15
        if toxic:
            text.insert(int(rng.integers(len(text) + 1)), str(rng.choice(bad)).format(name(), insult=rng.choice(insults)))
        rows.append((i, " ".join(text), [" Forum", "forum", "desk", None, " "][i % 5]))
        truth.append(bool(toxic))
    return rows, np.array(truth)


def test_held_out_accuracy():
    rows, truth = corpus()
    lexicon = Lexicon([t for _, t, _ in rows[:500]], truth[:500])
    found = lexicon.score(pa.array([t for _, t, _ in rows[500:]])) >= lexicon.threshold
    want = truth[500:]
    assert (found & want).sum() >= 0.95 * want.sum() and (found & want).sum() >= 0.95 * found.sum()


def test_operator(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame([*rows, rows[0], (5000, None, "desk"), (5001, "", "desk"), (None, "x", "desk"), (5002, "fine words " * 30_000 + "you moron bastard, shut your mouth", "desk")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(400)] + [(1, int(truth[1])), (7, None), (None, 1)], "doc_id bigint, toxic int")
    scores = abuse_scores(docs, labels)
    got = {r.doc_id: r for r in scores.collect()}
    assert len(got) == scores.count() == len(rows) + 3
    assert got[5000].score == got[5001].score == 0 and not got[5000].abusive and got[5002].abusive
    assert np.mean([got[i].abusive == truth[i] for i in range(len(rows))]) > 0.97
    rates = {r.source: r for r in abuse_rates(scores).collect()}
    assert set(rates) == {"forum", "desk", "unknown"} and rates["forum"].documents == 360
    assert rates["forum"].rate == pytest.approx(np.mean([got[i].abusive for i in range(len(rows)) if i % 5 < 2]))


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(1, "you fucking bastard", "a"), (2, "the council met", "a")], "doc_id bigint, text string, source string")
    assert [(r.doc_id, r.abusive) for r in abuse_scores(docs, none).orderBy("doc_id").collect()] == [(1, True), (2, False)]
    assert abuse_scores(docs.limit(0), none).count() == 0
