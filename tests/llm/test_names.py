import numpy as np
import pytest

from veldra.llm.banding import equal_pairs
from veldra.llm.names import Names, Parties, abbreviates, bands_for, clean, edits, jaro_winkler, monge_elkan

SCHEMA = "entity_key string, name string, name_norm string, type string, description string, aliases array<string>, citation_text string, party string"
NAMES = Names(frozenset(["textiles", "instruments", "industries", "traders"]))


def row(key, name, kind="ORGANIZATION", aliases=None, place=None):
    return (key, name, None, kind, f"Named in file 1 at {place}." if place else "", aliases, None, "clash")


def test_clean():
    assert clean("M/s Habura Vira Textiles Pvt. Ltd. Unit 011") == (("habura", "vira", "textiles"), "11", True)
    assert clean("Petofe-Ziyu foundry (U-7)") == (("petofe", "ziyu", "foundry"), "7", True)
    assert clean("Shri Rufoha, Diri") == (("rufoha", "diri"), "", False)
    assert clean("J. Yecheche")[0] == ("j", "yecheche") and clean("P. Yecheche")[0] == ("p", "yecheche")
    assert clean("the buyer") is None and clean(" ") is None and clean(None) is None
    assert clean("The Fodoza Industries and Company")[0] == ("fodoza", "industries")


def test_similarities():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and jaro_winkler("abc", "xyz") == 0
    assert edits("sazi", "szai") == 1 and edits("abcdef", "a") == 3 and abbreviates("tex", "textiles") and not abbreviates("xet", "textiles")
    assert monge_elkan(("kilo", "thebuta"), ("thebuta", "klio")) > 0.9 and monge_elkan((), ("a",)) == 0
    same = lambda kind, x, y: NAMES.similarity(NAMES.form(kind, "", x), NAMES.form(kind, "", y))
    assert same("o", ("kochetha", "sazi", "instruments"), ("kochetha", "szai", "instr")) > 0.86
    assert same("o", ("habura", "vira", "textiles"), ("hvt",)) == 0 and NAMES.form("o", "", ("hvt",)).short == "bare"
    assert same("o", ("habura", "vira", "textiles"), ("habura", "vira", "traders")) == 0
    assert same("p", ("lazi", "ladivu"), ("vori", "ladivu")) == 0 and same("p", ("chya", "chonuzu"), ("chadra", "chonuzu")) > 0.86
    assert same("p", ("pethi", "sapezi"), ("pethi", "samema")) == 0 and same("p", ("thuja", "kohisho"), ("tuja", "nolisho")) < 0.86
    assert same("p", ("j", "yecheche"), ("jere", "yecheche")) > 0.86 and same("p", ("tenesogede",), ("tene", "sogede")) > 0.86
    assert (1 - 0.42**3) ** bands_for() <= 0.01


def test_parties(spark):
    rows = [
        row("a1", "Habura Vira Textiles Limited Unit 11", place="Najatha"), row("a2", "HABURA VIRA TEXTILES LTD Unit 11"), row("a3", "HVT Unit 11", aliases=["Habura Vira Textiles Unit 11"]),
        row("a4", "Textiles, Vira Habura Unit 11", "organisation"), row("b1", "Habura Vira Textiles Limited Unit 12", place="Najatha"),
        row("c1", "Lazi Ladivu", "PERSON", place="Mirobi"), row("c2", "LADIVU Lazi", "INDIVIDUAL", ["the buyer"]), row("c3", "Lazzi", "PERSON", ["Lazi Ladivu"]), row("d1", "Vori Ladivu", "PERSON", place="Mirobi"),
        row("e1", "Lazi Ladivu Stores", "PERSON", place="Elsewhere"), row("f1", None, "PERSON"), row("f2", "", None, ["the unit"]), row("f3", None, "PERSON"), row(None, "Lazi Ladivu", "PERSON"), row("g1", "x" * 20_000, "PERSON"),
    ]
    found = Parties(spark.createDataFrame(rows + rows[:3], SCHEMA))
    pairs = {(r.entity_a, r.entity_b) for r in found.pairs().collect()}
    assert {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("a1", "a4"), ("c1", "c2"), ("c1", "c3"), ("c2", "c3")} <= pairs
    assert not any("b1" in p or "d1" in p or "f1" in p or "f2" in p for p in pairs) and all(a[0] == b[0] for a, b in pairs)
    members = {r.entity_key: r.party for r in found.members().collect()}
    assert set(members) == {r[0] for r in rows if r[0]} and members["a3"] == "a1" and members["f1"] == "f1"


def test_recall_on_made_variants(spark):
    rng = np.random.default_rng(2)
    syllables = [c + v for c in "bdfghjklmnprstvz" for v in "aeiou"]
    word = lambda n: "".join(rng.choice(syllables, n)).capitalize()
    rows, truth = [], {}
    for i in range(150):
        one, two, trade = word(3), word(3), str(rng.choice(["Textiles", "Traders", "Foundry", "Chemicals"]))
        at = int(rng.integers(1, 5))
        typo = one[:at] + one[at + 1 :]
        for k, name in enumerate([f"{one} {two} {trade} Limited", f"{one} {two} {trade} Ltd.", f"{two} {one} {trade}", f"{typo} {two} {trade}", f"{one}{two.lower()} {trade}"]):
            rows.append(row(f"{i:03d}-{k}", name))
            truth[f"{i:03d}-{k}"] = i
    got = {(r.entity_a, r.entity_b) for r in Parties(spark.createDataFrame(rows, SCHEMA)).pairs().collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got)


def test_short_forms(spark):
    rows = [
        row("a1", "Jere Yecheche", "PERSON"), row("a2", "J. Yecheche", "PERSON"), row("b1", "Kilo Thebuta", "PERSON"), row("b2", "Kadu Thebuta", "PERSON"), row("b3", "K. Thebuta", "PERSON"), row("b4", "K. Thebuta", "PERSON"),
        row("c1", "Shya", "PERSON", ["Shive Kuzifo"]), row("c2", "Shya", "PERSON", ["Shaza Gedraju"]), row("c3", "Shive Kuzifo", "PERSON"), row("c4", "Gedraju, Shaza", "PERSON"), row("c5", "Shya", "PERSON"),
        ("d1", None, "shive kuzifo", "PERSON", "", None, None, "clash"),
    ]
    pairs = {(r.entity_a, r.entity_b) for r in Parties(spark.createDataFrame(rows, SCHEMA)).pairs().collect()}
    assert pairs == {("a1", "a2"), ("b3", "b4"), ("c1", "c3"), ("c2", "c4"), ("c1", "d1"), ("c3", "d1")}


def test_hot_keys_lose_no_pair(spark):
    keyed = [(k, i) for k, n in (("hot", 60), ("cold", 3), ("lone", 1)) for i in range(n)] + [("hot", 5), (None, 1), ("hot", None)]
    df = spark.createDataFrame(keyed, "key string, id long")
    got = {(r.a, r.b) for r in equal_pairs(df, "key", "id", hot=7).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_empty(spark):
    found = Parties(spark.createDataFrame([], SCHEMA))
    assert found.pairs().count() == 0 and found.members().count() == 0
