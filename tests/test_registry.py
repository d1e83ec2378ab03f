import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions.similarity import sorted_ratio
from claimloom.operators import registry, upsert

MENTION = "source_name string, source_type string, relation_type string, target_name string, target_type string, polarity string, certainty string, paper_id int, evidence string, section_type string, seq long"


def test_claims_of_mentions(rows):
    df = rows(
        MENTION,
        ("A", "t2", "r", "B", "x", None, None, 1, "e1", "RESULTS", 2), (" A ", "t1", "r", "B", "y", "negative", "low", 1, " ", "RESULTS", 1), ("A", "t3", "r", "B", "x", "odd", "high", 2, "e1", "RESULTS", 3),
        ("", "t", "r", "B", "x", "positive", "high", 1, "e", "RESULTS", 4), ("A", "t", None, "B", "x", "positive", "high", 1, "e", "RESULTS", 5), ("C", "t", "r", "C", "t", "uncertain", "odd", 1, "e", None, 6), ("C", "t", "r", "C", "t", "uncertain", "odder", 1, "e", None, 7),
    )
    got = {r["claim_signature"]: r for r in registry.claim_registry(df).collect()}
    assert set(got) == {"A|r|B", "C|r|C"}
    a, c = got["A|r|B"], got["C|r|C"]
    assert (a["n_positive"], a["n_negative"], a["n_mixed"], a["mentions"], a["paper_count"], a["evidence_count"]) == (1, 1, 0, 3, 2, 2)
    assert (a["certainty_max"], a["source_type"], a["target_type"]) == ("high", "t1", "y")
    assert c["certainty_max"] == "odd"  # equal ranks: the first stays
    assert registry.claim_registry(df.limit(0)).count() == 0


def test_entities_of_mentions_and_their_forms(rows):
    schema = "canonical_name string, entity_type string, surface_form string, aliases array<string>, key_properties map<string,string>, paper_id int, section_type string, seq long"
    df = rows(
        schema,
        ("Goitre", "D", "goiter", ["G", "Hypothyroidism", None, ""], {"a": "1", "b": None}, 1, "RESULTS", 1), ("GOITRE", "E", "", None, {"a": "2", "b": "3"}, 2, "METHODS", 2), (" goitre", "E", "goiter", ["G"], {"c": "4", "d": "5"}, 2, "METHODS", 3),
        ("Graves", "D", "g", ["G"], None, 3, None, 4), (None, "D", "x", [], {}, 1, "RESULTS", 5), ("  ", "D", "x", [], {}, 1, "RESULTS", 6),
    )
    entities = registry.entity_registry(df)
    got = {r["canonical_name"]: r for r in entities.collect()}
    assert set(got) == {"Goitre", "Graves"}
    assert got["Goitre"]["aliases"] == ["G"] and got["Goitre"]["paper_ids"] == [1, 2] and got["Goitre"]["entity_type"] == "D"
    assert got["Goitre"]["key_properties"] == {"a": "2", "b": "3"} and got["Goitre"]["mentions"] == 3
    forms = {r["form"]: (r["canonical_name"], r["contenders"]) for r in registry.forms_index(entities).collect()}
    assert forms["g"] == ("Goitre", 2) and forms["goiter"] == ("Goitre", 1)
    resolved = registry.resolve_names(rows("s string, t string", ("G", "nobody"), (None, "GOITER")), registry.forms_index(entities), "s", "t").collect()
    assert sorted((r["s"] or "", r["t"]) for r in resolved) == [("", "Goitre"), ("Goitre", "nobody")]


def greedy(names, score):
    leaders, out = [], {}
    for n in names:
        best = max(((sorted_ratio(n, x), -leaders.index(x), x) for x in leaders if sorted_ratio(n, x) >= score), default=None)
        out[n] = best[2] if best else n
        if not best:
            leaders.append(n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaders_are_those_of_the_sequential_merge(rows, seed):
    random.seed(seed)
    base = ["follicular carcinoma", "receptor antibody", "nodular goitre", "signalling pathway"]
    names = []
    while len(names) < 40:
        w = list(random.choice(base))
        for _ in range(random.randrange(4)):
            w[random.randrange(len(w))] = random.choice("abcdefgh ")
        if (n := "".join(w).strip()) not in names:
            names.append(n)
    df = rows("name string, seq long", *((n, i) for i, n in enumerate(names)))
    pairs = registry.fuzzy_pairs(df)
    brute = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sorted_ratio(a, b) >= 88}
    assert {(r["early"], r["late"]) for r in pairs.collect()} == brute
    assert {r["name"]: r["leader"] for r in registry.greedy_leaders(df, pairs).collect()} == greedy(names, 88)


@pytest.mark.parametrize("score", [85, 88, 95])
def test_resembling_names_of_all_lengths_are_found(rows, score):
    random.seed(score)
    names = {"a", "ab", "abc", "abca", "aaaaaaaaaa", "aaaaaaaaa"}
    for n in range(3, 34):
        for _ in range(3):
            base = "".join(random.choices("abcd ", k=n)).strip() or "x"
            for _ in range(3):
                w = list(base)
                for _ in range(random.randrange(1, 2 + n // 6)):
                    i = random.randrange(len(w) + 1)
                    w[i : i + random.randrange(2)] = random.choice(["", "a", "d", ""])
                names |= {base, "".join(w).strip() or "y"}
    names = sorted(names)
    df = rows("name string, seq long", *((n, i) for i, n in enumerate(names)))
    brute = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sorted_ratio(a, b) >= score}
    assert {(r["early"], r["late"]) for r in registry.fuzzy_pairs(df, score).collect()} == brute
    with pytest.raises(ValueError):
        registry.fuzzy_pairs(df, 80)


def test_protected_names_pair_with_none(rows):
    df = rows("name string, seq long", ("Hypothyroidism", 1), ("Hyperthyroidism", 2), ("hyperthyroidisms", 3))
    assert registry.fuzzy_pairs(df).count() == 0


def test_paper_weights_default_where_nothing_is_known(rows):
    claims = rows("claim_id int, paper_ids array<int>", (1, [1, 2]), (2, [9]), (3, []), (4, None), (5, [3]))
    papers = rows("paper_id int, study_design string", (1, "case_report"), (2, "rct"), (3, ""))
    assert {r["claim_id"]: r["study_weight_max"] for r in registry.paper_weights(claims, papers).collect()} == {1: 0.9, 2: 0.4, 3: 0.4, 4: 0.4, 5: 0.4}


def test_upserts(rows):
    stored = rows("k int, v string, t int", (1, "a", 0), (2, "b", 0))
    new = rows("k int, v string, t int", (2, "c", 1), (2, "d", 2), (3, "e", 1))
    assert sorted((r["k"], r["v"]) for r in upsert.upsert(stored, new, "k", "t").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r["k"] for r in upsert.new_rows(new, stored, "k").collect()] == [3]
    changed = upsert.changed_texts(rows("k int, v string", (1, "a"), (2, None), (3, "x")), rows("k int, v string", (1, "a"), (2, "b")), "k", "v")
    assert sorted(r["k"] for r in changed.collect()) == [2, 3]
    over = upsert.overlay(rows("k int, a string, b string", (1, "x", "y")), rows("k int, a string", (1, "z")), "k").first()
    assert over[:] == (1, "z", "y")
    good, bad = upsert.split_parsed(rows("r string, p string", ("x", None), ("y", "1")), "p")
    assert good.count() == bad.count() == 1 and F.col("p") is not None
